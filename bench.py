"""Times the model build and every registered query; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of threads.
Results go to Spark's noop sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from flightlag import build_session
from flightlag.plans.catalog import QUERIES, inputs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = build_session(
        "flightlag-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    # The first query of a session pays for class loading and code generation.
    seconds["session_warm_up"] = timed(lambda: consume(spark.read.parquet(f"{SF_DIR}/events.parquet")))
    house = inputs(spark, SF_DIR).warehouse()
    seconds["feed_to_parquet"] = timed(house.feed)
    seconds["build_models"] = timed(house.materialise)
    models = {name: round(took, 3) for name, took in house.seconds.items()}
    for name, query in QUERIES.items():
        seconds[name] = timed(lambda: consume(query(spark, SF_DIR)))
    rows = house.flight().count()
    print(
        json.dumps(
            {
                "metric": "feed, model build and all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "flights": rows,
                "models": models,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
