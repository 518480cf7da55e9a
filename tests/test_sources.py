import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from flightlag.operators.filters import Slice
from flightlag.session import pin_session
from flightlag.sources import raw_feed
from flightlag.sources.airports import read_airport_file, with_overrides
from flightlag.sources.schema import FEED_COLUMNS, FEED_SCHEMA, cast_text
from flightlag.sources.sinks import json_document, write_csv, write_json_document
from flightlag.streaming.landing import LANDED_FILE, Ledger, ingest_landing, text_schema, watch_landing


@pytest.mark.parametrize(
    "kind, cells",
    [
        ("int", {"7": 7, " 7 ": 7, "12.6": 13, "x": None, "": None, None: None}),
        ("hhmm", {"0856": 856, "2400": 2400, "": None}),
        ("minutes", {"12.00": 12, "-3.00": -3, "12.5": 12, "abc": None}),
        ("num", {"12.25": 12.25, "": None}),
        ("bool", {"1.00": True, "0.00": False, "2": False, "": None, "yes": None}),
        ("str", {" a ": "a", "": None, "   ": None}),
        ("date", {"2024-02-29": dt.date(2024, 2, 29), "2024-02-30": None, "": None}),
    ],
)
def test_casts(spark, kind, cells):
    df = spark.createDataFrame(list(enumerate(cells)), "i int, t string")
    got = [r.v for r in df.orderBy("i").select("i", cast_text(F.col("t"), kind).alias("v")).collect()]
    assert got == list(cells.values())


def test_declared_columns():
    assert len(FEED_COLUMNS) == 49 and len({name for _, name, _ in FEED_COLUMNS}) == 49
    kinds = [k for *_, k in FEED_COLUMNS]
    assert {k: kinds.count(k) for k in set(kinds)} == {
        "int": 10, "hhmm": 6, "minutes": 14, "num": 1, "bool": 4, "date": 1, "str": 13,
    }


def feed(spark, months):
    rows = [
        (y, m, dt.date(y, m, d), "AA", "Señor", 856, 12, True, 250.5)
        for y, m in months
        for d in (1, 2, 3)
    ]
    return spark.createDataFrame(
        rows,
        "year int, month int, flight_date date, carrier string, origin_city string, crs_dep_time int,"
        " dep_delay int, cancelled boolean, distance_miles double",
    )


def test_text_feed_round_trip(spark, tmp_path):
    path = str(tmp_path / "text")
    typed = feed(spark, [(2024, 1)])
    raw_feed.write_text_feed(typed, path)
    raw = b"".join(open(f, "rb").read() for f in glob.glob(path + "/*.csv"))
    assert b"Se\xf1or" in raw and b'"0856"' in raw and b'"12.00"' in raw
    back = raw_feed.typed_projection(raw_feed.read_text_feed(spark, path))
    assert back.schema == FEED_SCHEMA
    assert back.select(*typed.columns).exceptAll(typed).count() == 0
    assert back.filter("tail_number IS NULL AND arr_delay IS NULL").count() == 3


def test_malformed_lines_fail(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("Year,Month\n2024,1\n2024,1,7\n", encoding="latin-1")
    with pytest.raises(Exception, match="(?i)malformed"):
        raw_feed.read_text_feed(spark, str(tmp_path)).collect()


def test_months_are_replaced_one_by_one(spark, tmp_path):
    root = str(tmp_path / "months")
    full = spark.createDataFrame([], FEED_SCHEMA).unionByName(feed(spark, [(2024, 1), (2024, 2)]), True)
    raw_feed.write_months(full, root)
    again = full.filter("month = 2 AND day(flight_date) = 1")
    raw_feed.write_months(again, root)
    stored = raw_feed.read_months(spark, root)
    assert stored.schema["year"].dataType.simpleString() == "int"
    assert {(r.year, r.month, r.rows) for r in raw_feed.stored_months(spark, root).collect()} == {
        (2024, 1, 3), (2024, 2, 1),
    }
    plan = stored.filter("year = 2024 AND month = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_month_status(spark, tmp_path):
    wanted = raw_feed.month_window(spark, dt.date(2023, 11, 5), dt.date(2024, 2, 1))
    here = feed(spark, [(2023, 11), (2023, 12), (2024, 1)])
    stored = spark.createDataFrame([(2023, 12)], "year int, month int")
    got = {(r.year, r.month): r.status for r in raw_feed.month_status(wanted, here, stored).collect()}
    assert got == {
        (2023, 11): "to_ingest", (2023, 12): "stored", (2024, 1): "to_ingest", (2024, 2): "missing",
    }
    new = raw_feed.months_to_ingest(wanted, here, raw_feed.empty_months(spark))
    assert {(r.year, r.month) for r in new.collect()} == {(2023, 11), (2023, 12), (2024, 1)}


def test_airport_file(spark, tmp_path):
    (tmp_path / "airports.dat").write_text(
        '1,"Big ""Old"" Field","Town","Land","AAA","KAAA",1.5,-2.5,10,-6,"A","America/Chicago","airport","x"\n'
        '2,"No zone","Bishop","Land","BIH","KBIH",1,2,10,-8,"A",\\N,"airport","x"\n'
        '3,"No code","Town","Land",\\N,"KCCC",1,2,10,-6,"A","America/Chicago","airport","x"\n'
        '4,"Long code","Town","Land","AAAA","KDDD",1,2,10,-6,"A","America/Chicago","airport","x"\n'
        '5,"Bad place","Town","Land","EEE","KEEE",north,2,10,-6,"A",\\N,"airport","x"\n'
    )
    rows = read_airport_file(spark, str(tmp_path / "airports.dat"))
    got = {r.airport_code: r for r in rows.collect()}
    assert set(got) == {"AAA", "BIH", "EEE"}
    assert got["AAA"].airport_name == 'Big "Old" Field' and got["AAA"].latitude == 1.5
    assert got["EEE"].latitude is None and got["EEE"].timezone is None
    fixed = {r.airport_code: r.timezone for r in with_overrides(rows).collect()}
    assert fixed == {
        "AAA": "America/Chicago", "EEE": None, "BIH": "America/Los_Angeles", "XWA": "America/Chicago",
        "EAR": "America/Chicago", "IFP": "America/Phoenix",
    }


def test_csv_sink(spark, tmp_path):
    df = spark.range(5).select("id", F.when(F.col("id") == 2, None).otherwise("x").alias("t"))
    write_csv(df, str(tmp_path / "out"), [F.col("id").desc()], single_file=True)
    (part,) = glob.glob(str(tmp_path / "out/*.csv"))
    assert open(part).read().splitlines() == ["id,t", "4,x", "3,x", "2,", "1,x", "0,x"]


def test_json_document(spark, tmp_path):
    meta = spark.sql("SELECT 3 AS flights, CAST(NULL AS INT) AS none")
    hours = spark.sql("SELECT * FROM VALUES (7, 1.5), (5, 2.5), (6, null) AS t(hour, v)")
    doc = json_document(meta, {"up": (hours, ["hour"]), "down": (hours, [-F.col("hour")])})
    write_json_document(doc, str(tmp_path / "doc"))
    (part,) = glob.glob(str(tmp_path / "doc/*.txt"))
    got = json.loads(open(part).read())
    assert got["meta"] == {"flights": 3, "none": None}
    assert [r["hour"] for r in got["up"]] == [5, 6, 7] and [r["hour"] for r in got["down"]] == [7, 6, 5]
    assert got["up"][1] == {"hour": 6, "v": None}


def test_landing_files_are_stored_once(spark, tmp_path):
    landing, root, mark = (str(tmp_path / n) for n in ("landing", "months", "mark"))

    def run():
        ingest_landing(watch_landing(spark, landing), root, mark).awaitTermination()
        return {(r.year, r.month, r.rows) for r in raw_feed.stored_months(spark, root).collect()}

    raw_feed.to_text_feed(feed(spark, [(2024, 1)])).write.mode("append").options(
        header=True, encoding=raw_feed.ENCODING
    ).csv(landing)
    assert run() == {(2024, 1, 3)}
    assert run() == {(2024, 1, 3)}
    raw_feed.to_text_feed(feed(spark, [(2024, 2)])).write.mode("append").options(
        header=True, encoding=raw_feed.ENCODING
    ).csv(landing)
    assert run() == {(2024, 1, 3), (2024, 2, 3)}
    # The same month again, and a month that a batch job stores.
    raw_feed.to_text_feed(feed(spark, [(2024, 2)])).write.mode("append").options(
        header=True, encoding=raw_feed.ENCODING
    ).csv(landing)
    raw_feed.write_months(feed(spark, [(2024, 3)]), root)
    assert run() == {(2024, 1, 3), (2024, 2, 3), (2024, 3, 3)}
    raw_feed.write_months(feed(spark, [(2024, 1)]), root)
    assert run() == {(2024, 1, 3), (2024, 2, 3), (2024, 3, 3)}


def landed(spark, *files):
    """Rows of files: (name, months), the rows of a month as often as it is named."""
    parts = [
        feed(spark, [month]).withColumn(LANDED_FILE, F.lit(name)) for name, months in files for month in months
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    empty = spark.createDataFrame([], raw_feed.FEED_SCHEMA)
    return empty.unionByName(whole, allowMissingColumns=True)


def months(spark, root):
    return {(r.year, r.month, r.rows) for r in raw_feed.stored_months(spark, root).collect()}


def test_rows_that_repeat_stay_as_batches_keep_them(spark, tmp_path):
    root, batch_root = str(tmp_path / "landed"), str(tmp_path / "batch")
    twice = landed(spark, ("a", [(2024, 1), (2024, 1)]))
    Ledger(spark, root + "-ledger").land(twice, 0, root)
    raw_feed.write_months(twice.drop(LANDED_FILE), batch_root)
    assert months(spark, root) == months(spark, batch_root) == {(2024, 1, 6)}
    # A later file for the month adds its rows and keeps the others.
    Ledger(spark, root + "-ledger").land(landed(spark, ("b", [(2024, 1), (2024, 2)])), 1, root)
    assert months(spark, root) == {(2024, 1, 9), (2024, 2, 3)}


def test_a_file_counts_once_whatever_its_name(spark, tmp_path):
    root = str(tmp_path / "landed")
    ledger = Ledger(spark, root + "-ledger")
    first = landed(spark, ("a", [(2024, 1)]), ("copy of a", [(2024, 1)]), ("b", [(2024, 2)]))
    ledger.land(first, 0, root)
    assert months(spark, root) == {(2024, 1, 3), (2024, 2, 3)}
    ledger.land(first, 0, root)
    ledger.land(landed(spark, ("again", [(2024, 2)]), ("c", [(2024, 3)])), 0, root)  # a checkpoint begun anew
    assert months(spark, root) == {(2024, 1, 3), (2024, 2, 3), (2024, 3, 3)}
    assert ledger.files().count() == 3
    ledger.land(first.limit(0), 2, root)
    assert months(spark, root) == {(2024, 1, 3), (2024, 2, 3), (2024, 3, 3)}


def test_a_batch_of_known_files_lays_nothing_out(spark, tmp_path, monkeypatch):
    from flightlag.streaming import landing

    root = str(tmp_path / "landed")
    ledger = Ledger(spark, root + "-ledger")
    ledger.land(landed(spark, ("a", [(2024, 1)])), 0, root)

    def refused(*_):
        raise AssertionError("months are written again")

    monkeypatch.setattr(landing, "write_months", refused)
    ledger.land(landed(spark, ("again", [(2024, 1)])), 1, root)
    assert months(spark, root) == {(2024, 1, 3)}


@pytest.mark.parametrize("stopped", ["read_small", "write_months", "place_small"])
def test_a_batch_that_was_stopped_goes_on(spark, tmp_path, monkeypatch, stopped):
    from flightlag.streaming import landing

    root = str(tmp_path / "landed")
    ledger = Ledger(spark, root + "-ledger")
    ledger.land(landed(spark, ("a", [(2024, 1)])), 0, root)
    batch = landed(spark, ("b", [(2024, 1), (2024, 2)]))
    whole = getattr(landing, stopped)

    def stop(*args):
        if stopped == "write_months":
            whole(*args)  # the months are there, the note is not
        raise OSError("stopped")

    monkeypatch.setattr(landing, stopped, stop)
    with pytest.raises(OSError):
        ledger.land(batch, 1, root)
    monkeypatch.setattr(landing, stopped, whole)
    for _ in range(2):
        ledger.land(batch, 1, root)
        assert months(spark, root) == {(2024, 1, 6), (2024, 2, 3)}
    assert ledger.files().count() == 2


def test_an_empty_store_has_no_months(spark, tmp_path):
    root = str(tmp_path / "none yet")
    assert raw_feed.stored_months(spark, root).count() == 0
    raw_feed.ingest_new_months(feed(spark, [(2024, 1)]), spark.sql("SELECT 2024 AS year, 1 AS month"), root)
    assert raw_feed.stored_months(spark, root).count() == 1


def test_landing_files_with_more_columns(spark, tmp_path):
    landing, root, mark = (str(tmp_path / n) for n in ("landing", "months", "mark"))
    wide = raw_feed.to_text_feed(feed(spark, [(2024, 3)])).withColumn("Div1Airport", F.lit("XYZ"))
    wide.select("Div1Airport", *wide.columns[:-1]).write.options(
        header=True, encoding=raw_feed.ENCODING
    ).csv(landing)
    schema = text_schema(spark, landing)
    assert len(schema) == 50
    ingest_landing(watch_landing(spark, landing, schema), root, mark).awaitTermination()
    stored = raw_feed.read_months(spark, root)
    assert stored.filter("carrier = 'AA' AND crs_dep_time = 856").count() == 3


def test_filters(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('AA', 'ORD', 'DEN', date'2024-01-01', 2024, 1),"
        " ('DL', 'DEN', 'ORD', date'2024-01-31', 2024, 1), ('AA', 'DEN', 'ATL', date'2024-02-01', 2024, 2)"
        " AS t(carrier, origin, dest, flight_date, year, month)"
    )
    count = lambda s, *a: s.apply(df, *a).count()
    assert count(Slice()) == 3
    assert count(Slice(carriers=["AA"])) == 2
    assert count(Slice(airports=["ORD"])) == 1 and count(Slice(airports=["ORD"]), "dest") == 1
    assert count(Slice(date_from=dt.date(2024, 1, 31), date_to=dt.date(2024, 2, 1))) == 2
    assert count(Slice(carriers=["AA"], airports=["DEN"], date_to=dt.date(2024, 1, 31))) == 0
    assert Slice().describe() == "all carriers" and not Slice().is_narrowed
    text = Slice(["AA", "DL"], ["ORD"], dt.date(2024, 1, 1), dt.date(2024, 2, 1)).describe()
    assert text == "AA, DL · via ORD · 2024-01-01 to 2024-02-01"


def test_stored_months_are_ingested_without_a_shuffle_of_rows(spark, tmp_path, monkeypatch):
    store, root = str(tmp_path / "store"), str(tmp_path / "months")
    raw_feed.write_months(feed(spark, [(2024, 1), (2024, 2), (2024, 2)]), store)
    written = []
    keep = raw_feed.write_months
    monkeypatch.setattr(raw_feed, "write_months", lambda rows, *more: (written.append(rows), keep(rows, *more)))
    wanted = spark.sql("SELECT 2024 AS year, 2 AS month, uuid() AS id").repartition(2).select("year", "month").distinct()
    raw_feed.ingest_new_months(raw_feed.read_months(spark, store), wanted, root, laid_out=True)
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert [tuple(r) for r in raw_feed.stored_months(spark, root).collect()] == [(2024, 2, 6)]


def test_wide_stages_are_compiled(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    pin_session(spark)
    # HotSpot does not compile methods of more than 8,000 bytes.
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
