"""Stored versions: found by a later session, untouched by a write that is killed, counted while written."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from flightlag import Settings, Warehouse
from flightlag.plans import quality
from flightlag.plans.catalog import FEED_SETTINGS, inputs
from flightlag.sources.airports import read_airport_file
from flightlag.sources.tables import TableStore, _names, content_id, files_id, folder_exists


MONTHS = dataclasses.replace(FEED_SETTINGS, tie_break=Settings().tie_break)


def house(spark, sf_dir, root, settings=MONTHS):
    x = inputs(spark, sf_dir)
    return Warehouse(spark, x.month_root(), read_airport_file(spark, x.airport_file()), settings, root=root)


def fail(*_):
    raise AssertionError("built again")


def numbers(spark, n=5):
    return spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("even"))


def test_counts_are_those_of_the_rows(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.save("plain", numbers(spark))
    store.save("spread", numbers(spark, 1000).withColumn("k", F.col("id") % 3), by=("k",), compact=True)
    store.save("none", numbers(spark, 0))
    assert store.load("spread").count() == 1000
    found = {name: (store.version(name).rows, store.version(name).filled) for name in ("plain", "spread", "none")}
    assert found == {
        "plain": (5, {"id": 5, "even": 3}),
        "spread": (1000, {"id": 1000, "even": 500, "k": 1000}),
        "none": (0, {"id": 0, "even": 0}),
    }


def test_a_name_with_signs_is_counted(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.save("t", spark.range(3).toDF("a.b"))
    assert store.version("t").filled == {"a.b": 3}


def test_another_store_finds_the_tables_of_the_same_inputs(spark, tmp_path):
    TableStore(spark, str(tmp_path), "a").save("t", numbers(spark))
    again = TableStore(spark, str(tmp_path), "a")
    assert again.has("t") and again.load("t").count() == 5 and again.version("t").rows == 5
    assert again.load("t").columns == ["id", "even"]
    assert not TableStore(spark, str(tmp_path), "b").has("t")
    assert not TableStore(spark, str(tmp_path)).has("t")
    with pytest.raises(KeyError):
        TableStore(spark, str(tmp_path), "b").load("t")


def test_a_killed_write_changes_nothing(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), "a")
    before = store.save("t", numbers(spark))
    broken = numbers(spark, 50).withColumn("even", F.when(F.col("id") == 40, F.raise_error(F.lit("lost")).cast("long")).otherwise(1))
    with pytest.raises(Exception, match="lost"):
        store.save("t", broken)
    # Killed after the rows, before the manifest.
    store._publish, publish = fail, store._publish
    with pytest.raises(AssertionError):
        store.save("t", numbers(spark, 7))
    store._publish = publish
    for reader in (store, TableStore(spark, str(tmp_path), "a")):
        assert reader.load("t").count() == 5
    assert before.count() == 5
    assert store.clear_remains("t") >= 1 and store.load("t").count() == 5
    assert len([n for n in _names(spark, store.path("t")) if n.startswith("data-")]) == 1


def test_a_reader_keeps_its_version_and_old_ones_go(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), "a")
    reading = store.save("t", numbers(spark, 5))
    store.save("t", numbers(spark, 6))
    assert reading.count() == 5 and store.load("t").count() == 6
    store.save("t", numbers(spark, 7))
    assert len([n for n in _names(spark, store.path("t")) if n.startswith("data-")]) == 2
    assert store._numbers("t") == [2, 3]


def test_two_writers_both_publish(spark, tmp_path):
    one, two = (TableStore(spark, str(tmp_path), "a") for _ in range(2))
    two._numbers = lambda name: []  # listed before the other published
    one.save("t", numbers(spark, 5))
    two.save("t", numbers(spark, 6))
    assert one._numbers("t") == [1, 2]
    assert TableStore(spark, str(tmp_path), "a").load("t").count() == 6


def test_a_manifest_is_one_whole_file(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.save("t", numbers(spark))
    written = json.loads((tmp_path / "t/manifest/00000001.json").read_text())
    assert written["rows"] == 5 and (tmp_path / "t" / written["data"] / "_SUCCESS").exists()


def test_content_tells_tables_apart(spark, tmp_path):
    a = numbers(spark)
    assert content_id(a) == content_id(a.orderBy(F.desc("id")).repartition(3))
    assert len({content_id(x) for x in (a, a.union(a), a.filter("id > 0"), a.withColumnRenamed("even", "odd"), numbers(spark, 0))}) == 5
    a.write.parquet(str(tmp_path / "k=1"))
    one = files_id(spark, str(tmp_path))
    assert one == files_id(spark, str(tmp_path))
    a.write.parquet(str(tmp_path / "k=2"))
    assert one != files_id(spark, str(tmp_path))


def test_a_second_warehouse_builds_nothing(spark, sf_dir, tmp_path):
    root = str(tmp_path / "models")
    first = house(spark, sf_dir, root)
    log = first.build().collect()
    assert all(r.seconds > 0 for r in log if first.store.has(r.model)) and len(log) == 15
    second = house(spark, sf_dir, root)
    second.store.save = fail
    assert second.build().collect() == log and not second.seconds
    assert second.cascade().exceptAll(first.cascade()).isEmpty()
    assert quality.table_profile(second).exceptAll(quality.table_profile(first)).isEmpty()


def test_other_settings_build_again(spark, sf_dir, tmp_path):
    root = str(tmp_path / "models")
    house(spark, sf_dir, root).carrier_monthly()
    other = house(spark, sf_dir, root, dataclasses.replace(MONTHS, on_time_minutes=30))
    assert not other.store.has("mart_carrier_monthly")
    late = other.carrier_monthly()
    assert not late.exceptAll(house(spark, sf_dir, str(tmp_path / "fresh")).carrier_monthly()).isEmpty()


def test_a_dataframe_feed_is_found_by_its_name_only(spark, sf_dir, tmp_path):
    x, root = inputs(spark, sf_dir), str(tmp_path / "models")
    airports = read_airport_file(spark, x.airport_file())
    make = lambda feed_id: Warehouse(spark, x.legs(), airports, FEED_SETTINGS, root=root, feed_id=feed_id)
    make("2024-01").dim_carrier()
    assert make("2024-01").store.has("dim_carrier") and not make("2024-02").store.has("dim_carrier")
    assert not make(None).store.has("dim_carrier") and folder_exists(spark, f"{root}/dim_carrier")


def test_profile_is_that_of_reading_every_table(spark, sf_dir):
    wh = inputs(spark, sf_dir).warehouse()
    wh.materialise()
    noted, read = quality.table_profile(wh), quality.counted_profile({n: m() for n, m in wh.models().items()})
    assert sorted(noted.collect()) == sorted(read.collect())


def test_build_log_and_profile_read_no_stored_model(spark, sf_dir, monkeypatch):
    """Nothing is read for the log; for the profile only columns that views have of their own."""
    wh = inputs(spark, sf_dir).warehouse()
    wh.materialise()
    read = []
    view = Warehouse._viewed

    def watched(self, df, base=None):
        own = [c for c in df.columns if base is None or c not in {n for n, _, _ in base.columns}]
        read.extend(own)
        assert base is None or len(own) < len(df.columns) // 2
        return view(self, df, base)

    monkeypatch.setattr(Warehouse, "_viewed", watched)
    wh.build().collect()
    assert not read
    wh.figures()
    assert {"origin_tz", "turn_slack_minutes"} < set(read) and not set(read) & set(wh.airport_daily().columns)
