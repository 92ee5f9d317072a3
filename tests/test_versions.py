"""Versions, logs and snapshots during and after failed writes; live meters on one file and on many."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from flowtab.operators import meters
from flowtab.sources import sinks, versions
from flowtab.streaming import meters as streams

ROWS = "name string, idx bigint, value double"


def broken(df):
    return df.withColumn("value", F.when(F.col("idx") == 3, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))


def snapshot(spark, value, n=5):
    return spark.createDataFrame([("w", i, float(value)) for i in range(n)], ROWS)


def values(df):
    return sorted(r.value for r in df.select("value").collect())


def test_readers_see_whole_versions_alone(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert sinks.resume_epoch(spark, path) == 0
    with pytest.raises(ValueError):
        sinks.read_snapshot(spark, path)
    sinks.write_snapshot(snapshot(spark, 1), path, 0)
    open_reader = sinks.read_snapshot(spark, path)
    with pytest.raises(Exception, match="lost"):
        sinks.write_snapshot(broken(snapshot(spark, 2)), path, 1)
    assert values(sinks.read_snapshot(spark, path)) == [1.0] * 5 and sinks.resume_epoch(spark, path) == 1
    # While a write is under way, and a reader from before it after that.
    seen = []
    gate = threading.Event()

    def write():
        sinks.write_snapshot(snapshot(spark, 3).withColumn("value", F.col("value")), path, 2)
        gate.set()

    writer = threading.Thread(target=write)
    writer.start()
    while not gate.is_set():
        seen.append(tuple(values(sinks.read_snapshot(spark, path))))
    writer.join()
    assert set(seen) <= {(1.0,) * 5, (3.0,) * 5}
    assert values(sinks.read_snapshot(spark, path)) == [3.0] * 5 and values(open_reader) == [1.0] * 5
    sinks.write_snapshot(snapshot(spark, 9), path, 2, "milestone")
    assert values(sinks.read_snapshot(spark, path)) == [3.0] * 5 and values(sinks.read_snapshot(spark, path, "milestone")) == [9.0] * 5


def test_a_repeated_batch_is_logged_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("loss", 1.5, 1), ("psnr", 20.0, 1)], "tag string, value double, step int")
    assert sinks.read_metric_log(spark, path).count() == 0
    for _ in range(3):
        sinks.write_metric_log(rows, path, batch=7)
    assert sinks.read_metric_log(spark, path).count() == 2
    sinks.write_metric_log(rows, path, batch="8")
    sinks.write_metric_log(rows, path)
    sinks.write_metric_log(rows, path)
    assert sinks.read_metric_log(spark, path).count() == 8
    with pytest.raises(Exception, match="lost"):
        sinks.write_metric_log(rows.withColumn("value", F.raise_error(F.lit("lost")).cast("double")), path, batch=9)
    assert sinks.read_metric_log(spark, path).count() == 8
    sinks.write_metric_log(rows, path, batch=9)
    got = sinks.read_metric_log(spark, path)
    assert got.count() == 10 and "PartitionFilters: [isnotnull(tag" in got.where("tag = 'loss'")._jdf.queryExecution().toString()


def test_two_writers_and_many_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "KEPT", 3)
    table = versions.Versions(spark, str(tmp_path / "t"))
    df = spark.range(1)
    assert table.read() is None
    # One that finds its number taken goes behind.
    state, stale = table._state, []
    monkeypatch.setattr(table, "_state", lambda: stale.pop() if stale else state())
    for i in range(8):
        stale.append((max(0, i - 1), {}) if i else (0, {}))
        assert table.publish(f"k{i % 5}", df.select(F.lit(i).alias("i")), {"i": i})
    assert {k: e.meta["i"] for k, e in table.entries().items()} == {"k0": "5", "k1": "6", "k2": "7", "k3": "3", "k4": "4"}
    assert sorted(r.i for r in table.read().collect()) == [3, 4, 5, 6, 7]
    assert [r.i for r in table.read(keys=["k1", "none"]).collect()] == [6]
    assert not table.publish("k1", df.select(F.lit(0).alias("i")), once=True)
    assert table.vacuum() == 0 and table.vacuum(0) == 3
    assert sorted(r.i for r in table.read().collect()) == [3, 4, 5, 6, 7]


def live(spark, tmp_path, rows, files, **how):
    """Rows dealt over files, a micro-batch each, as a stream to its end."""
    schema = "meter string, step bigint, value double, n int"
    for i, part in enumerate(files):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    run = lambda: streams.stream_meters(stream, path, **how).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    run()
    return path, run


def shown(df):
    return sorted((r.meter, r.step, r.median, round(r["mean"], 9), r["max"], r.latest, round(r.global_avg, 9)) for r in df.collect())


ROWS_LIVE = [("a" if i % 3 else "b", i, float(i * 7 % 11), 1 + i % 2) for i in range(90)]


def wanted(spark, rows, window):
    batch = spark.createDataFrame(rows, "meter string, step bigint, value double, n int")
    return shown(meters.rolling_meters(batch, window).join(meters.global_average(batch), ["meter", "step"]))


def test_one_file_is_the_batch_operators(spark, tmp_path):
    path, _ = live(spark, tmp_path, ROWS_LIVE, [range(90)], window=7, block=8)
    got = streams.read_meters(spark, path)
    assert shown(got) == wanted(spark, ROWS_LIVE, 7) and got.agg(F.max("late")).first()[0] == 0


def test_files_out_of_order_wait(spark, tmp_path):
    """Steps up to ten places out of order over four files: all count, in their places; one beyond that and doubled ones are late."""
    rng = random.Random(3)
    order = sorted(range(90), key=lambda i: i + rng.uniform(0, 10))
    files = [order[:25], order[25:50], order[50:75], order[75:]]
    rows = [*ROWS_LIVE, ("a", 1, 5.0, 1), ("a", 88, 99.0, 1)]
    path, run = live(spark, tmp_path, rows, [*files[:3], [*files[3], 90, 91]], window=5, delay=12, block=16)
    before = streams.read_meters(spark, path).count()
    streams.finish(spark, path, window=5)
    streams.finish(spark, path, window=5)
    got = streams.read_meters(spark, path)
    assert shown(got) == wanted(spark, ROWS_LIVE, 5) and before < 90
    assert {r.meter: r.m for r in got.groupBy("meter").agg(F.max("late").alias("m")).collect()} == {"a": 2, "b": 0}
    # The stream goes on after that.
    spark.createDataFrame([("a", 100, 1.0, 1)], "meter string, step bigint, value double, n int").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    streams.finish(spark, path, window=5)
    assert streams.read_meters(spark, path).count() == 91


def test_late_rows_without_delay_and_repeated_batches(spark, tmp_path):
    rows = [*ROWS_LIVE, ("a", 5, 1.0, 1), ("a", 5, 2.0, 1), ("c", None, 1.0, 1), (None, 3, 1.0, 1)]
    path, _ = live(spark, tmp_path, rows, [range(60), [*range(60, 90), 90, 91, 92, 93]], window=6)
    got = streams.read_meters(spark, path)
    assert shown(got) == wanted(spark, ROWS_LIVE, 6)
    assert {r.meter: r.m for r in got.groupBy("meter").agg(F.max("late").alias("m")).collect()} == {"a": 2, "b": 0}
    # A micro-batch that comes again changes nothing, whether its state was published or its rows alone.
    again = spark.createDataFrame(rows[60:92], "meter string, step bigint, value double, n int")
    streams._take(again, 1, path, 6, 0, 16)
    assert shown(streams.read_meters(spark, path)) == shown(got)
    states = versions.Versions(spark, f"{path}/state")
    number = states.entries()["state"].number
    states._context.delete(states._at(f"{versions._LIST}/{number:020d}.json"), False)
    streams._take(again, 1, path, 6, 0, 16)
    assert shown(streams.read_meters(spark, path)) == shown(got) and states.entries()["state"].meta["batch"] == "1"
