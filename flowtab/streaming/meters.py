"""Meters and alerts on a live stream of metrics.

Each micro-batch goes through the batch operators, which cut a meter into blocks, so a meter that holds most rows is worked on by many
tasks and no task holds a whole one. What the next micro-batch needs is a small table: of each meter the totals, the last step, its
last ``window - 1`` rows and the rows that wait. Results and this table are published in versions, by the micro-batch's number: one
that is repeated after a failure gives its rows once.

Rows may come out of order over files. A row waits until its meter has shown a step at least ``delay`` above it, and then counts in its place;
a row whose step is not above the last one that counted is late: it is dropped and counted. Of rows with one meter and step that come
together the one with the smallest value counts, the others are late. ``finish`` counts what still waits when a stream has ended. Rows without
a meter, step, value or weight are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import cut, dealt_left
from ..operators.meters import BLOCK, global_average, nonfinite, rolling_meters
from ..sources.versions import Versions

OUTPUT = "meter string, step bigint, median double, mean double, max double, latest double, global_avg double, late bigint"
#: Kinds of rows: ``total`` (value: total, n: count, step: the last one), ``tail`` (the last rows) and ``wait``.
STATE = "kind string, meter string, step bigint, value double, n double, late bigint"


def _advance(rows: DataFrame, state: DataFrame, window: int, delay: int, block: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """Results of the rows that count now, and the next state."""
    totals = state.where("kind = 'total'").select(F.col("meter").alias("__ft_meter"), F.col("step").alias("seen"), F.col("value").alias("total"), F.col("n").alias("count"), "late")
    fresh = rows.select("meter", F.col("step").cast("bigint").alias("step"), F.col("value").cast("double").alias("value"), F.col("n").cast("double").alias("n")).dropna()
    both = fresh.unionByName(state.where("kind = 'wait'").select("meter", "step", "value", "n"))
    # Rows of one meter and step are counted before they are shuffled, however many there are.
    single = both.groupBy("meter", "step").agg(F.min(F.struct("value", "n")).alias("r"), F.count("*").alias("met"))
    placed = dealt_left(single, totals.select("__ft_meter", "seen"), F.col("meter") == F.col("__ft_meter"), F.xxhash64("step")).drop("__ft_meter")
    placed = cut(placed.select("meter", "step", "r.value", "r.n", "met", (F.col("seen").isNull() | (F.col("step") > F.col("seen"))).alias("in_time")))
    shown = placed.where("in_time").groupBy(F.col("meter").alias("__ft_meter")).agg(F.max("step").alias("top"))
    timed = dealt_left(placed, shown, F.col("meter") == F.col("__ft_meter"), F.xxhash64("step")).drop("__ft_meter")
    due = F.lit(True) if last else F.col("step") <= F.col("top") - delay
    ready = cut(timed.where(F.col("in_time") & due).select("meter", "step", "value", "n"))
    waiting = timed.where(F.col("in_time") & ~due).select(F.lit("wait").alias("kind"), "meter", "step", "value", "n", F.lit(0).cast("bigint").alias("late"))
    lost = placed.groupBy("meter").agg(F.sum(F.when(F.col("in_time"), F.col("met") - 1).otherwise(F.col("met"))).alias("lost"))
    gains = ready.groupBy("meter").agg(F.max("step").alias("seen"), F.sum(F.col("value") * F.col("n")).alias("total"), F.sum("n").alias("count"))
    # One row for each meter in all of these.
    old = totals.withColumnRenamed("__ft_meter", "meter")
    parts = [old.select("meter", "seen", "total", "count", "late"), gains.withColumn("late", F.lit(0).cast("bigint")), lost.select("meter", F.lit(None).cast("bigint").alias("seen"), F.lit(0.0).alias("total"), F.lit(0.0).alias("count"), F.col("lost").alias("late"))]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("meter").agg(F.max("seen").alias("seen"), F.sum("total").alias("total"), F.sum("count").alias("count"), F.sum("late").alias("late"))
    next_totals = cut(summed)

    tail = state.where("kind = 'tail'").select("meter", "step", "value", "n")
    long = tail.unionByName(ready)
    rolled = rolling_meters(long, window, block)
    averaged = global_average(ready, block, old.select("meter", "total", "count"))
    late = next_totals.select(F.col("meter").alias("__ft_meter"), "late")
    made = rolled.join(averaged, ["meter", "step"])  # steps of the tail have no average now, so they are left out
    out = dealt_left(made, late, F.col("meter") == F.col("__ft_meter"), F.xxhash64("step"))
    results = out.select("meter", "step", "median", "mean", "max", "latest", "global_avg", "late")

    newest = Window.partitionBy("meter").orderBy(F.desc("step"))
    kept = long.withColumn("__ft_at", F.row_number().over(newest)).where(F.col("__ft_at") < window)
    told = next_totals.select(F.lit("total").alias("kind"), "meter", F.col("seen").alias("step"), F.col("total").alias("value"), F.col("count").alias("n"), "late")
    none = F.lit(0).cast("bigint").alias("late")
    return results, told.unionByName(kept.select(F.lit("tail").alias("kind"), "meter", "step", "value", "n", none)).unionByName(waiting)


def _take(rows: DataFrame, batch: int, path: str, window: int, delay: int, block: int, last: bool = False) -> None:
    """Count one micro-batch, unless it has been counted; or, at last, what waits after it."""
    spark, name = rows.sparkSession, f"{'end' if last else 'batch'} {batch}"
    results, states = Versions(spark, f"{path}/results"), Versions(spark, f"{path}/state")
    known = states.entries().get("state")
    if known and (int(known.meta["batch"]) > batch or known.meta["name"] in (name, f"end {batch}")):
        return
    state = states.read(STATE)
    made, after = _advance(rows, spark.createDataFrame([], STATE) if state is None else state, window, delay, block, last)
    results.publish(name, made, once=True)
    states.publish("state", after, {"batch": batch, "name": name})


def stream_meters(stream: DataFrame, path: str, window: int = 20, delay: int = 0, block: int = BLOCK):
    """A writer that keeps the rolling and global values of each meter below ``path``; start it to run it. ``stream``: ``meter, step, value, n``."""
    return stream.writeStream.foreachBatch(lambda rows, batch: _take(rows, batch, path, window, delay, block))


def finish(spark: SparkSession, path: str, window: int = 20, block: int = BLOCK) -> None:
    """Count the rows that still wait, after a stream has ended."""
    known = Versions(spark, f"{path}/state").entries().get("state")
    if known:
        _take(spark.createDataFrame([], "meter string, step bigint, value double, n double"), int(known.meta["batch"]), path, window, 0, block, True)


def read_meters(spark: SparkSession, path: str) -> DataFrame:
    """Values after each iteration, as the batch operators give them: ``meter, step, median, mean, max, latest, global_avg, late``."""
    found = Versions(spark, f"{path}/results").read(OUTPUT)
    return spark.createDataFrame([], OUTPUT) if found is None else found


def stream_alert(stream: DataFrame, alert: Callable[[DataFrame, int], None]):
    """A writer that hands the rows of each micro-batch whose value is not finite to ``alert``; start it to run it."""
    return stream.where(nonfinite("value")).writeStream.foreachBatch(alert)
