"""Training meters: rows ``meter, step, value, n`` (and ``rank``), smoothed with windows.

A meter may hold a third of all rows, so no window spans a whole meter. Rows are numbered in the order of (meter, step) and cut
into blocks of equal size; a sliding window gets the few rows before its block as context, a running total the sums of the
blocks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import global_index

#: Rows of one block.
BLOCK = 1 << 17


def drop_nulls_check_numeric(df: DataFrame, value: str = "value") -> DataFrame:
    """Leave out nulls; a value that is no number is an error."""
    number = F.expr(f"try_cast(`{value}` AS double)")
    checked = F.when(number.isNull(), F.raise_error(F.concat(F.lit("not a number: "), F.col(value).cast("string"))).cast("double")).otherwise(number)
    return df.where(F.col(value).isNotNull()).withColumn(value, checked)


def nonfinite(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.isnan(v) | (F.abs(v) == float("inf"))


def nonfinite_guard(df: DataFrame, *by: str) -> DataFrame:
    """The first step whose value is not finite, in each group that has one."""
    return df.where(nonfinite("value")).groupBy(*by).agg(F.min("step").alias("first_bad_step"), F.count("*").alias("bad"))


def lower_median(values: Column) -> Column:
    """The middle value; of an even number the lower of both."""
    return F.element_at(F.array_sort(values), F.floor((F.size(values) + 1) / 2).cast("int"))


def _blocks(df: DataFrame, by: str, context: int, size: int) -> DataFrame:
    """Number the rows and add ``__ft_block``; each block also gets the ``context`` rows before it, marked ``__ft_extra``."""
    numbered = global_index(df, [by, "step"], "__ft_i")
    block = F.floor(F.col("__ft_i") / size)
    # A row belongs to its block, and is context for the next one if that begins within ``context`` rows.
    later = F.when((F.col("__ft_i") % size) >= size - context, F.array(block, block + 1)).otherwise(F.array(block))
    return numbered.withColumn("__ft_own", block).withColumn("__ft_block", F.explode(later)).withColumn("__ft_extra", F.col("__ft_block") != F.col("__ft_own"))


def _totals_before(blocks: DataFrame, by: str, **sums: Column) -> DataFrame:
    """Per (meter, block): the meter's sums over all earlier blocks. There is one row for each meter and block."""
    each = blocks.where("not __ft_extra").groupBy(by, "__ft_block").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    w = Window.partitionBy(by).orderBy("__ft_block").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(by, "__ft_block", *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums))


def rolling_meters(df: DataFrame, window: int = 20, block: int = BLOCK) -> DataFrame:
    """Median, mean, maximum and latest value over the last ``window`` steps of each meter."""
    blocks = _blocks(df.select("meter", "step", "value"), "meter", window - 1, max(block, window))
    w = Window.partitionBy("__ft_block", "meter").orderBy("step").rowsBetween(-(window - 1), 0)
    values = F.collect_list("value").over(w)
    out = blocks.select("meter", "step", "__ft_extra", lower_median(values).alias("median"), F.avg("value").over(w).alias("mean"), F.max("value").over(w).alias("max"), F.col("value").alias("latest"))
    return out.where("not __ft_extra").drop("__ft_extra")


def global_average(df: DataFrame, block: int = BLOCK, base: DataFrame | None = None) -> DataFrame:
    """Weighted mean of all values of a meter so far, at each step. ``base``: ``meter, total, count`` of what came before ``df``."""
    weighed = df.select("meter", "step", (F.col("value") * F.col("n")).alias("x"), F.col("n").alias("m"))
    blocks = _blocks(weighed, "meter", 0, block)
    before = _totals_before(blocks, "meter", bx=F.col("x"), bm=F.col("m"))
    w = Window.partitionBy("__ft_block", "meter").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    inside = blocks.select("meter", "step", "__ft_block", F.sum("x").over(w).alias("x"), F.sum("m").over(w).alias("m"))
    if base is not None:
        # A row for each meter and block on the left, one for each meter on the right.
        first = base.select("meter", F.col("total").alias("__ft_total"), F.col("count").alias("__ft_count"))
        known = before.join(first, "meter", "left")
        before = known.select("meter", "__ft_block", *((F.col(c) + F.coalesce(f, F.lit(0))).alias(c) for c, f in (("bx", "__ft_total"), ("bm", "__ft_count"))))
    return inside.join(before, ["meter", "__ft_block"]).select("meter", "step", ((F.col("bx") + F.col("x")) / (F.col("bm") + F.col("m"))).alias("global_avg"))


def merge_shards(df: DataFrame) -> DataFrame:
    """Count, total and mean of each meter over all workers."""
    out = df.groupBy("meter").agg(F.sum("n").alias("count"), F.sum(F.col("value") * F.col("n")).alias("total"))
    return out.withColumn("global_avg", F.col("total") / F.col("count"))


def cross_rank_mean(df: DataFrame) -> DataFrame:
    """Unweighted mean over the ranks at each step."""
    return df.groupBy("meter", "step").agg(F.avg("value").alias("value"), F.count("*").alias("ranks"))


def thin_log(df: DataFrame, freq: int, steps_per_epoch: int, step: str = "step") -> DataFrame:
    """Every ``freq``-th iteration, with an x axis of thousandths of an epoch."""
    i, epoch = F.col(step) % steps_per_epoch, F.floor(F.col(step) / steps_per_epoch)
    return df.where(i % freq == 0).withColumn("x", F.floor((i / steps_per_epoch + epoch) * 1000).cast("bigint"))


def progress(df: DataFrame, freq: int, by: str = "meter", block: int = BLOCK) -> DataFrame:
    """Iteration time, its running mean and the time left, at every ``freq``-th row and the last of each run.

    ``df``: ``step, ts`` (an iteration's end) and the run's column; with ``loaded`` (when its data had come) also the wait for data and
    its running mean. Seconds; the first row's time is unknown, and so counts for nothing. The time left is that of all iterations
    not yet done when this one began. ``total_s`` and ``s_per_it`` are so far; at the last row they are the run's.
    """
    waits = "loaded" in df.columns
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    came = F.unix_micros(F.col("loaded").cast("timestamp")) / 1e6 if waits else F.lit(None).cast("double")
    blocks = _blocks(df.select(by, "step", seconds.alias("s"), came.alias("came")), by, 1, max(2, block))
    w = Window.partitionBy("__ft_block", by).orderBy("step")
    wait = F.when(F.col("came").isNotNull() & F.lag("s").over(w).isNotNull(), F.greatest(F.lit(0.0), F.col("came") - F.lag("s").over(w)))
    timed = blocks.withColumns({"iter_s": F.col("s") - F.lag("s").over(w), "data_s": wait}).where("not __ft_extra")
    each = timed.groupBy(by, "__ft_block").agg(F.count("*").alias("n"), F.sum("iter_s").alias("t"), F.count("iter_s").alias("k"), F.sum("data_s").alias("d"))
    earlier = Window.partitionBy(by).orderBy("__ft_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.select(
        by, "__ft_block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"b{c}") for c in ("n", "t", "k", "d")), F.sum("n").over(Window.partitionBy(by)).alias("rows")
    )
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    inside = timed.select(by, "step", "__ft_block", "iter_s", "data_s", F.sum("data_s").over(sofar).alias("d"), F.count("*").over(sofar).alias("i"), F.sum("iter_s").over(sofar).alias("t"), F.count("iter_s").over(sofar).alias("k"))
    out = (
        inside.join(sums, [by, "__ft_block"])
        .withColumn("iteration", (F.col("bn") + F.col("i") - 1).cast("bigint"))
        .withColumn("mean_s", (F.col("bt") + F.coalesce("t", F.lit(0.0))) / F.nullif(F.col("bk") + F.col("k"), F.lit(0)))
        .withColumn("mean_data_s", (F.col("bd") + F.coalesce("d", F.lit(0.0))) / F.nullif(F.col("bk") + F.col("k"), F.lit(0)))
        .withColumn("eta_s", F.col("mean_s") * (F.col("rows") - F.col("iteration")))
        .withColumn("total_s", F.col("bt") + F.coalesce("t", F.lit(0.0)))
        .withColumn("s_per_it", F.col("total_s") / (F.col("iteration") + 1))
    )
    shown = (F.col("iteration") % freq == 0) | (F.col("iteration") == F.col("rows") - 1)
    return out.where(shown).select(by, "step", "iteration", "iter_s", "mean_s", "eta_s", *(["data_s", "mean_data_s"] if waits else []), "total_s", "s_per_it")


def format_meters(df: DataFrame, delimiter: str = "  ") -> DataFrame:
    """One line ``name: median (global)`` of all meters, by name. ``df``: ``meter, median, global_avg``, one row each."""
    each = F.struct("meter", F.format_string("%s: %.4f (%.4f)", "meter", "median", "global_avg").alias("s"))
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda s: s["s"]), delimiter).alias("line"))
