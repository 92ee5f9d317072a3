"""Schedules and parameter tables: ``name, idx, value`` by step, and ``name, shape, trainable``."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import dealt_left


def learning_rate(df: DataFrame, lr: float, min_lr: float, warmup: float, epochs: float, schedule: str = "constant", epoch: str = "epoch") -> DataFrame:
    """Add ``lr`` for a fractional epoch: linear warm-up from 0, then constant or a half cosine down to ``min_lr``."""
    if schedule not in ("constant", "cosine"):
        raise ValueError(f"unknown schedule: {schedule}")
    e = F.col(epoch)
    after = F.lit(float(lr)) if schedule == "constant" else min_lr + (lr - min_lr) * 0.5 * (1.0 + F.cos(math.pi * (e - warmup) / (epochs - warmup)))
    return df.withColumn("lr", F.when(e < warmup, lr * e / warmup if warmup else F.lit(0.0)).otherwise(after))


def parameter_groups(df: DataFrame, weight_decay: float, skip: Iterable[str] = ()) -> DataFrame:
    """Trainable parameters with ``decay``: none for vectors, biases, names in ``skip`` or of the diffusion loss."""
    name = F.col("name")
    plain = (F.size("shape") == 1) | name.endswith(".bias") | name.isin(*skip) | name.contains("diffloss")
    return df.where("trainable").withColumn("decay", F.when(plain, 0.0).otherwise(float(weight_decay)))


def attach_group_config(params: DataFrame, groups: DataFrame, key: str = "decay") -> DataFrame:
    """Settings of each parameter's group beside it; ``groups`` has one row for each group, and Spark broadcasts it if small."""
    return params.join(groups, key, "left")


def group_lr(df: DataFrame) -> DataFrame:
    """``lr`` times the group's ``lr_scale``, where it has one."""
    return df.withColumn("lr", F.col("lr") * F.coalesce("lr_scale", F.lit(1.0)))


def overlay_params(base: DataFrame, ema: DataFrame) -> DataFrame:
    """Averaged values in place of the base's, by name and index; values without an average stay."""
    e = ema.select("name", "idx", F.col("value").alias("__ft_value"))
    return base.join(e, ["name", "idx"], "left").withColumn("value", F.coalesce("__ft_value", "value")).drop("__ft_value")


#: Most steps of one block of an average.
BLOCK = 1 << 16


def emas(df: DataFrame, **decays: float) -> DataFrame:
    """Exponential averages of each value over its steps 0..n, in closed form: any order, partial sums, no join.

    Step k of 0..n counts (1 - d) d^(n - k) in the end, and the first d^n. Steps are added up in blocks, relative to the block's end; the blocks
    of a value, few even for very many steps, are brought to the last step when they meet. A block is short enough that powers of d neither
    vanish nor overflow in it.
    """
    small = min((d for d in decays.values() if 0 < d < 1), default=1.0)
    block = 1 if any(d <= 0 for d in decays.values()) else max(1, min(BLOCK, int(300 / -math.log(small)))) if small < 1 else BLOCK
    end = (F.floor(F.col("step") / block) + 1) * block - 1
    weight = lambda d: F.when(F.col("step") == 0, 1.0).otherwise(1.0 - d) * F.pow(F.lit(float(d)), end - F.col("step"))
    blocks = df.groupBy("name", "idx", end.alias("__ft_end")).agg(F.max("step").alias("__ft_last"), *(F.sum(F.col("value") * weight(d)).alias(n) for n, d in decays.items()))
    met = blocks.groupBy("name", "idx").agg(F.max("__ft_last").alias("__ft_last"), F.collect_list(F.struct("__ft_end", *decays)).alias("__ft_blocks"))
    total = lambda n, d: F.aggregate("__ft_blocks", F.lit(0.0), lambda a, b: a + b[n] * F.pow(F.lit(float(d)), F.col("__ft_last") - b["__ft_end"]))
    return met.select("name", "idx", *(total(n, d).alias(n) for n, d in decays.items()))


def ema(df: DataFrame, decay: float, name: str = "ema") -> DataFrame:
    return emas(df, **{name: decay})


def two_emas(df: DataFrame, first: float = 0.9999, second: float = 0.9996) -> DataFrame:
    """Both averages in one pass."""
    return emas(df, ema1=first, ema2=second)


def parameter_count(df: DataFrame) -> DataFrame:
    """Elements of the trainable parameters, in millions."""
    size = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x)
    return df.where("trainable").agg((F.sum(size) / 1e6).alias("millions"))


def lookup_embedding(df: DataFrame, table: DataFrame) -> DataFrame:
    """The table's vector for each label; the null class is a row of the table like any other."""
    vectors = table.select(F.col("label").alias("__ft_label"), "vec")
    return dealt_left(df, vectors, F.col("label") == F.col("__ft_label"), F.xxhash64("id")).drop("__ft_label")
