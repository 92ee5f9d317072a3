"""Noised training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.rand import hash_normal, hash_uniform


def label_dropout(df: DataFrame, p: float, null_class: int, seed: int, training: bool = True) -> DataFrame:
    """Replace ``label`` by the null class with probability p, in training only."""
    if p <= 0 or not training:
        return df
    return df.withColumn("label", F.when(hash_uniform(f"{seed}:drop", F.col("id")) < p, null_class).otherwise(F.col("label")).cast("int"))


def sample_t(df: DataFrame, seed: int, mean: float = -0.8, std: float = 0.8) -> DataFrame:
    """Add a logit-normal time ``t``."""
    return df.withColumn("t", 1.0 / (1.0 + F.exp(-(hash_normal(f"{seed}:t", F.col("id")) * std + mean))))


def noise(like: Column | str, scale: float, seed: int) -> Column:
    """Normal noise, one number per entry of an array, by the row's ``id``."""
    px = F.col(like) if isinstance(like, str) else like
    return F.transform(px, lambda _, i: scale * hash_normal(f"{seed}:noise", F.col("id"), i))


def add_noise_source(df: DataFrame, seed: int, scale: float = 1.0, like: str = "target") -> DataFrame:
    """Add a ``source`` of pure noise."""
    return df.withColumn("source", noise(like, scale, seed))


def bridge_source(df: DataFrame, seed: int, mode: str = "condition", bridge_noise: float = 0.0, noise_scale: float = 1.0) -> DataFrame:
    """Add a ``source``: the condition (with noise, if asked for), or noise alone."""
    if mode == "noise":
        return add_noise_source(df, seed, noise_scale, "condition")
    if mode != "condition":
        raise ValueError(f"unknown bridge mode: {mode}")
    made = F.col("condition") if bridge_noise <= 0 else A.add("condition", noise("condition", bridge_noise, seed))
    return df.withColumn("source", made)


def make_training_examples(
    df: DataFrame,
    task: str = "generation",
    seed: int = 0,
    null_class: int = 10,
    drop: float = 0.1,
    noise_scale: float = 1.0,
    mode: str = "condition",
    bridge_noise: float = 0.0,
    t_mean: float = -0.8,
    t_std: float = 0.8,
    eps: float = 0.05,
) -> DataFrame:
    """Add ``t, source, z, v`` to rows with ``id, label, target`` (and ``condition``): one projection, no shuffle."""
    if task not in ("generation", "restoration"):
        raise ValueError(f"unknown task: {task}")
    out = sample_t(label_dropout(df, drop, null_class, seed), seed, t_mean, t_std)
    out = add_noise_source(out, seed, noise_scale) if task == "generation" else bridge_source(out, seed, mode, bridge_noise, noise_scale)
    return out.withColumn("z", A.interpolate("target", "source", F.col("t"))).withColumn("v", A.velocity("target", "z", F.col("t"), eps))
