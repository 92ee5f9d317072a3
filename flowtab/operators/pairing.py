"""Matching condition files to target files, and classes to numbers.

Listings have a column ``rel``: the path below their root, with ``/`` between components. Paths are ordered by component, and of
several files with one key the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import HOT, cut, hot_left


def path_order(rel: Column | str) -> Column:
    """Sort key: the components of a path."""
    return F.split(F.col(rel) if isinstance(rel, str) else rel, "/")


def split_path(df: DataFrame, rel: str = "rel") -> DataFrame:
    """Add ``rel_stem`` (without the last suffix), ``stem`` (its file name) and ``class_name`` (first folder, or null)."""
    path = F.col(rel)
    stem = F.regexp_replace(path, r"([^/])\.[^./]+$", "$1")
    return (
        df.withColumn("rel_stem", stem)
        .withColumn("stem", F.element_at(F.split(stem, "/"), -1))
        .withColumn("class_name", F.when(F.contains(path, F.lit("/")), F.element_at(F.split(path, "/"), 1)))
    )


def pair_images(cond: DataFrame, target: DataFrame, share: int = HOT) -> DataFrame:
    """Each condition once, with its target by the first tier that has one.

    Tiers: the same path; the same path without extension; the same file stem anywhere. Adds ``target_rel`` (null without a
    match) and ``match_tier``. The target side has one row for each key before it is joined, and moves once; the conditions of a key that has
    more than ``share`` of them are dealt to several tasks, each with that key's target.
    """
    sides = split_path(target.select("rel"))
    last = F.max_by("rel", path_order("rel"))
    out = split_path(cond)
    for tier, key in enumerate(("rel", "rel_stem", "stem"), 1):
        keyed = sides.groupBy(F.col(key).alias(f"__ft_k{tier}")).agg(last.alias(f"__ft_t{tier}"))
        out = hot_left(out, keyed, F.col(key), F.col(f"__ft_k{tier}"), F.xxhash64("rel", F.lit(tier)), share)
    found = [F.col(f"__ft_t{t}") for t in (1, 2, 3)]
    tier = F.when(found[0].isNotNull(), 1).when(found[1].isNotNull(), 2).when(found[2].isNotNull(), 3)
    return out.withColumn("target_rel", F.coalesce(*found)).withColumn("match_tier", tier).select(*cond.columns, "target_rel", "match_tier")


def unpaired(pairs: DataFrame) -> DataFrame:
    """One row: ``missing`` and ``first_missing`` in path order; null if all are matched."""
    gone = pairs.where("target_rel is null")
    return gone.agg(F.count("*").alias("missing"), F.min_by("rel", path_order("rel")).alias("first_missing"))


def check_pairs(pairs: DataFrame) -> DataFrame:
    """The matched pairs; an error where there are no conditions or none is matched. The joins run once, for count and result."""
    pairs = cut(pairs)
    total, matched = pairs.agg(F.count("*"), F.count("target_rel")).first()
    if not total:
        raise ValueError("no condition images")
    if not matched:
        raise ValueError("no condition image has a target")
    return pairs.where("target_rel is not null")


def self_pair(cond: DataFrame) -> DataFrame:
    """Without a target folder each condition stands for its own target, and is marked as having none."""
    return cond.withColumn("target_rel", F.col("rel")).withColumn("has_target", F.lit(False))


def class_index(df: DataFrame, class_col: str = "class_name", name: str = "label") -> DataFrame:
    """Number the classes from 0 in the order of their names.

    The window runs over the distinct classes only. Whether they are broadcast is left to Spark, which knows their size.
    """
    classes = df.select(F.col(class_col).alias("__ft_class")).where("__ft_class is not null").distinct()
    numbered = classes.withColumn(name, (F.row_number().over(Window.orderBy("__ft_class")) - 1).cast("int"))
    return df.join(numbered, F.col(class_col) == F.col("__ft_class"), "left").drop("__ft_class")


def compare_tables(restored: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Predictions beside their targets, by id: ``id, pred, target``."""
    return restored.select(key, F.col("pixels").alias("pred")).join(target.select(key, F.col("pixels").alias("target")), key)
