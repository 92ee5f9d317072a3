"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of one Arrow batch sent to a Python worker, so that long texts cannot fill its memory.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes where the session does not set them itself."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def use_checkpoints(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and tables that later steps read: ``spark.checkpoint.dir``.

    An error where neither the session nor its context names one: a folder of the driver alone is no shared one.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that later steps read again."""
    return f"{use_checkpoints(spark).rstrip('/')}/flowtab-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage is the files."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def row_key(text: Column) -> Column:
    """SHA-256 of a text (null: empty). Tells apart rows of one id that have different texts; equal rows get equal keys."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


#: Ways in which the rows of one key are dealt out in a salted join.
SALTS = 16


def salted_left(left: DataFrame, right: DataFrame, left_key: str, right_key: str, salt: Column) -> DataFrame:
    """Left join on one key, hot keys of the left side dealt to ``SALTS`` tasks by ``salt``, a hash of what tells its rows apart.

    For a right side that has few rows against the left one, as each of them is sent ``SALTS`` times.
    """
    dealt = left.withColumn("__ft_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    copies = right.withColumn("__ft_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = dealt.join(copies, (F.col(left_key) == F.col(right_key)) & (F.col("__ft_salt") == F.col("__ft_copy")), "left")
    return joined.drop("__ft_salt", "__ft_copy")


#: Bits of a key filter for each key, places set for one, and the largest filter that is sent to tasks (16 MB).
BITS_EACH, PLACES, FILTER_BITS = 12, 6, 1 << 27


def _filter_word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(words)).cast("int")


def _filter_mask(key: Column, places: int) -> Column:
    """The places of a key, all in its word of 64 bits: each by six bits of a second hash."""

    def marked(h: Column) -> Column:
        bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(places)]
        return reduce(Column.bitwiseOR, bits)

    h = F.xxhash64(F.lit(1), key)
    return marked(h) if places == 1 else F.transform(F.array(h), marked)[0]


def key_filter(keys: DataFrame, key: str, most_bits: int = FILTER_BITS, places: int = PLACES) -> tuple[Column, int] | None:
    """A Bloom filter of a column's values, sized by their number, and its words; None where it would be larger than ``most_bits``.

    The filter is a scalar subquery: as a literal, every text of a plan that has it would spell it out, and the driver keeps many.
    """
    import numpy as np

    spark = keys.sparkSession
    words = max(64, 1 << (BITS_EACH * max(1, keys.count()) - 1).bit_length()) // 64
    if 64 * words > most_bits:
        return None
    masks = keys.groupBy(_filter_word(F.col(key), words).alias("word")).agg(F.bit_or(_filter_mask(F.col(key), places)).alias("mask")).toArrow()
    out = np.zeros(words, "<i8")
    out[masks["word"].to_numpy()] = masks["mask"].to_numpy()
    whole = pa.table({"words": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(out))})
    return spark.createDataFrame(whole).repartition(1).scalar(), words


def may_hold(found: tuple[Column, int], key: Column, places: int = PLACES) -> Column:
    """Whether a key may be in the filter of as many places: true for all that are, and for some hundredths of others."""
    data, words = found
    mask = _filter_mask(key, places)
    return F.get(data, _filter_word(key, words)).bitwiseAND(mask) == mask


def dealt_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, salt: Column, share: int = 256) -> DataFrame:
    """Left join on one key: rows of ``left`` with a key of more than ``share`` rows are dealt to tasks, each with a copy of the right row.

    For right rows that are large or many, as only those of hot keys are sent more than once. ``right`` has each key once.
    """
    hot = left.groupBy(F.col(left_key).alias("__ft_hot")).agg(F.floor((F.count("*") - 1) / share).alias("__ft_more")).where("__ft_more > 0").checkpoint()
    dealt = salted_left(left, hot, left_key, "__ft_hot", salt).withColumn("__ft_part", F.pmod(F.hash(salt), F.coalesce("__ft_more", F.lit(0)) + 1)).drop("__ft_hot", "__ft_more")
    copies = right.join(hot, F.col(right_key) == F.col("__ft_hot"), "left").withColumn("__ft_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__ft_more", F.lit(0)))))
    copies = copies.drop("__ft_hot", "__ft_more")
    return dealt.join(copies, (F.col(left_key) == F.col(right_key)) & (F.col("__ft_part") == F.col("__ft_copy")), "left").drop("__ft_part", "__ft_copy")


def per_row(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """Map rows to rows in Arrow batches.

    ``make()`` runs once in each task and returns a function of the columns' values that gives one
    tuple, in the order of ``schema``. Columns that are not named never leave the JVM.
    """
    spark = df.sparkSession
    bound_batches(spark)
    names = [f"c{i}" for i in range(len(columns))]
    target = spark.createDataFrame([], schema).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, one = to_arrow_schema(target), make()
        for batch in batches:
            rows = [one(*values) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out
                )
        pa.default_memory_pool().release_unused()  # workers are used again, by tasks of other kinds

    return df.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))).mapInArrow(run, target)
