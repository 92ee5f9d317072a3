"""Joins that keep a hot key out of one task, and the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ways in which the rows of one key are dealt out.
WAYS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. An error where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the shared folder, so that what follows does not run it again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def dealt_left(left: DataFrame, right: DataFrame, on: Column, salt: Column) -> DataFrame:
    """Left join on a condition of equal keys; rows of one key are dealt to ``WAYS`` tasks by ``salt``, a hash of what tells them apart.

    ``right`` has few rows against ``left``, each key once; each of its rows is sent ``WAYS`` times (or once to all, where Spark
    finds it small enough to broadcast).
    """
    dealt = left.withColumn("__ft_salt", F.pmod(salt, F.lit(WAYS)).cast("int"))
    copies = right.withColumn("__ft_copy", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    return dealt.join(copies, on & (F.col("__ft_salt") == F.col("__ft_copy")), "left").drop("__ft_salt", "__ft_copy")


#: Rows of one key from which on it is hot.
HOT = 100_000


def hot_left(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, salt: Column, share: int = HOT) -> DataFrame:
    """Left join on one key, for right sides that are large: only rows of hot keys are dealt, and only those keys' right rows are copied.

    Keys of more than ``share`` left rows are counted first, in tasks before the shuffle; they are fewer than rows / ``share``. Where there
    are none this is a plain join. ``right`` has each key once; ``salt`` is a hash of what tells the rows of one key apart.
    """
    counted = left.groupBy(left_key.alias("__ft_hot")).agg(F.count("*").alias("__ft_n")).where((F.col("__ft_n") > share) & F.col("__ft_hot").isNotNull())
    hot = cut(counted.select("__ft_hot", F.ceil(F.col("__ft_n") / share).alias("__ft_parts")))
    if hot.isEmpty():
        return left.join(right, left_key == right_key, "left")
    parts = F.coalesce("__ft_parts", F.lit(1))
    dealt = dealt_left(left, hot, left_key == F.col("__ft_hot"), salt).withColumn("__ft_part", F.pmod(F.xxhash64(salt), parts)).drop("__ft_hot", "__ft_parts")
    copies = right.join(hot, right_key == F.col("__ft_hot"), "left").withColumn("__ft_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("__ft_hot", "__ft_parts")
    return dealt.join(copies, (left_key == right_key) & (F.col("__ft_part") == F.col("__ft_copy")), "left").drop("__ft_part", "__ft_copy")
