"""Total orders, epochs, shards and batches without a window over the whole table.

A contiguous index is a row's number within its part of a range partitioning plus the rows of all parts before. Parts are
even however the keys are spread (keys settle ties, so a hot class or bucket is split too); only the counts of the parts, one
for each, meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import cut


def global_index(df: DataFrame, keys: Sequence[str], name: str = "idx") -> DataFrame:
    """Add a 0-based index in the order of the keys, which must settle all ties."""
    parted = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__ft_part", F.spark_partition_id())
        .withColumn("__ft_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    parted = cut(parted)  # both uses see the same parts
    counts = parted.groupBy("__ft_part").agg(F.count("*").alias("__ft_n"))
    before = counts.select(
        F.col("__ft_part"), F.coalesce(F.sum("__ft_n").over(Window.orderBy("__ft_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ft_before")
    )
    # One row for each part, so its size is that of the shuffle's partition count.
    joined = parted.join(F.broadcast(before), "__ft_part")
    return joined.withColumn(name, (F.col("__ft_before") + F.col("__ft_at")).cast("bigint")).select(*df.columns, name)


def epoch_shuffle(df: DataFrame, seed: int, epoch: int, key: str = "id", name: str = "idx") -> DataFrame:
    """Add each row's place in the permutation of an epoch, by the MD5 of seed, epoch and key."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")))
    return global_index(df.withColumn("__ft_order", order), ["__ft_order", key], name).drop("__ft_order")


def shard(df: DataFrame, world: int, idx: str = "idx", pad: bool = False) -> DataFrame:
    """Deal rows to ``world`` shards by turns: ``shard`` and the place ``pos`` in it.

    With ``pad`` the first rows are dealt again until all shards are even, as training plans want.
    """
    out = df
    if pad:
        n = df.count()
        short = -n % world
        if n and short:
            again = F.explode(F.sequence(F.lit(0), F.lit((short - 1) // n)))
            extra = df.withColumn("__ft_turn", again).withColumn(idx, F.col(idx) + n * (F.col("__ft_turn") + 1)).where(F.col(idx) < n + short).drop("__ft_turn")
            out = df.unionByName(extra)
    return out.withColumn("shard", (F.col(idx) % world).cast("int")).withColumn("pos", F.floor(F.col(idx) / world).cast("bigint"))


def batch(df: DataFrame, size: int, drop_last: bool) -> DataFrame:
    """Number the batches within each shard; ``drop_last`` leaves out the ragged one."""
    out = df.withColumn("batch", F.floor(F.col("pos") / size).cast("bigint"))
    if not drop_last:
        return out
    full = out.groupBy("shard").agg(F.floor(F.count("*") / size).alias("__ft_full"))
    return out.join(full, "shard").where(F.col("batch") < F.col("__ft_full")).select(*out.columns)


def label_plan(df: DataFrame, classes: int, idx: str = "idx", num: int | None = None, even: bool = True) -> DataFrame:
    """Equal images for each class, in class order, over rows numbered from 0; ``num`` must divide evenly.

    With ``even`` False any ``num`` will do: the rows left over are numbered on from ``classes``; where there are fewer rows than classes, all are null.
    """
    num = df.count() if num is None else num
    if num % classes and even:
        raise ValueError(f"{num} images cannot be dealt evenly to {classes} classes")
    each = num // classes
    return df.withColumn("label", F.floor(F.col(idx) / each).cast("int") if each else F.lit(None).cast("int"))


def generation_plan(df: DataFrame, batch_size: int, world: int, idx: str = "idx") -> DataFrame:
    """Where image ``idx`` is made: ``step``, ``rank`` and ``slot`` with idx = world * batch * step + rank * batch + slot."""
    i, block = F.col(idx), batch_size * world
    return (
        df.withColumn("step", F.floor(i / block).cast("bigint"))
        .withColumn("rank", F.floor(i % block / batch_size).cast("int"))
        .withColumn("slot", (i % batch_size).cast("int"))
    )
