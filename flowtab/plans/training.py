"""Training examples from end to end: images of class folders, or pairs, to the batches of an epoch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.flow import make_training_examples
from ..operators.images import halving_center_crop, prepare_pairs, random_hflip
from ..operators.order import batch, epoch_shuffle, shard
from ..sources.images import read_images, read_labeled_images, relative


def read_training_images(spark: SparkSession, root: str) -> DataFrame:
    """``id, label, h, w, c, pixels`` (0..255) of the class folders of ``<root>/train``; the id is the path below that folder.

    Classes are numbered from the whole listing; files that cannot be decoded are left out.
    """
    train = f"{root.rstrip('/')}/train"
    listed = read_labeled_images(spark, root).select(F.col("rel").alias("id"), "label")
    pixels = read_images(spark, train).select(relative("path", train).alias("id"), "h", "w", "c", F.col("pixels").cast("array<double>").alias("pixels"))
    return pixels.join(listed, "id")


def epoch_plan(ids: DataFrame, epoch: int, seed: int, world: int, batch_size: int) -> DataFrame:
    """``id, idx, shard, pos, batch``: the shuffle of an epoch, dealt evenly to ``world`` workers (first rows again, if need be), in full batches.

    Only ids move; a ragged last batch of a worker is left out.
    """
    shuffled = epoch_shuffle(ids.select("id"), seed, epoch)
    return batch(shard(shuffled, world, pad=True), batch_size, True)


def training_batches(
    images: DataFrame, epoch: int, seed: int, world: int, batch_size: int, null_class: int, size: int | None = None, task: str = "generation",
    transform: Callable | None = None, **flow,
) -> DataFrame:
    """The noised examples of an epoch: ``id, idx, shard, pos, batch, label, t, z, v, target`` (and ``condition``).

    Generation takes ``id, label, h, w, c, pixels``: cut to ``size`` if given, every second image mirrored, brought to -1..1. Restoration takes
    ``id, h, w, c, condition, target`` (and ``label``, else 0): boxes, flips and turns that a pair shares. All draws are by seed, epoch and id, so an
    epoch is the same on any cluster and after any retry. Pixels meet their place in one join by id, and are changed where they are read.
    """
    drawn = f"{seed}.{epoch}"
    if task == "generation":
        cut = images if size is None else halving_center_crop(images, size, transform)
        ready = random_hflip(cut, drawn).withColumn("target", A.normalize("pixels")).select("id", "label", "target")
    elif task == "restoration":
        if size is None:
            raise ValueError("restoration needs a size")
        labeled = images if "label" in images.columns else images.withColumn("label", F.lit(0))
        both = prepare_pairs(labeled, size, True, drawn, transform=transform)
        ready = both.withColumns({c: A.normalize(c) for c in ("condition", "target")}).select("id", "label", "condition", "target")
    else:
        raise ValueError(f"unknown task: {task}")
    placed = ready.join(epoch_plan(images, epoch, seed, world, batch_size), "id")
    return make_training_examples(placed, task, drawn, null_class, **flow).drop("source")
