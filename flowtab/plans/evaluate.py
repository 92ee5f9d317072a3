"""Composites: reference sets, evaluation of generation and of restoration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.joins import cut
from ..operators import metrics
from ..operators.images import halving_center_crop, prepare_pairs
from ..operators.order import generation_plan, global_index
from ..operators.pairing import check_pairs, class_index, pair_images, self_pair
from ..sources.files import save_files
from ..sources.images import read_images, read_labeled_images, relative, role_listing
from ..sources.sinks import export_images, export_name, write_metric_log
from .scoring import Predictor, generate, restore


def reference_set(images: DataFrame, size: int, transform: Callable | None = None, listing: DataFrame | None = None) -> DataFrame:
    """``idx, label, file_name, content`` of images ``rel, h, w, c, pixels``: cut to ``size``, numbered by class and path.

    Names ``rel, class_name`` are numbered, those of ``listing`` or else the images' own; the pixels meet their number in one join, by path.
    """
    names = class_index((images if listing is None else listing).select("rel", "class_name")).withColumn("__ft_order", F.split("rel", "/"))
    numbered = global_index(names, ["label", "__ft_order"]).select(F.col("rel").alias("__ft_rel"), "label", "idx")
    cropped = halving_center_crop(images.select("rel", "h", "w", "c", "pixels"), size, transform)
    named = cropped.join(numbered, F.col("rel") == F.col("__ft_rel")).withColumn("file_name", export_name("reference", index=F.col("idx")))
    return export_images(named, "file_name", "idx", "label").select("idx", "label", "file_name", "content")


def prepare_reference_set(spark: SparkSession, root: str, size: int, transform: Callable | None = None) -> DataFrame:
    """The reference set of all images in the class folders of ``<root>/train``."""
    train = f"{root.rstrip('/')}/train"
    images = read_images(spark, train).withColumns({"rel": relative("path", train), "pixels": F.col("pixels").cast("array<double>")})
    return reference_set(images, size, transform, read_labeled_images(spark, root))


def evaluate_generation(
    df: DataFrame, predict: Predictor, features: Callable[[Column], Column], stats: DataFrame | None, null_class: int, batch: int, world: int,
    res: int = 256, log: str | None = None, step: int = 0, **sampling,
) -> tuple[DataFrame, dict[str, float]]:
    """Generate for rows ``id, idx, label`` (and what the predictor needs), and score the images.

    Gives the images (8 bits, with file names) and the scores: ``inception`` over ``softmax(features)``, and ``frechet``
    where statistics are given. The images are stored once, and both scores and the caller read them there.
    """
    plan = generation_plan(df, batch, world)
    made = generate(plan, predict, null_class, **sampling).withColumn("u8", A.denormalize_u8("pixels"))
    images = cut(made.withColumn("file_name", export_name("generated", index=F.col("idx"))))
    scored = images.select(features(F.col("pixels")).alias("f"))
    out = {"inception": metrics.inception_score(scored.select(A.softmax("f").alias("p"))).first().score}
    if stats is not None:
        out["frechet"] = metrics.frechet_to_stored(scored, stats, res)
    if log:
        spark = df.sparkSession
        write_metric_log(spark.createDataFrame([(k, float(v), step) for k, v in out.items()], "tag string, value double, step bigint"), log)
    return images, out


def evaluate_restoration(df: DataFrame, predict: Predictor, null_class: int, by: str | None = None, log: str | None = None, step: int = 0, **sampling) -> tuple[DataFrame, DataFrame]:
    """Restore rows ``id, condition, target`` (target null: none), and give the images and their mean PSNR.

    Rows without a target take no part in the metric; without any target it is null.
    """
    return _scored(restore(df, predict, null_class, **sampling), by, log, step)


def _scored(made: DataFrame, by: str | None, log: str | None, step: int) -> tuple[DataFrame, DataFrame]:
    images = made.withColumn("psnr", F.when(F.col("target").isNotNull(), metrics.psnr("pixels", "target")))
    scores = metrics.mean_psnr(images, *([by] if by else []))
    if log:
        write_metric_log(scores.where("n > 0").select(F.lit("psnr").alias("tag"), F.col("psnr").alias("value"), F.lit(step).alias("step")), log)
    return images, scores


def restore_folder(
    spark: SparkSession, root: str, size: int, predict: Predictor, null_class: int, split: str = "val", overrides: dict[tuple[str, str], str] | None = None,
    out: str | None = None, batch: int = 1, world: int = 1, log: str | None = None, step: int = 0, **sampling,
) -> tuple[DataFrame, DataFrame]:
    """Restore the images below a folder: listing, layout, pairs, pixels, middle boxes, sampling, PSNR, and files below ``out`` if given.

    Gives ``evaluate_restoration``'s images, with ``rel`` as their ``id``, and its mean PSNR. Without a target folder there is no metric.
    Images are scaled and cut to ``size`` in whole levels, and brought to -1..1 thereafter, before they meet their pair, so only small rows
    move; what a box has outside its image is black. Files that cannot be decoded are left out. Restored files appear all or not at all.
    """
    found = {role: at for role in ("condition", "target") if (at := role_listing(spark, root, split, role, (overrides or {}).get((split, role))))}
    if "condition" not in found:
        raise ValueError(f"no condition folder for {split}")

    def boxes(role: str, name: str) -> DataFrame:
        folder, _ = found[role]
        images = read_images(spark, folder).withColumn("id", relative("path", folder))
        levels = images.select("id", "h", "w", "c", F.col("pixels").cast("array<double>").alias(name))
        return prepare_pairs(levels, size, False, columns=(name,)).withColumn(name, A.normalize(name))

    _, conditions = found["condition"]
    if "target" in found:
        pairs = check_pairs(pair_images(conditions, found["target"][1]))
        # The driver lists one folder at a time.
        targets = cut(boxes("target", "target")).select(F.col("id").alias("__ft_target"), "target")
        rows = pairs.join(targets, F.col("target_rel") == F.col("__ft_target")).select("rel", "target")
    else:
        rows = self_pair(conditions).select("rel", F.lit(None).cast("array<double>").alias("target"))
    rows = boxes("condition", "condition").join(rows, F.col("id") == F.col("rel")).drop("rel")
    planned = generation_plan(global_index(rows.withColumn("__ft_order", F.split("id", "/")), ["__ft_order"]).drop("__ft_order"), batch, world)
    made = cut(restore(planned, predict, null_class, **sampling))
    images, scores = _scored(made, None, log, step)
    if out:
        u8 = made.withColumns({"pixels": A.denormalize_u8("pixels"), "file_name": export_name("flat", F.col("id"), batch=F.col("step"), rank=F.col("rank"))})
        save_files(export_images(u8), out)
    return images, scores
