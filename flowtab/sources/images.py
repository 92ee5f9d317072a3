"""Reading image listings and pixels."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import cut
from ..operators.order import global_index
from ..operators.pairing import class_index, split_path

#: Extensions of image files.
EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp"]

#: Folders looked for, in this order. Validation conditions may lie under ``test``, validation targets never do.
LAYOUT = {
    ("train", "condition"): ["train/Drop", "Drop", "train/rainy", "rainy", "train/input", "input"],
    ("train", "target"): ["train/Clear", "Clear", "train/clean", "clean", "train/gt", "gt", "train/target", "target"],
    ("val", "condition"): ["val/Drop", "validation/Drop", "test/Drop", "val/rainy", "validation/rainy", "test/rainy"],
    ("val", "target"): ["val/Clear", "validation/Clear", "val/clean", "validation/clean", "val/gt", "validation/gt"],
}


def suffix(path: Column | str) -> Column:
    """The last suffix of a file name, small; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"[^/](\.[^./]+)$", 1))


def image_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """The rows whose path is that of an image."""
    return df.where(suffix(path).isin(*EXTENSIONS))


def relative(path: Column | str, root: str) -> Column:
    """A path below its root; schemes and authorities are spelt differently by Spark's sources."""
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    return F.substring_index(path, base + "/", -1)


#: Scan partitions of single files that one task reads, at most.
FILES_WAYS = 64


def gathered(files: DataFrame) -> DataFrame:
    """A scan of single files, with many to a task. No row moves.

    Spark counts megabytes for opening a file, so that a task would have some files only, however small; each task's result goes to the driver.
    """
    scans, least = files.rdd.getNumPartitions(), 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(least, -(-scans // FILES_WAYS))) if scans > least else files


def single_files(spark: SparkSession, kind: str, root: str, **options: object) -> DataFrame:
    """A scan of all single files below a folder. The driver has their listing as long as the scan, and no longer: it stays out of the session's cache."""
    key = "spark.sql.hive.manageFilesourcePartitions"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        return spark.read.format(kind).options(recursiveFileLookup=True, **options).load(root)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scan_images(spark: SparkSession, root: str, index: bool = False) -> DataFrame:
    """``path, rel`` of all images below a folder; contents are not read. ``index`` adds ``idx``, by path components."""
    paths = single_files(spark, "binaryFile", root).select("path")
    found = image_paths(gathered(paths)).withColumn("rel", relative("path", root))
    return global_index(found.withColumn("__ft_order", F.split("rel", "/")), ["__ft_order"]).drop("__ft_order") if index else found


def resolve_layout(paths: DataFrame, overrides: dict[tuple[str, str], str] | None = None, check: bool = True) -> DataFrame:
    """``split, role, prefix``: the first folder of ``LAYOUT`` that has files; ``paths`` has a column ``rel``.

    Overrides come first. With ``check``, training without both folders is an error. The candidates are a constant table of
    some thirty rows.
    """
    spark = paths.sparkSession
    rows = [(s, r, p, i) for (s, r), ps in LAYOUT.items() if not (overrides or {}).get((s, r)) for i, p in enumerate(ps)]
    candidates = spark.createDataFrame(rows, "split string, role string, prefix string, priority int")
    parts = F.split("rel", "/")
    # A folder of a path is one or two components long here, so its heads are joined by equality.
    heads = paths.select(F.explode(F.array_distinct(F.array(F.element_at(parts, 1), F.concat_ws("/", F.slice(parts, 1, 2))))).alias("prefix"), F.size(parts).alias("n"))
    there = heads.where(F.col("n") > F.size(F.split("prefix", "/"))).select("prefix").distinct()
    found = there.join(F.broadcast(candidates), "prefix").groupBy("split", "role").agg(F.min_by("prefix", "priority").alias("prefix"))
    if overrides:
        found = found.union(spark.createDataFrame([(s, r, p) for (s, r), p in overrides.items() if p], "split string, role string, prefix string"))
    if check and found.where("split = 'train'").count() < 2:
        raise ValueError("training needs a condition folder and a target folder")
    return found


def role_listing(spark: SparkSession, root: str, split: str, role: str, override: str | None = None) -> tuple[str, DataFrame] | None:
    """The folder that ``resolve_layout`` finds for a role and the stored ``rel`` of its images; None where there is none. One folder is listed at a time."""
    for prefix in [override] if override else LAYOUT.get((split, role), []):
        folder = f"{root.rstrip('/')}/{prefix}"
        try:
            found = cut(scan_images(spark, folder).select("rel"))
        except AnalysisException as e:
            if override or e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if override or not found.isEmpty():
            return folder, found
    return None


def labeled(paths: DataFrame) -> DataFrame:
    """``rel, class_name, label`` of images in class folders; a listing has ``rel``, below the split's folder."""
    return class_index(split_path(image_paths(paths, "rel")).where("class_name is not null")).select("rel", "class_name", "label")


def read_labeled_images(spark: SparkSession, root: str) -> DataFrame:
    """``path, rel, class_name, label`` of ``<root>/train``."""
    files = scan_images(spark, f"{root.rstrip('/')}/train")
    return class_index(split_path(files).where("class_name is not null")).select("path", "rel", "class_name", "label")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images ``path, h, w, c, pixels`` (RGB, 0..255). Files that cannot be decoded are left out."""
    raw = single_files(spark, "image", root, dropInvalid=True).select("image.*")
    return decode_images(gathered(raw))


def count_undecodable(spark: SparkSession, root: str) -> int:
    """Images by name that the image source cannot decode."""
    rows = single_files(spark, "image", root, dropInvalid=False).select("image.origin", "image.height")
    return image_paths(gathered(rows), "origin").where("height <= 0").count()


def decode_images(raw: DataFrame) -> DataFrame:
    """Rows of Spark's image source as ``path, h, w, c, pixels``: blue-green-red to RGB, grey repeated, alpha dropped."""

    @F.pandas_udf("array<int>")
    def rgb(data, n):
        import numpy as np
        import pandas as pd

        out = []
        for d, k in zip(data, n, strict=True):
            a = np.frombuffer(d, np.uint8).reshape(-1, int(k))
            out.append((np.repeat(a, 3, 1) if k == 1 else a[:, 2::-1]).ravel().astype(np.int32))
        return pd.Series(out)

    return raw.where("nChannels > 0").select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.lit(3).alias("c"), rgb("data", "nChannels").alias("pixels"))
