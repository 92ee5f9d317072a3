"""Image exports, metric logs and parameter snapshots."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions


def export_name(scheme: str, name: Column | None = None, index: Column | None = None, batch: Column | None = None, rank: Column | None = None) -> Column:
    """File names: ``reference`` (8 digits), ``generated`` (5 digits or more), ``flat`` (path as one name, with batch and rank)."""
    padded = lambda c, n: F.lpad(c.cast("string"), F.greatest(F.length(c.cast("string")), F.lit(n)), F.lit("0"))
    if scheme == "reference":
        return F.concat(F.lit("transformed_"), padded(index, 8), F.lit(".png"))
    if scheme == "generated":
        return F.concat(padded(index, 5), F.lit(".png"))
    if scheme == "flat":
        flat = F.regexp_replace(F.regexp_replace(name, r"[/\\]", "__"), r"([^/])\.[^.]*$", "$1")
        return F.concat(padded(batch, 5), F.lit("_"), rank.cast("string"), F.lit("_"), flat, F.lit(".png"))
    raise ValueError(f"unknown scheme: {scheme}")


def png(pixels, h: int, w: int, c: int) -> bytes:
    """A PNG file of 8-bit grey or RGB samples."""
    import numpy as np

    a = np.asarray(pixels, np.uint8).reshape(h, w * c)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), a], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def unpng(content: Column | str) -> Column:
    """Samples of PNG files as ``png`` writes them."""

    def one(data: bytes):
        import numpy as np

        w, h, _, kind = struct.unpack(">IIBB", data[16:26])
        at, packed = 8, b""
        while at < len(data):
            (n,) = struct.unpack(">I", data[at : at + 4])
            packed += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + n
        rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * {0: 1, 2: 3}[kind])
        if rows[:, 0].any():
            raise ValueError("a filtered PNG was not written here")
        return rows[:, 1:].ravel().astype(float)

    @F.pandas_udf("array<double>")
    def samples(contents):
        import pandas as pd

        return pd.Series([one(bytes(d)) for d in contents])

    return samples(content)


def export_images(df: DataFrame, name_col: str = "file_name", *keep: str) -> DataFrame:
    """``file_name, content`` and the columns of ``keep``: one PNG for each image; write it as Parquet, or hand it to ``write_files``."""
    kept = df.select(*keep).schema
    fields = ", ".join(["file_name string", "content binary", *(f"{f.name} {f.dataType.simpleString()}" for f in kept)])

    def run(batches: Iterable) -> Iterator:
        for pdf in batches:
            made = [png(p, int(h), int(w), int(c)) for p, h, w, c in zip(pdf["pixels"], pdf["h"], pdf["w"], pdf["c"], strict=True)]
            yield type(pdf)({"file_name": pdf["n"], "content": made} | {k: pdf[k] for k in keep})

    return df.select(F.col(name_col).alias("n"), "pixels", "h", "w", "c", *keep).mapInPandas(run, fields)


def write_files(exported: DataFrame, put: Callable[[str, bytes], None]) -> None:
    """Give each file to ``put(name, content)`` on the executors; names are keys, so a second run overwrites."""

    def each(rows: Iterable) -> None:
        for r in rows:
            put(r.file_name, bytes(r.content))

    exported.foreachPartition(each)


_LOG = "value double, step bigint, tag string"


def write_metric_log(df: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Append ``tag, value, step`` rows, by tag. What a failed write leaves is never read; rows of a ``batch`` are appended once, however often it is repeated."""
    rows = df.select("tag", F.col("value").cast("double").alias("value"), F.col("step").cast("bigint").alias("step"))
    key = uuid.uuid4().hex if batch is None else f"batch {batch}"
    Versions(df.sparkSession, path).publish(key, rows, once=batch is not None, by=["tag"])


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    found = Versions(spark, path).read(_LOG)
    return spark.createDataFrame([], _LOG) if found is None else found


def write_snapshot(df: DataFrame, path: str, epoch: int, epoch_name: str = "last") -> None:
    """Store parameters and averages under a name. A new version takes the name's place at once and whole, and leaves all others."""
    out = df.withColumn("epoch", F.lit(epoch)).withColumn("epoch_name", F.lit(epoch_name))
    Versions(df.sparkSession, path).publish(epoch_name, out, {"epoch": epoch})


def read_snapshot(spark: SparkSession, path: str, epoch_name: str = "last") -> DataFrame:
    """The version that counts now; it stays readable when another takes its place."""
    found = Versions(spark, path).read(keys=[epoch_name])
    if found is None:
        raise ValueError(f"no snapshot {epoch_name} in {path}")
    return found


def resume_epoch(spark: SparkSession, path: str, epoch_name: str = "last") -> int:
    """The epoch to go on with: one after the snapshot's, 0 without one. The parameters are not read."""
    found = Versions(spark, path).entries().get(epoch_name)
    return 0 if found is None else int(found.meta["epoch"]) + 1
