"""Inputs of the registered queries, derived from the tables: images, pairs, listings, metrics, parameters; and the same as SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.rand import hash_normal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def imgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 grey images ``id, label, h, w, c, pixels``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("c"), F.col("embedding").cast("array<double>").alias("pixels")
    )


def imgs_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imgs(spark, sf_dir).withColumn("pixels", A.denormalize_u8("pixels").cast("array<double>"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``target`` and a ``condition`` with a tenth of noise on it."""
    noisy = F.transform("target", lambda x, i: x + 0.1 * hash_normal("1", F.col("id"), i))
    return imgs(spark, sf_dir).withColumnRenamed("pixels", "target").withColumn("condition", noisy)


def cond_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), F.lit(".png")).alias("rel"))


def target_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page: some in another folder, some with another extension."""
    path, k = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), F.col("page_id")
    rel = F.when(k % 5 == 0, F.concat(F.lit("other/"), F.element_at(F.split(path, "/"), -1), F.lit(".png"))).when(k % 3 == 0, F.concat(path, F.lit(".JPG"))).otherwise(F.concat(path, F.lit(".png")))
    return table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(rel.alias("rel"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with and without image suffixes."""
    ends = F.array(*map(F.lit, (".png", ".JPG", ".txt", ".tar.jpeg", "/.png")))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), F.get(ends, (F.col("page_id") % 5).cast("int"))).alias("path"))


#: Folders that the layout query's files lie in, by page.
FOLDERS = ["rainy", "train/clean", "clean", "train/input", "val/rainy", "test/Drop", "validation/gt", "misc", "input/sub"]


def layout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.array(*map(F.lit, FOLDERS))
    return table(spark, sf_dir, "pages").select(F.concat(F.get(where, (F.col("page_id") % len(FOLDERS)).cast("int")), F.lit("/"), F.col("page_id").cast("string"), F.lit(".png")).alias("rel"))


def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in folders by source; every seventh is no image."""
    end = F.when(F.col("doc_id") % 7 == 0, ".txt").otherwise(".jpg")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("rel"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("meter"), k.alias("step"), "value", (1 + k % 3).alias("n"), (k % 4).cast("int").alias("rank"), "ts")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as values of parameters over steps. (The ranks are test input, made by a window for each parameter.)"""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 8).alias("idx"), "o_orderkey", F.col("o_totalprice").alias("value"))
    step = (F.row_number().over(Window.partitionBy("name", "idx").orderBy("o_orderkey")) - 1).cast("int")
    return o.withColumn("step", step).select("name", "idx", "step", "value")


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as parameters ``name, shape, trainable``."""
    k = F.col("p_partkey")
    end = F.when(k % 4 == 0, ".bias").when(k % 4 == 1, ".norm").when(k % 11 == 0, ".diffloss.weight").otherwise(".weight")
    shape = F.when(k % 4 <= 1, F.array("p_size")).otherwise(F.array(F.col("p_size"), (k % 7 + 1).cast("int")))
    return table(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.lit("."), k.cast("string"), end).alias("name"), shape.alias("shape"), (k % 5 != 0).alias("trainable"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def digest(df: DataFrame, *columns: str, by: tuple[str, ...] = ("id",), digits: int = 6) -> DataFrame:
    """Of each array column its sum and its sum weighted by place. As in SQL, null elements count for nothing, and sums of nulls alone are null."""
    known = lambda values: F.aggregate(values.cast("array<double>"), F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x, a, x))
    out = []
    for c in columns:
        out += [rounded(known(F.col(c)), digits).alias(f"{c}_sum"), rounded(known(F.transform(c, lambda x, i: x * (i + 1))), digits).alias(f"{c}_pos")]
    return df.select(*by, *out)


# The same in DuckDB's SQL, a row for each pixel.
def sql_key(*keys: object) -> str:
    return f"md5(concat_ws(':', {', '.join(map(str, keys))}))"


def sql_uniform(*keys: object) -> str:
    return f"(('0x' || substr({sql_key(*keys)}, 1, 8))::BIGINT / 4294967296::DOUBLE)"


def sql_normal(*keys: object) -> str:
    k = sql_key(*keys)
    unit = lambda at: f"(('0x' || substr({k}, {at}, 8))::BIGINT / 4294967296::DOUBLE)"
    return f"(sqrt(-2 * ln({unit(1)} + pow(2::DOUBLE, -33))) * cos(2 * {math.pi!r}::DOUBLE * {unit(9)}))"


def sql_rounded(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


def sql_digest(relation: str, *columns: str, by: str = "id", pos: str = "pos", digits: int = 6) -> str:
    parts = [f"{sql_rounded(f'sum({c}::DOUBLE)', digits)} AS {c}_sum, {sql_rounded(f'sum({c}::DOUBLE * ({pos} + 1))', digits)} AS {c}_pos" for c in columns]
    return f"SELECT {by}, {', '.join(parts)} FROM {relation} GROUP BY {by}"


PX = "px AS (SELECT vec_id AS id, label, p::INT AS pos, (p // 8)::INT AS y, (p % 8)::INT AS x, embedding[p + 1]::DOUBLE AS v FROM embeddings, UNNEST(range(64)) AS u(p))"
U8 = "least(greatest((v + 1) / 2 * 255, 0), 255)"
PR = f"{PX}, pr AS (SELECT id, label, pos, y, x, v AS target, v + 0.1::DOUBLE * {sql_normal(chr(39) + '1' + chr(39), 'id', 'pos')} AS condition FROM px)"
PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"
COND = f"cond AS (SELECT page_id, {PATH} || '.png' AS rel FROM pages)"
TARGET = (
    f"target AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'other/' || string_split({PATH}, '/')[-1] || '.png' WHEN page_id % 3 = 0 THEN {PATH} || '.JPG' "
    f"ELSE {PATH} || '.png' END AS rel FROM pages WHERE page_id % 2 = 0)"
)
LISTING = f"listing AS (SELECT page_id, {PATH} || ['.png', '.JPG', '.txt', '.tar.jpeg', '/.png'][page_id % 5 + 1] AS path FROM pages)"
STEM = r"regexp_replace(rel, '([^/])\.[^./]+$', '\1')"
METRICS = "m AS (SELECT event_type AS meter, event_id AS step, value, 1 + event_id % 3 AS n, (event_id % 4)::INT AS rank, ts FROM events)"
SNAPSHOTS = (
    "s AS (SELECT o_orderpriority AS name, o_custkey % 8 AS idx, o_totalprice AS value, "
    "row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 8 ORDER BY o_orderkey) - 1 AS step FROM orders)"
)
PARAMS = (
    "p AS (SELECT lower(p_type) || '.' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.bias' WHEN p_partkey % 4 = 1 THEN '.norm' "
    "WHEN p_partkey % 11 = 0 THEN '.diffloss.weight' ELSE '.weight' END AS name, "
    "CASE WHEN p_partkey % 4 <= 1 THEN [p_size] ELSE [p_size, (p_partkey % 7 + 1)::INT] END AS shape, p_partkey % 5 <> 0 AS trainable FROM part)"
)
