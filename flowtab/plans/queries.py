"""Every operator as a query over the tables, with independent SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import sql
from ..functions.joins import shared_folder
from ..functions.rand import hash_normal, hash_uniform
from ..operators import flow, images, meters, metrics, order, pairing, params
from ..sources import files, sinks
from ..sources import images as sources
from ..streaming import meters as streams
from . import evaluate, scoring, training
from . import fixtures as X
from .fixtures import COND, LISTING, METRICS, PARAMS, PR, PX, SNAPSHOTS, STEM, TARGET, U8, digest, rounded
from .fixtures import sql_digest as dig
from .fixtures import sql_normal as N
from .fixtures import sql_rounded as R
from .fixtures import sql_uniform as U

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# A. Scans, sources, sinks


@query(f"WITH {LISTING} SELECT page_id, path FROM listing WHERE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.bmp', '.webp', '.tif', '.tiff')")
def a1_image_paths(spark, sf_dir):
    return sources.image_paths(X.listing(spark, sf_dir))


@query(
    f"WITH {LISTING}, l AS (SELECT page_id, path AS rel, regexp_replace(path, '([^/])\\.[^./]+$', '\\1') AS rel_stem FROM listing) "
    "SELECT page_id, rel, rel_stem, string_split(rel_stem, '/')[-1] AS stem, CASE WHEN contains(rel, '/') THEN string_split(rel, '/')[1] END AS class_name FROM l"
)
def a2_split_path(spark, sf_dir):
    return pairing.split_path(X.listing(spark, sf_dir).withColumnRenamed("path", "rel"))


@query(
    "WITH l AS (SELECT [" + ", ".join(f"'{f}'" for f in X.FOLDERS) + f"][page_id % {len(X.FOLDERS)} + 1] || '/' || page_id || '.png' AS rel FROM pages), c(split, role, prefix, priority) AS (VALUES "
    + ", ".join(f"('{s}', '{r}', '{p}', {i})" for (s, r), ps in sources.LAYOUT.items() for i, p in enumerate(ps))
    + ") SELECT split, role, arg_min(prefix, priority) AS prefix FROM c WHERE EXISTS (SELECT 1 FROM l WHERE starts_with(l.rel, c.prefix || '/')) GROUP BY split, role"
)
def a3_resolve_layout(spark, sf_dir):
    return sources.resolve_layout(X.layout_files(spark, sf_dir))


@query(
    "WITH f AS (SELECT source AS class_name, source || '/' || doc_id || '.jpg' AS rel FROM documents WHERE doc_id % 7 <> 0) "
    "SELECT rel, class_name, (dense_rank() OVER (ORDER BY class_name) - 1)::INT AS label FROM f"
)
def a4_labeled_images(spark, sf_dir):
    return sources.labeled(X.class_files(spark, sf_dir))


@query(
    f"WITH {PX}, b AS (SELECT id, pos, (round_even({U8}, 0))::INT AS u FROM px), "
    "d AS (SELECT id, pos * 3 + k AS pos, CASE WHEN id % 2 = 0 THEN u ELSE [u, (u * 7 + 1) % 256, 255 - u][k + 1] END AS pixels FROM b, UNNEST([0, 1, 2]) AS t(k)) "
    + dig("d", "pixels")
)
def a5_decode_images(spark, sf_dir):
    """Rows as Spark's image source gives them: grey ones for even ids, blue-green-red with alpha for odd ones."""
    u8 = X.imgs(spark, sf_dir).select("id", A.denormalize_u8("pixels").alias("u"))
    colour = F.flatten(F.transform("u", lambda u: F.array(255 - u, (u * 7 + 1) % 256, u, F.lit(9))))
    byte = lambda xs: F.unhex(F.array_join(F.transform(xs, lambda u: F.lpad(F.hex(u), 2, "0")), ""))
    even = F.col("id") % 2 == 0
    raw = u8.select(
        F.col("id").cast("string").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.when(even, 1).otherwise(4).alias("nChannels"),
        F.when(even, byte(F.col("u"))).otherwise(byte(colour)).alias("data"),
    )
    out = sources.decode_images(raw).withColumn("id", F.col("path").cast("bigint")).withColumn("pixels", F.col("pixels").cast("array<double>"))
    return digest(out, "pixels")


# A grey PNG without filters has 41 bytes for its head, 16 for its end, 12 round the packed rows; these rows are packed without loss.
@query(
    f"WITH {PX}, b AS (SELECT id, pos, round_even({U8}, 0) AS pixels FROM px), d AS ({dig('b', 'pixels')}) "
    "SELECT lpad(id::VARCHAR, greatest(5, len(id::VARCHAR))::INT, '0') || '.png' AS file_name, 8 AS h, 8 AS w, true AS fits, pixels_sum, pixels_pos FROM d"
)
def a6_export_images(spark, sf_dir):
    """Files written with commit and read again: names, sides, whether the length is that of the parts, and pixels."""
    named = X.imgs_u8(spark, sf_dir).withColumn("file_name", sinks.export_name("generated", index=F.col("id")))
    path = scratch(spark, "images")
    files.save_files(sinks.export_images(named), path)
    side = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    made = files.saved_files(spark, path).withColumns({"w": side(17), "h": side(21), "fits": F.col("bytes") == 57 + side(34), "pixels": sinks.unpng("content")})
    return digest(made, "pixels", by=("file_name", "h", "w", "fits"))


@query(
    f"WITH {COND} SELECT page_id, 'transformed_' || CASE WHEN page_id >= 100000000 THEN page_id::VARCHAR ELSE lpad(page_id::VARCHAR, 8, '0') END || '.png' AS reference, "
    "CASE WHEN page_id >= 100000 THEN page_id::VARCHAR ELSE lpad(page_id::VARCHAR, 5, '0') END || '.png' AS generated, "
    "lpad((page_id // 32)::VARCHAR, 5, '0') || '_' || (page_id % 4) || '_' || regexp_replace(replace(rel, '/', '__'), '([^/])\\.[^.]*$', '\\1') || '.png' AS flat FROM cond"
)
def a7_export_name(spark, sf_dir):
    k = F.col("page_id")
    return X.cond_files(spark, sf_dir).select(
        k,
        sinks.export_name("reference", index=k).alias("reference"),
        sinks.export_name("generated", index=k).alias("generated"),
        sinks.export_name("flat", name=F.col("rel"), batch=F.floor(k / 32), rank=k % 4).alias("flat"),
    )


@query(f"WITH {METRICS} SELECT meter AS tag, count(*) * 2 AS n, {R('sum(value) * 2')} AS total, max(step) + 1 AS last FROM m GROUP BY meter")
def a8_metric_log(spark, sf_dir):
    path = scratch(spark, "metric-log")
    rows = X.metric_rows(spark, sf_dir).select(F.col("meter").alias("tag"), "value", "step")
    sinks.write_metric_log(rows, path)
    sinks.write_metric_log(rows.withColumn("step", F.col("step") + 1), path)
    return sinks.read_metric_log(spark, path).groupBy("tag").agg(F.count("*").alias("n"), rounded(F.sum("value")).alias("total"), F.max("step").alias("last"))


@query(
    f"WITH {SNAPSHOTS}, b AS (SELECT name, idx, value FROM s WHERE step = 0), "
    "a AS (SELECT 'epoch_0' AS epoch_name, 0 AS epoch, 1 AS resume, name, idx, value FROM b UNION ALL SELECT 'last', 1, 2, name, idx, value * 2 FROM b) "
    f"SELECT epoch_name, epoch, resume, count(*) AS n, {R('sum(value)', 4)} AS total FROM a GROUP BY ALL"
)
def a9_snapshots(spark, sf_dir):
    """``last`` is written for epoch 0, then for epoch 1 with doubled values; a milestone stays beside it."""
    path = scratch(spark, "snapshots")
    rows = X.snapshots(spark, sf_dir).where("step = 0").select("name", "idx", "value")
    sinks.write_snapshot(rows, path, 0)
    sinks.write_snapshot(rows, path, 0, "epoch_0")
    sinks.write_snapshot(rows.withColumn("value", F.col("value") * 2), path, 1)
    both = [sinks.read_snapshot(spark, path, n).withColumn("resume", F.lit(sinks.resume_epoch(spark, path, n))) for n in ("last", "epoch_0")]
    return both[0].unionByName(both[1]).groupBy("epoch_name", "epoch", "resume").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))


# B. Projections, filters, predicates


@query(f"WITH {PX}, b AS (SELECT id, pos, round_even({U8}, 0) / 255 * 2 - 1 AS norm FROM px) " + dig("b", "norm"))
def b1_normalize(spark, sf_dir):
    return digest(X.imgs_u8(spark, sf_dir).withColumn("norm", A.normalize("pixels")), "norm")


@query(f"WITH {PX}, b AS (SELECT id, pos, round_even({U8}, 0) AS u8 FROM px) " + dig("b", "u8"))
def b2_denormalize_u8(spark, sf_dir):
    return digest(X.imgs(spark, sf_dir).withColumn("u8", A.denormalize_u8("pixels")), "u8")


@query(f"WITH {PX}, b AS (SELECT id, pos - pos % 4 + 3 - pos % 4 AS pos, v AS bgr FROM px) " + dig("b", "bgr"))
def b3_reverse_channels(spark, sf_dir):
    wide = X.imgs(spark, sf_dir).withColumns({"w": F.lit(2), "c": F.lit(4)}).withColumnRenamed("pixels", "bgr")
    return digest(images.swap_channels(wide, ["bgr"]), "bgr")


@query(f"WITH {PX}, b AS (SELECT id, pos, least(greatest((v + 1) / 2, 0), 1) AS u FROM px) " + dig("b", "u"))
def b4_to_unit(spark, sf_dir):
    return digest(X.imgs(spark, sf_dir).withColumn("u", A.to_unit("pixels")), "u")


@query(f"WITH {METRICS} SELECT meter, count(*) AS n, {R('sum(value)', 4)} AS total FROM m WHERE step % 7 <> 0 GROUP BY meter")
def b6_check_numeric(spark, sf_dir):
    rows = X.metric_rows(spark, sf_dir).withColumn("value", F.when(F.col("step") % 7 != 0, F.col("value").cast("string")))
    return meters.drop_nulls_check_numeric(rows).groupBy("meter").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))


@query(f"WITH {METRICS} SELECT meter, min(step) AS first_bad_step, count(*) AS bad FROM m WHERE step % 97 = 3 OR step % 149 = 5 GROUP BY meter")
def b7_nonfinite_guard(spark, sf_dir):
    k = F.col("step")
    rows = X.metric_rows(spark, sf_dir).withColumn("value", F.when(k % 97 == 3, float("nan")).when(k % 149 == 5, float("-inf")).otherwise(F.col("value")))
    return meters.nonfinite_guard(rows, "meter")


@query(f"WITH {PR}, b AS (SELECT id, pos // 2 * 4 + pos % 2 AS pos, target AS zc FROM pr UNION ALL SELECT id, pos // 2 * 4 + 2 + pos % 2, condition FROM pr) " + dig("b", "zc"))
def b8_concat_condition(spark, sf_dir):
    return digest(X.pairs(spark, sf_dir).withColumn("zc", A.concat_channels("target", "condition", 2)), "zc")


@query(f"WITH {PR}, b AS (SELECT id, pos, target + condition AS pred FROM pr) " + dig("b", "pred"))
def b9_add_residual(spark, sf_dir):
    return digest(X.pairs(spark, sf_dir).withColumn("pred", A.add("target", "condition")), "pred")


@query("SELECT vec_id AS id, 8 AS h, 8 AS w, 64 AS n FROM embeddings")
def b10_validate_images(spark, sf_dir):
    return images.validate_images(X.imgs(spark, sf_dir), 8, 1).select("id", "h", "w", F.size("pixels").alias("n"))


# C. Joins

_PAIRED = (
    f"{COND}, {TARGET}, c AS (SELECT page_id, rel, {STEM} AS rel_stem, string_split({STEM}, '/')[-1] AS stem FROM cond), "
    f"t AS (SELECT rel, {STEM} AS rel_stem, string_split({STEM}, '/')[-1] AS stem FROM target), "
    "t1 AS (SELECT rel AS k, arg_max(rel, string_split(rel, '/')) AS r FROM t GROUP BY 1), "
    "t2 AS (SELECT rel_stem AS k, arg_max(rel, string_split(rel, '/')) AS r FROM t GROUP BY 1), "
    "t3 AS (SELECT stem AS k, arg_max(rel, string_split(rel, '/')) AS r FROM t GROUP BY 1), "
    "pairs AS (SELECT page_id, rel, coalesce(t1.r, t2.r, t3.r) AS target_rel, "
    "CASE WHEN t1.r IS NOT NULL THEN 1 WHEN t2.r IS NOT NULL THEN 2 WHEN t3.r IS NOT NULL THEN 3 END AS match_tier "
    "FROM c LEFT JOIN t1 ON c.rel = t1.k LEFT JOIN t2 ON c.rel_stem = t2.k LEFT JOIN t3 ON c.stem = t3.k)"
)


def _pairs(spark, sf_dir):
    return pairing.pair_images(X.cond_files(spark, sf_dir), X.target_files(spark, sf_dir))


@query(f"WITH {_PAIRED} SELECT * FROM pairs WHERE target_rel IS NOT NULL")
def c1_pair_images(spark, sf_dir):
    return pairing.check_pairs(_pairs(spark, sf_dir))


@query(f"WITH {_PAIRED} SELECT count(*) AS missing, arg_min(rel, string_split(rel, '/')) AS first_missing FROM pairs WHERE target_rel IS NULL")
def c2_unpaired(spark, sf_dir):
    return pairing.unpaired(_pairs(spark, sf_dir))


@query(f"WITH {COND} SELECT page_id, rel, rel AS target_rel, false AS has_target FROM cond")
def c3_self_pair(spark, sf_dir):
    return pairing.self_pair(X.cond_files(spark, sf_dir))


@query("SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS label FROM documents")
def c4_class_index(spark, sf_dir):
    return pairing.class_index(X.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


_MEANS = "c AS (SELECT label, pos, avg(v) AS mu, var_pop(v) AS var FROM px GROUP BY label, pos UNION ALL SELECT 10, pos, avg(v), var_pop(v) FROM px GROUP BY pos)"
_DROPPED = f"CASE WHEN {U(repr('5:drop'), 'id')} < 0.2 THEN 10 ELSE label END"


def _stats(spark, sf_dir):
    return metrics.fit_class_gaussian(X.imgs(spark, sf_dir).withColumnRenamed("pixels", "target"), 10)


@query(f"WITH {PX}, {_MEANS}, d AS (SELECT DISTINCT id, {_DROPPED} AS label FROM px), e AS (SELECT id, d.label, pos, mu AS vec FROM d JOIN c USING (label)) " + dig("e", "vec", by="id, label"))
def c5_lookup_embedding(spark, sf_dir):
    rows = flow.label_dropout(X.imgs(spark, sf_dir).select("id", "label"), 0.2, 10, 5)
    known = rows.where("label is not null")
    return digest(params.lookup_embedding(known, _stats(spark, sf_dir).withColumnRenamed("mu", "vec")), "vec", by=("id", "label"))


def _ema_sql(decay: float, name: str = "ema") -> str:
    return f"sum(value * CASE WHEN step = 0 THEN pow({decay}::DOUBLE, last) ELSE (1 - {decay}::DOUBLE) * pow({decay}::DOUBLE, last - step) END) AS {name}"


_LAST = f"{SNAPSHOTS}, l AS (SELECT *, max(step) OVER (PARTITION BY name, idx) AS last FROM s)"


@query(
    f"WITH {_LAST}, e AS (SELECT name, idx, {_ema_sql(0.9)} FROM l WHERE idx % 3 <> 0 GROUP BY name, idx), b AS (SELECT name, idx, value FROM s WHERE step = 0) "
    f"SELECT name, idx, {R('coalesce(ema, value)', 4)} AS value FROM b LEFT JOIN e USING (name, idx)"
)
def c6_overlay_params(spark, sf_dir):
    rows = X.snapshots(spark, sf_dir)
    averaged = params.ema(rows.where("idx % 3 != 0"), 0.9, "value")
    out = params.overlay_params(rows.where("step = 0").select("name", "idx", "value"), averaged)
    return out.withColumn("value", rounded(F.col("value"), 4))


_GROUPS = f"{PARAMS}, g AS (SELECT name, CASE WHEN len(shape) = 1 OR ends_with(name, '.bias') OR name IN ('economy.6.weight') OR contains(name, 'diffloss') THEN 0.0 ELSE 0.05 END::DOUBLE AS decay FROM p WHERE trainable)"


def _grouped(spark, sf_dir):
    return params.parameter_groups(X.params(spark, sf_dir), 0.05, ["economy.6.weight"]).select("name", "decay")


@query(f"WITH {_GROUPS} SELECT name, decay, CASE WHEN decay > 0 THEN 0.5::DOUBLE END AS lr_scale FROM g")
def c7_attach_group_config(spark, sf_dir):
    groups = spark.createDataFrame([(0.0, None), (0.05, 0.5)], "decay double, lr_scale double")
    return params.attach_group_config(_grouped(spark, sf_dir), groups).select("name", "decay", "lr_scale")


@query(f"WITH {PR} " + dig("(SELECT id, pos, condition AS pred, target FROM pr WHERE id % 3 <> 0)", "pred", "target"))
def c8_compare_tables(spark, sf_dir):
    p = X.pairs(spark, sf_dir)
    restored = p.where("id % 3 != 0").select("id", F.col("condition").alias("pixels"))
    return digest(pairing.compare_tables(restored, p.select("id", F.col("target").alias("pixels"))), "pred", "target")


# D. Image transforms

_SIDES = "q AS (SELECT p_partkey AS id, (100 + p_partkey * 7 % 1900)::INT AS h, (100 + p_partkey * 13 % 2100)::INT AS w FROM part)"


def _sides(spark, sf_dir):
    k = F.col("p_partkey")
    return X.table(spark, sf_dir, "part").select(k.alias("id"), (100 + k * 7 % 1900).cast("int").alias("h"), (100 + k * 13 % 2100).cast("int").alias("w"))


_UP = "CASE WHEN least(h, w) >= 256 THEN {0} ELSE round_even({0} * (256::DOUBLE / least(h, w)), 0)::INT END"


@query(f"WITH {_SIDES} SELECT id, {_UP.format('h')} AS new_h, {_UP.format('w')} AS new_w FROM q")
def d1_upscaled_size(spark, sf_dir):
    h, w = images.upscaled_size(F.col("h"), F.col("w"), 256)
    return _sides(spark, sf_dir).select("id", h.alias("new_h"), w.alias("new_w"))


def _resampled_sql(n: int, before: str, relation: str) -> str:
    """8 x 8 images ``id, y, x, v`` resampled to n x n as ``rs``: the kernel's weights as a table, across, then down, 8 bits between."""
    step = f"(8::DOUBLE / {n})"
    wide = f"greatest(1, {step})"
    kernel = "CASE WHEN a < 1 THEN (1.5::DOUBLE * a - 2.5::DOUBLE) * a * a + 1 WHEN a < 2 THEN ((-0.5::DOUBLE * a + 2.5::DOUBLE) * a - 4) * a + 2 ELSE 0 END"
    level = lambda x: f"least(greatest(floor({x} + (0.5::DOUBLE + 1e-9::DOUBLE)), 0), 255)"
    return (
        f"{before}b AS (SELECT id, y, x, round_even({U8}, 0) AS u FROM {relation}), "
        f"kn AS (SELECT o, i, abs((i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {step}) / {wide}) AS a FROM UNNEST(range({n})) AS t(o), UNNEST(range(8)) AS s(i)), "
        f"wt AS (SELECT o, i, ({kernel}) / sum({kernel}) OVER (PARTITION BY o) AS w FROM kn), "
        f"ac AS (SELECT id, y, o AS x, {level('sum(w * u)')} AS u FROM b JOIN wt ON b.x = wt.i GROUP BY id, y, o), "
        f"rs AS (SELECT id, {n} AS h, {n} AS w, o * {n} + x AS pos, {level('sum(wt.w * u)')} AS pixels FROM ac JOIN wt ON ac.y = wt.i GROUP BY id, o, x)"
    )


def _bicubic_sql(n: int) -> str:
    return _resampled_sql(n, f"{PX}, ", "px") + " " + dig("rs", "pixels", by="id, h, w")


@query("WITH " + _bicubic_sql(12))
def d1_upscale_short_side(spark, sf_dir):
    return digest(images.upscale_short_side(X.imgs_u8(spark, sf_dir), 12), "pixels", by=("id", "h", "w"))


@query("WITH " + _bicubic_sql(5))
def d2_resize_square(spark, sf_dir):
    return digest(images.resize_square(X.imgs_u8(spark, sf_dir), 5), "pixels", by=("id", "h", "w"))


@query(f"WITH {PX}, b AS (SELECT id, (y - 1) * 5 + x - 1 AS pos, v AS pixels FROM px WHERE y BETWEEN 1 AND 5 AND x BETWEEN 1 AND 5) " + dig("b", "pixels"))
def d3_center_crop(spark, sf_dir):
    return digest(images.center_crop(X.imgs(spark, sf_dir), 5), "pixels")


_HALVES = "(SELECT coalesce(max(k), 0) FROM UNNEST(range(1, 31)) AS u(k) WHERE least(h, w) // (1 << (k - 1)) >= 512)"


@query(f"WITH {_SIDES}, r AS (SELECT *, {_HALVES} AS times FROM q), s AS (SELECT *, h // (1 << times) AS hh, w // (1 << times) AS ww FROM r) SELECT id, round_even(hh * (256::DOUBLE / least(hh, ww)), 0)::INT AS new_h, round_even(ww * (256::DOUBLE / least(hh, ww)), 0)::INT AS new_w, times::INT AS times FROM s")
def d4_halved_size(spark, sf_dir):
    h, w, times = images.halved_size(F.col("h"), F.col("w"), 256)
    return _sides(spark, sf_dir).select("id", h.alias("new_h"), w.alias("new_w"), times.cast("int").alias("times"))


@query(
    f"WITH {PX}, b AS (SELECT id, y, x, round_even({U8}, 0) AS u FROM px), r AS (SELECT id, y, x // 2 AS x, floor(avg(u) + 0.5) AS u FROM b GROUP BY id, y, x // 2), "
    "s AS (SELECT id, y // 2 * 4 + x AS pos, floor(avg(u) + 0.5) AS pixels FROM r GROUP BY id, y // 2, x) " + dig("s", "pixels")
)
def d4_halving_center_crop(spark, sf_dir):
    return digest(images.halving_center_crop(X.imgs_u8(spark, sf_dir), 4), "pixels")


@query(
    f"WITH {PR}, o AS (SELECT *, floor({U(repr('9:top'), 'id')} * 4) AS top, floor({U(repr('9:left'), 'id')} * 4) AS lft FROM pr), "
    "b AS (SELECT id, (y - top) * 5 + x - lft AS pos, condition, target FROM o WHERE y BETWEEN top AND top + 4 AND x BETWEEN lft AND lft + 4) " + dig("b", "condition", "target")
)
def d5_random_crop_pair(spark, sf_dir):
    return digest(images.random_crop_pair(X.pairs(spark, sf_dir), 5, 9, ["condition", "target"]), "condition", "target")


@query(
    f"WITH {PR}, b AS (SELECT id, CASE WHEN {U(repr('9:vflip'), 'id')} < 0.5 THEN 7 - y ELSE y END * 8 + CASE WHEN {U(repr('9:hflip'), 'id')} < 0.5 THEN 7 - x ELSE x END AS pos, condition, target FROM pr) "
    + dig("b", "condition", "target")
)
def d6_flips(spark, sf_dir):
    both = ["condition", "target"]
    return digest(images.vflip(images.hflip(X.pairs(spark, sf_dir), 9, columns=both), 9, columns=both), *both)


@query(
    f"WITH {PX}, k AS (SELECT *, floor({U(repr('9:rot90'), 'id')} * 4) AS k FROM px), "
    "b AS (SELECT id, CASE k WHEN 1 THEN (7 - x) * 8 + y WHEN 2 THEN (7 - y) * 8 + 7 - x WHEN 3 THEN x * 8 + 7 - y ELSE y * 8 + x END AS pos, v AS pixels FROM k) " + dig("b", "pixels")
)
def d7_rot90(spark, sf_dir):
    return digest(images.rot90(X.imgs(spark, sf_dir), images.quarter_turns(9)), "pixels")


@query(f"WITH {PX}, b AS (SELECT id, y * 8 + CASE WHEN {U(repr('4:hflip'), 'id')} < 0.5 THEN 7 - x ELSE x END AS pos, v AS pixels FROM px) " + dig("b", "pixels"))
def d8_random_hflip(spark, sf_dir):
    return digest(images.random_hflip(X.imgs(spark, sf_dir), 4), "pixels")


@query(
    f"WITH {PR}, o AS (SELECT *, y - floor({U(repr('3:top'), 'id')} * 3) AS cy, x - floor({U(repr('3:left'), 'id')} * 3) AS cx, floor({U(repr('3:rot90'), 'id')} * 4) AS k FROM pr), "
    f"f AS (SELECT id, k, CASE WHEN {U(repr('3:vflip'), 'id')} < 0.5 THEN 5 - cy ELSE cy END AS y, CASE WHEN {U(repr('3:hflip'), 'id')} < 0.5 THEN 5 - cx ELSE cx END AS x, condition, target "
    "FROM o WHERE cy BETWEEN 0 AND 5 AND cx BETWEEN 0 AND 5), "
    "b AS (SELECT id, 6 AS h, 6 AS w, CASE k WHEN 1 THEN (5 - x) * 6 + y WHEN 2 THEN (5 - y) * 6 + 5 - x WHEN 3 THEN x * 6 + 5 - y ELSE y * 6 + x END AS pos, condition, target FROM f) "
    + dig("b", "condition", "target", by="id, h, w")
)
def d9_prepare_pairs(spark, sf_dir):
    return digest(images.prepare_pairs(X.pairs(spark, sf_dir), 6, True, 3), "condition", "target", by=("id", "h", "w"))


@query("WITH f AS (SELECT source, source || '/' || doc_id || '.jpg' AS rel FROM documents WHERE doc_id % 7 <> 0) SELECT rel, row_number() OVER (ORDER BY source, string_split(rel, '/')) - 1 AS idx FROM f")
def d10_reference_index(spark, sf_dir):
    """The listing part of the reference set: images numbered by class and path."""
    listed = sources.labeled(X.class_files(spark, sf_dir)).withColumn("parts", F.split("rel", "/"))
    return order.global_index(listed, ["label", "parts"]).select("rel", "idx")


@query(
    f"WITH {PX}, b AS (SELECT id, y, x, round_even({U8}, 0) AS u FROM px), r AS (SELECT id, y, x // 2 AS x, floor(avg(u) + 0.5) AS u FROM b GROUP BY id, y, x // 2), "
    "c AS (SELECT id, y // 2 * 4 + x AS pos, floor(avg(u) + 0.5) AS pixels FROM r GROUP BY id, y // 2, x), "
    "n AS (SELECT vec_id AS id, label, row_number() OVER (ORDER BY label::VARCHAR, label || '/' || vec_id || '.png') - 1 AS idx FROM embeddings), "
    "d AS (SELECT idx, 'transformed_' || lpad(idx::VARCHAR, 8, '0') || '.png' AS file_name, pos, pixels FROM c JOIN n USING (id)) " + dig("d", "pixels", by="idx, file_name")
)
def d10_reference_set(spark, sf_dir):
    """Images of all classes, cut to 4 x 4, numbered by class and path and written as files, whose pixels are read again."""
    rows = X.imgs_u8(spark, sf_dir).withColumn("class_name", F.col("label").cast("string")).drop("label")
    made = evaluate.reference_set(rows.withColumn("rel", F.concat("class_name", F.lit("/"), F.col("id").cast("string"), F.lit(".png"))), 4)
    return digest(made.withColumn("pixels", sinks.unpng("content")), "pixels", by=("idx", "file_name"))


@query(f"WITH {PX}, b AS (SELECT id, y // 2 * 4 + x // 2 AS patch, y % 2 * 2 + x % 2 AS pos, v AS \"values\" FROM px) " + dig("b", '"values"', by="id, patch").replace('"values"_', "values_"))
def d11_patchify(spark, sf_dir):
    return digest(images.patchify(X.imgs(spark, sf_dir), 2), "values", by=("id", "patch"))


@query(f"WITH {PX} " + dig("(SELECT id, pos, v AS pixels FROM px)", "pixels"))
def d12_unpatchify(spark, sf_dir):
    return digest(images.unpatchify(images.patchify(X.imgs(spark, sf_dir), 2), 2, 1), "pixels")


# E. Order, shards, batches, random numbers


@query("SELECT vec_id AS id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS idx FROM embeddings")
def e1_global_index(spark, sf_dir):
    return order.global_index(X.imgs(spark, sf_dir).select("id", "label"), ["label", "id"])


_SHUFFLED = "h AS (SELECT event_id AS id, row_number() OVER (ORDER BY md5('3:1:' || event_id), event_id) - 1 AS idx FROM events)"


def _shuffled(spark, sf_dir):
    return order.epoch_shuffle(X.table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), 3, 1)


@query(f"WITH {_SHUFFLED} SELECT * FROM h")
def e2_epoch_shuffle(spark, sf_dir):
    return _shuffled(spark, sf_dir)


@query(
    f"WITH {_SHUFFLED}, n AS (SELECT count(*) AS n FROM h), a AS (SELECT id, idx FROM h UNION ALL SELECT id, idx + n FROM h, n WHERE idx < (7 - n % 7) % 7) "
    "SELECT id, idx, (idx % 7)::INT AS shard, idx // 7 AS pos FROM a"
)
def e3_shard(spark, sf_dir):
    return order.shard(_shuffled(spark, sf_dir), 7, pad=True)


@query(
    f"WITH {_SHUFFLED}, s AS (SELECT id, (idx % 3)::INT AS shard, idx // 3 AS pos FROM h), f AS (SELECT shard, count(*) // 32 AS \"full\" FROM s GROUP BY shard) "
    'SELECT id, shard, pos, pos // 32 AS batch FROM s JOIN f USING (shard) WHERE pos // 32 < "full"'
)
def e4_batch(spark, sf_dir):
    return order.batch(order.shard(_shuffled(spark, sf_dir), 3), 32, True).select("id", "shard", "pos", "batch")


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS idx, ((row_number() OVER (ORDER BY vec_id) - 1) // ((SELECT count(*) FROM embeddings) // 10))::INT AS label FROM embeddings")
def e5_label_plan(spark, sf_dir):
    rows = order.global_index(X.imgs(spark, sf_dir).select("id"), ["id"])
    return order.label_plan(rows, 10, even=False)


@query(f"SELECT vec_id AS id, (CASE WHEN {U(repr('0:drop'), 'vec_id')} < 0.1 THEN 10 ELSE label END)::INT AS label FROM embeddings")
def e6_label_dropout(spark, sf_dir):
    return flow.label_dropout(X.imgs(spark, sf_dir).select("id", "label"), 0.1, 10, 0)


@query(f"SELECT event_id, {R(U(repr('7'), 'event_id', repr('a')), 9)} AS u, {R(N(repr('7'), 'event_id', repr('b')), 9)} AS n FROM events")
def e7_hash_random(spark, sf_dir):
    k = F.col("event_id")
    return X.table(spark, sf_dir, "events").select(k, rounded(hash_uniform(7, k, "a"), 9).alias("u"), rounded(hash_normal(7, k, "b"), 9).alias("n"))


_T = f"1 / (1 + exp(-({N(repr('0:t'), 'id')} * 0.8::DOUBLE + -0.8::DOUBLE)))"


@query(f"WITH e AS (SELECT vec_id AS id FROM embeddings) SELECT id, {R(_T, 9)} AS t FROM e")
def e8_sample_t(spark, sf_dir):
    return flow.sample_t(X.imgs(spark, sf_dir).select("id"), 0).select("id", rounded(F.col("t"), 9).alias("t"))


@query("SELECT event_id AS idx, event_id // 384 AS step, (event_id % 384 // 96)::INT AS rank, (event_id % 96)::INT AS slot FROM events")
def e9_generation_plan(spark, sf_dir):
    return order.generation_plan(X.table(spark, sf_dir, "events").select(F.col("event_id").alias("idx")), 96, 4)


# F. Noising


@query(f"WITH {PX}, b AS (SELECT id, pos, 2::DOUBLE * {N(repr('0:noise'), 'id', 'pos')} AS source FROM px) " + dig("b", "source"))
def f1_noise_source(spark, sf_dir):
    return digest(flow.add_noise_source(X.imgs(spark, sf_dir), 0, 2.0, "pixels"), "source")


@query(f"WITH {PR}, b AS (SELECT id, pos, condition + 0.05::DOUBLE * {N(repr('0:noise'), 'id', 'pos')} AS source FROM pr) " + dig("b", "source"))
def f2_bridge_source(spark, sf_dir):
    return digest(flow.bridge_source(X.pairs(spark, sf_dir), 0, "condition", 0.05), "source")


_EXAMPLES = (
    f"{PR}, t AS (SELECT id, {_T} AS t FROM (SELECT vec_id AS id FROM embeddings)), "
    f"g AS (SELECT pr.id, pos, (CASE WHEN {U(repr('0:drop'), 'pr.id')} < 0.1 THEN 10 ELSE label END)::INT AS label, t, target, {N(repr('0:noise'), 'pr.id', 'pos')} AS source FROM pr JOIN t ON pr.id = t.id), "
    "ex AS (SELECT *, t * target + (1 - t) * source AS z, (target - (t * target + (1 - t) * source)) / greatest(1 - t, 0.05::DOUBLE) AS v FROM g)"
)


def _examples(spark, sf_dir):
    return flow.make_training_examples(X.pairs(spark, sf_dir))


@query(f"WITH {_EXAMPLES} " + dig("ex", "z"))
def f3_interpolate(spark, sf_dir):
    return digest(_examples(spark, sf_dir), "z")


@query(f"WITH {_EXAMPLES} " + dig("ex", "v"))
def f4_velocity(spark, sf_dir):
    return digest(_examples(spark, sf_dir), "v")


@query(
    f"WITH {PR}, t AS (SELECT id, {_T} AS t FROM (SELECT vec_id AS id FROM embeddings)), b AS (SELECT pr.id, pos, (CASE WHEN {U(repr('0:drop'), 'pr.id')} < 0.1 THEN 10 ELSE label END)::INT AS label, "
    "t * target + (1 - t) * condition AS z, (target - (t * target + (1 - t) * condition)) / greatest(1 - t, 0.05::DOUBLE) AS v FROM pr JOIN t ON pr.id = t.id) "
    + dig("b", "z", "v", by="id, label")
)
def f5_training_examples(spark, sf_dir):
    return digest(flow.make_training_examples(X.pairs(spark, sf_dir), "restoration"), "z", "v", by=("id", "label"))


_ORDER = "md5('5:2:' || vec_id)"


@query(
    f"WITH {PX}, o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_ORDER}, vec_id) - 1 AS idx FROM embeddings), n AS (SELECT count(*) AS n FROM o), "
    "a AS (SELECT id, idx FROM o UNION ALL SELECT id, idx + n FROM o, n WHERE idx < (3 - n % 3) % 3), s AS (SELECT id, idx, (idx % 3)::INT AS shard, idx // 3 AS pos FROM a), "
    'f AS (SELECT shard, count(*) // 32 AS "full" FROM s GROUP BY shard), p AS (SELECT id, idx, shard, pos, pos // 32 AS batch FROM s JOIN f USING (shard) WHERE pos // 32 < "full"), '
    f"r AS (SELECT id, label, y, x // 2 AS x, floor(avg(round_even({U8}, 0)) + 0.5) AS u FROM px GROUP BY id, label, y, x // 2), "
    "c AS (SELECT id, label, y // 2 AS y, x, floor(avg(u) + 0.5) / 255 * 2 - 1 AS v FROM r GROUP BY id, label, y // 2, x), "
    f"m AS (SELECT id, label, y * 4 + CASE WHEN {U(repr('5.2:hflip'), 'id')} < 0.5 THEN 3 - x ELSE x END AS pos, v AS target FROM c), "
    f"t AS (SELECT vec_id AS id, 1 / (1 + exp(-({N(repr('5.2:t'), 'vec_id')} * 0.8::DOUBLE - 0.8::DOUBLE))) AS t FROM embeddings), "
    f"b AS (SELECT id, (CASE WHEN {U(repr('5.2:drop'), 'id')} < 0.1 THEN 10 ELSE label END)::INT AS label, t, m.pos AS place, t * target + (1 - t) * {N(repr('5.2:noise'), 'id', 'm.pos')} AS z, target FROM m JOIN t USING (id)), "
    "e AS (SELECT id, label, t, place, z, (target - z) / greatest(1 - t, 0.05::DOUBLE) AS v FROM b), "
    f"d AS ({dig('e', 'z', 'v', by='id, label, t', pos='place')}) SELECT idx, shard, p.pos, batch, id, label, {R('t')} AS t, z_sum, z_pos, v_sum, v_pos FROM d JOIN p USING (id)"
)
def f5_training_batches(spark, sf_dir):
    """An epoch from images in class folders to the noised examples of each worker's batches."""
    rows = X.imgs_u8(spark, sf_dir).withColumn("class_name", F.col("label").cast("string")).drop("label")
    made = training.training_batches(pairing.class_index(rows), 2, 5, 3, 32, 10, size=4)
    return digest(made.withColumn("t", rounded(F.col("t"))), "z", "v", by=("idx", "shard", "pos", "batch", "id", "label", "t"))


# G. Losses and metrics


def _scored(spark, sf_dir):
    """The condition stands for the prediction, and a mix with the target for the restored image."""
    return X.pairs(spark, sf_dir).withColumn("pred", A.interpolate("target", "condition", 0.25)).withColumn("v", F.col("target")).withColumn("v_hat", F.col("condition"))


_SCORED = f"{PR}, sc AS (SELECT id, pos, y, x, target, condition, 0.25::DOUBLE * target + (1 - 0.25::DOUBLE) * condition AS pred FROM pr)"


@query(f"WITH {_SCORED} SELECT id, {R('avg((target - condition) * (target - condition))', 8)} AS mse FROM sc GROUP BY id")
def g1_velocity_mse(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", rounded(metrics.velocity_mse(), 8).alias("mse"))


@query(f"WITH {_SCORED} SELECT id, {R('avg(abs(pred - target))', 8)} AS l1 FROM sc GROUP BY id")
def g2_l1_recon(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", rounded(metrics.l1_recon(), 8).alias("l1"))


@query(f"WITH {_SCORED} SELECT id, {R('avg(abs((pred - condition) - (target - condition)))', 8)} AS l1 FROM sc GROUP BY id")
def g3_l1_residual(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", rounded(metrics.l1_residual(), 8).alias("l1"))


_BOX = (
    f"{_SCORED}, un AS (SELECT id, y, x, least(greatest((pred + 1) / 2, 0), 1) AS a, least(greatest((target + 1) / 2, 0), 1) AS b FROM sc), "
    "bx AS (SELECT p.id, p.y, p.x, sum(q.a) / 9 AS ma, sum(q.b) / 9 AS mb, sum(q.a * q.a) / 9 AS aa, sum(q.b * q.b) / 9 AS bb, sum(q.a * q.b) / 9 AS ab "
    "FROM un p JOIN un q ON p.id = q.id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY p.id, p.y, p.x), "
    "ss AS (SELECT id, avg(least(greatest(1 - (2 * ma * mb + 0.0001::DOUBLE) * (2 * (ab - ma * mb) + 0.0009::DOUBLE) / "
    "((ma * ma + mb * mb + 0.0001::DOUBLE) * (aa - ma * ma + bb - mb * mb + 0.0009::DOUBLE)), 0), 2)) AS ssim FROM bx GROUP BY id)"
)


@query(f"WITH {_BOX} SELECT id, {R('ssim', 8)} AS ssim FROM ss")
def g4_ssim_loss(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", rounded(metrics.ssim_loss(), 8).alias("ssim"))


_SOBEL = (
    "df AS (SELECT id, y, x, pred - target AS e FROM sc), "
    "sb AS (SELECT p.id, p.y, p.x, sum(q.e * (q.x - p.x) * CASE WHEN q.y = p.y THEN 2 ELSE 1 END) / 8 AS gx, sum(q.e * (q.y - p.y) * CASE WHEN q.x = p.x THEN 2 ELSE 1 END) / 8 AS gy "
    "FROM df p JOIN df q ON p.id = q.id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY p.id, p.y, p.x), "
    "gr AS (SELECT id, avg(abs(gx)) + avg(abs(gy)) AS gradient FROM sb GROUP BY id)"
)


@query(f"WITH {_SCORED}, {_SOBEL} SELECT id, {R('gradient', 8)} AS gradient FROM gr")
def g5_gradient_loss(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", rounded(metrics.gradient_loss(), 8).alias("gradient"))


@query(
    f"WITH {_BOX}, {_SOBEL}, b AS (SELECT id, avg((target - condition) * (target - condition)) AS m, avg(abs(pred - target)) AS l, avg(abs((pred - condition) - (target - condition))) AS r FROM sc GROUP BY id) "
    f"SELECT id, {R('m + l + 0.2::DOUBLE * r + 0.1::DOUBLE * ssim + 0.05::DOUBLE * gradient', 8)} AS loss FROM b JOIN ss USING (id) JOIN gr USING (id)"
)
def g6_total_loss(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", rounded(metrics.total_loss(), 8).alias("loss"))


def _psnr_sql(pred: str, relation: str, by: str = "id") -> str:
    unit = lambda c: f"least(greatest(({c} + 1) / 2, 0), 1)"
    return f"SELECT {by}, -10 * log10(greatest(avg(({unit(pred)} - {unit('target')}) * ({unit(pred)} - {unit('target')})), 1e-10)) AS psnr FROM {relation} GROUP BY {by}"


@query(f"WITH {_SCORED}, q AS ({_psnr_sql('pred', 'sc')}) SELECT id, {R('psnr')} AS psnr FROM q")
def g7_psnr(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", rounded(metrics.psnr()).alias("psnr"))


@query(f"WITH {PR}, q AS ({_psnr_sql('condition', 'pr', 'id, label')}) SELECT label, count(*) AS n, {R('avg(psnr)')} AS psnr FROM q GROUP BY label")
def g8_mean_psnr(spark, sf_dir):
    scored = X.pairs(spark, sf_dir).select("label", metrics.psnr("condition", "target").alias("psnr"))
    return metrics.mean_psnr(scored, "label").withColumn("psnr", rounded(F.col("psnr")))


@query(f"WITH {PX} SELECT a.pos AS i, b.pos AS j, {R('avg(a.v)', 8)} AS mean_i, {R('covar_samp(a.v, b.v)', 8)} AS cov FROM px a JOIN px b ON a.id = b.id GROUP BY a.pos, b.pos")
def g9_feature_moments(spark, sf_dir):
    rows = metrics.covariance_rows(X.imgs(spark, sf_dir), "pixels")
    return rows.select("i", "j", rounded(F.col("mean_i"), 8).alias("mean_i"), rounded(F.col("cov"), 8).alias("cov"))


def _frechet_sql(steps: int) -> str:
    """The trace of the root of the product of both covariances by Newton and Schulz: Y goes to the root, Z to its inverse."""
    times = lambda a, b: f"SELECT {a}.i, {b}.j, sum({a}.v * {b}.v) AS v FROM {a} JOIN {b} ON {a}.j = {b}.i GROUP BY {a}.i, {b}.j"
    parts = [
        PX,
        *(f"{n} AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, covar_samp(a.v, b.v) AS v, avg(a.v) AS m FROM px a JOIN px b ON a.id = b.id AND a.id % 2 = {k} GROUP BY a.pos, b.pos)" for n, k in (("ca", 0), ("cb", 1))),
        f"mm AS MATERIALIZED ({times('ca', 'cb')})", "nn AS MATERIALIZED (SELECT sqrt(sum(v * v)) AS n FROM mm)",
        "y0 AS MATERIALIZED (SELECT i, j, v / n AS v FROM mm, nn)", "z0 AS MATERIALIZED (SELECT i, j, (i = j)::INT::DOUBLE AS v FROM mm)",
    ]
    for k in range(steps):
        parts += [f"p{k} AS MATERIALIZED ({times(f'z{k}', f'y{k}')})", f"t{k} AS MATERIALIZED (SELECT i, j, ((i = j)::INT * 3::DOUBLE - v) / 2 AS v FROM p{k})"]
        parts += [f"y{k + 1} AS MATERIALIZED ({times(f'y{k}', f't{k}')})", f"z{k + 1} AS MATERIALIZED ({times(f't{k}', f'z{k}')})"]
    means = "(SELECT sum((ca.m - cb.m) * (ca.m - cb.m) + ca.v + cb.v) FROM ca JOIN cb USING (i, j) WHERE i = j)"
    return f"WITH {', '.join(parts)} SELECT 'even' AS a, 'odd' AS b, {R(f'{means} - 2 * sqrt(n) * (SELECT sum(v) FROM y{steps} WHERE i = j)')} AS distance FROM nn"


@query(_frechet_sql(20))
def g10_frechet_distance(spark, sf_dir):
    rows = X.imgs(spark, sf_dir).select("id", F.col("pixels").alias("f"))
    even, odd = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    return spark.createDataFrame([("even", "odd", metrics.frechet_distance(even, odd))], "a string, b string, distance double").withColumn("distance", rounded(F.col("distance")))


_SOFT = "sx AS (SELECT id, pos, v, exp(v - max(v) OVER (PARTITION BY id)) AS e FROM px WHERE pos < 10), pb AS (SELECT id, pos, e / sum(e) OVER (PARTITION BY id) AS p FROM sx)"


def _probs(spark, sf_dir):
    return X.imgs(spark, sf_dir).select("id", A.softmax(F.slice("pixels", 1, 10)).alias("p"))


@query(
    f"WITH {PX}, {_SOFT}, mg AS (SELECT id % 3 AS split, pos, avg(p) AS q FROM pb GROUP BY 1, 2), kl AS (SELECT id, id % 3 AS split, sum(p * ln(p / q)) AS d FROM pb JOIN mg ON pb.id % 3 = mg.split AND pb.pos = mg.pos GROUP BY id) "
    f"SELECT split, {R('exp(avg(d))', 8)} AS score FROM kl GROUP BY split"
)
def g11_inception_score(spark, sf_dir):
    return metrics.inception_score(_probs(spark, sf_dir), split=F.col("id") % 3).withColumn("score", rounded(F.col("score"), 8))


@query(f"WITH {PX}, {_SOFT} " + dig("pb", "p", digits=8))
def g12_softmax(spark, sf_dir):
    return digest(_probs(spark, sf_dir), "p", digits=8)


@query(f"WITH {PX}, {_MEANS} " + dig("c", "mu", "var", by="label"))
def g13_class_gaussian(spark, sf_dir):
    return digest(_stats(spark, sf_dir), "mu", "var", by=("label",))


# H. Batch scoring


def _with_stats(spark, sf_dir, numbered=False):
    """Pairs that have a label, beside its Gaussian, and an array of the images' size. All pairs are numbered before, if asked for."""
    rows = X.pairs(spark, sf_dir)
    rows = order.global_index(rows, ["id"]) if numbered else rows
    blank = F.array_repeat(F.lit(0.0), F.col("h") * F.col("w") * F.col("c"))
    return scoring.with_class_gaussian(rows.where("label is not null").withColumn("blank", blank), _stats(spark, sf_dir), 10)


def _v_sql(z: str, t: float, scale: float, low: float, high: float) -> str:
    """Guided velocity under the class Gaussians, for one pixel."""
    of = lambda m, s: f"(({m} + {t!r}::DOUBLE * {s} / ({t!r}::DOUBLE * {t!r}::DOUBLE * {s} + (1 - {t!r}::DOUBLE) * (1 - {t!r}::DOUBLE)) * ({z} - {t!r}::DOUBLE * {m})) - {z}) / greatest(1 - {t!r}::DOUBLE, 0.05::DOUBLE)"
    if scale == 1.0:
        return of("mu", "var")
    g = scale if t < high and (low == 0 or t > low) else 1.0
    return f"({of('nmu', 'nvar')} + {g}::DOUBLE * ({of('mu', 'var')} - {of('nmu', 'nvar')}))"


def _sampled_sql(source: str, method: str, steps: int, scale: float = 1.0, low: float = 0.0, high: float = 1.0) -> str:
    """CTEs z0, z1, ... for the steps of a sampler."""
    base = (
        f"{PR}, {_MEANS}, z0 AS MATERIALIZED (SELECT pr.id, pr.pos, pr.label, target, condition, c.mu, c.var, n.mu AS nmu, n.var AS nvar, {source} AS z "
        "FROM pr JOIN c ON pr.label = c.label AND pr.pos = c.pos JOIN c n ON n.label = 10 AND n.pos = pr.pos)"
    )
    out, keep = [base], "id, pos, label, target, condition, mu, var, nmu, nvar"
    for k in range(steps):
        t, u = k / steps, (k + 1) / steps
        last = method == "euler" or k == steps - 1
        out.append(f"e{k} AS MATERIALIZED (SELECT {keep}, z, {_v_sql('z', t, scale, low, high)} AS a FROM z{k})")
        if last:
            out.append(f"z{k + 1} AS MATERIALIZED (SELECT {keep}, z + ({u!r}::DOUBLE - {t!r}::DOUBLE) * a AS z FROM e{k})")
        else:
            out.append(f"f{k} AS MATERIALIZED (SELECT {keep}, z, a, z + ({u!r}::DOUBLE - {t!r}::DOUBLE) * a AS y FROM e{k})")
            out.append(f"z{k + 1} AS MATERIALIZED (SELECT {keep}, z + ({u!r}::DOUBLE - {t!r}::DOUBLE) * 0.5 * (a + {_v_sql('y', u, scale, low, high)}) AS z FROM f{k})")
    return ", ".join(out)


_START = "z0 AS (SELECT pr.id, pr.pos, pr.label, c.mu, c.var, n.mu AS nmu, n.var AS nvar, condition AS z FROM pr JOIN c ON pr.label = c.label AND pr.pos = c.pos JOIN c n ON n.label = 10 AND n.pos = pr.pos)"


@query(f"WITH {PR}, {_MEANS}, {_START}, b AS (SELECT id, pos, {_v_sql('z', 0.25, 2.5, 0.1, 0.9)} AS guided FROM z0) " + dig("b", "guided"))
def h2_guided_velocity(spark, sf_dir):
    v = scoring.guided_velocity(scoring.predictor("class_gaussian"), 10, 2.5, 0.1, 0.1, 0.9)
    return digest(_with_stats(spark, sf_dir).withColumn("guided", v(F.col("condition"), F.lit(0.25))), "guided")


@query(f"WITH {PR}, {_MEANS}, {_START}, b AS (SELECT id, pos, z + 0.25::DOUBLE * {_v_sql('z', 0.25, 1.0, 0, 1)} AS z FROM z0) " + dig("b", "z"))
def h3_euler_step(spark, sf_dir):
    v = scoring.guided_velocity(scoring.predictor("class_gaussian"), 10)
    return digest(_with_stats(spark, sf_dir).withColumn("z", scoring.euler_step(v, F.col("condition"), F.lit(0.25), F.lit(0.5))), "z")


@query(
    f"WITH {PR}, {_MEANS}, {_START}, e AS (SELECT *, {_v_sql('z', 0.25, 1.0, 0, 1)} AS a FROM z0), f AS (SELECT *, z + 0.25::DOUBLE * a AS y FROM e), "
    f"b AS (SELECT id, pos, z + 0.25::DOUBLE * 0.5 * (a + {_v_sql('y', 0.5, 1.0, 0, 1)}) AS z FROM f) " + dig("b", "z")
)
def h4_heun_step(spark, sf_dir):
    v = scoring.guided_velocity(scoring.predictor("class_gaussian"), 10)
    return digest(_with_stats(spark, sf_dir).withColumn("z", scoring.heun_step(v, F.col("condition"), F.lit(0.25), F.lit(0.5))), "z")


@query(f"WITH {_sampled_sql(N(repr('0:noise'), 'pr.id', 'pr.pos'), 'heun', 4, 2.0, 0.1, 0.9)} " + dig("(SELECT id, pos, z AS pixels FROM z4)", "pixels"))
def h5_generate(spark, sf_dir):
    """The class Gaussians as a callable over stacks, with noise by id made beside them."""
    rows = _with_stats(spark, sf_dir).select("id", "label", "blank", "mu", "var", "mu_null", "var_null")
    out = scoring.generate_with(rows, scoring.class_gaussian_arrays(), 10, "heun", 4, 2.0, low=0.1, high=0.9, like="blank", carry=("mu", "var", "mu_null", "var_null"))
    return digest(out, "pixels")


@query(f"WITH {_sampled_sql('condition', 'heun', 3)} " + dig("(SELECT id, pos, z AS pixels FROM z3)", "pixels"))
def h6_restore(spark, sf_dir):
    return digest(scoring.restore(_with_stats(spark, sf_dir), scoring.predictor("class_gaussian"), 10, "heun", 3), "pixels")


@query(
    f"WITH {_sampled_sql(N(repr('0:noise'), 'pr.id', 'pr.pos'), 'euler', 3)}, u AS (SELECT id, pos, round_even({U8.replace('v', 'z')}, 0) AS u8 FROM z3), d AS ({dig('u', 'u8')}), "
    "k AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings) "
    "SELECT idx, lpad(idx::VARCHAR, 5, '0') || '.png' AS file_name, idx // 64 AS step, (idx % 64 // 32)::INT AS rank, (idx % 32)::INT AS slot, u8_sum, u8_pos FROM d JOIN k USING (id)"
)
def h7_evaluate_generation(spark, sf_dir):
    """Images generated for every embedding's label, with their file names; the scores go to the metric log."""
    rows = _with_stats(spark, sf_dir, numbered=True)
    made, _ = evaluate.evaluate_generation(
        rows, scoring.predictor("class_gaussian"), lambda px: F.slice(px, 1, 10), None, 10, 32, 2, log=scratch(spark, "metric-log"), steps=3, method="euler", like="blank"
    )
    return digest(made, "u8", by=("idx", "file_name", "step", "rank", "slot"))


@query(f"WITH {_sampled_sql('condition', 'heun', 3)}, q AS ({_psnr_sql('z', 'z3', 'id, label')}) SELECT label, count(*) AS n, {R('avg(psnr)')} AS psnr FROM q GROUP BY label")
def h8_evaluate_restoration(spark, sf_dir):
    _, scores = evaluate.evaluate_restoration(_with_stats(spark, sf_dir), scoring.predictor("class_gaussian"), 10, "label", steps=3)
    return scores.withColumn("psnr", rounded(F.col("psnr")))


@query(
    "WITH "
    + _resampled_sql(12, f"{PR}, ", f"(SELECT id || ':c' AS id, label, y, x, condition AS v FROM pr UNION ALL SELECT id || ':t', label, y, x, target FROM pr)")
    + ", two AS (SELECT string_split(id, ':')[1]::BIGINT AS id, pos, max(pixels) FILTER (id LIKE '%c') AS pixels, max(pixels) FILTER (id LIKE '%t') AS target FROM rs GROUP BY ALL), "
    + "q AS (SELECT id, -10 * log10(greatest(avg((pixels - target) * (pixels - target) / 65025::DOUBLE), 1e-10)) AS psnr FROM two GROUP BY id), "
    + "n AS (SELECT id, label || '/' || id || '.png' AS rel, row_number() OVER (ORDER BY label::VARCHAR, id || '.png') - 1 AS idx FROM (SELECT vec_id AS id, label FROM embeddings)), "
    + "d AS ("
    + dig("two", "pixels")
    + f") SELECT lpad((idx // 64)::VARCHAR, 5, '0') || '_' || (idx % 64 // 32) || '_' || replace(replace(rel, '/', '__'), '.png', '') || '.png' AS file_name, rel AS id, {R('psnr')} AS psnr, pixels_sum, pixels_pos FROM d JOIN q USING (id) JOIN n USING (id)"
)
def h8_restore_folder(spark, sf_dir):
    """From files to files: noisy 8 x 8 images are scaled to 12, restored (by a predictor that hands them back), scored and exported."""
    root, out = scratch(spark, "folder"), scratch(spark, "restored")
    rel = F.concat(F.col("label").cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".png"))
    for role, column in (("rainy", "condition"), ("clean", "target")):
        levels = X.pairs(spark, sf_dir).withColumns({"pixels": A.denormalize_u8(column), "file_name": F.concat(F.lit(f"val/{role}/"), rel)})
        files.save_files(sinks.export_images(levels), root)
    images, _ = evaluate.restore_folder(spark, root, 12, scoring.predictor("condition"), 10, out=out, batch=32, world=2, steps=2)
    scores = images.select(F.col("id"), rounded(F.col("psnr")).alias("psnr"), sinks.export_name("flat", F.col("id"), batch=F.col("step"), rank=F.col("rank")).alias("name"))
    made = files.saved_files(spark, out).withColumn("pixels", F.transform(sinks.unpng("content"), lambda x: x))
    grey = made.withColumn("pixels", F.filter("pixels", lambda _, i: i % 3 == 0))
    return digest(grey, "pixels", by=("file_name",)).join(scores, F.col("file_name") == F.col("name")).drop("name")


@query(
    f"WITH {_sampled_sql(N(repr('0:noise'), 'pr.id', 'pr.pos'), 'euler', 3)}, ft AS (SELECT id, pos, z AS v FROM z3 WHERE pos < 10), "
    "sx AS (SELECT id, pos, exp(v - max(v) OVER (PARTITION BY id)) AS e FROM ft), pb AS (SELECT id, pos, e / sum(e) OVER (PARTITION BY id) AS p FROM sx), "
    "mg AS (SELECT pos, avg(p) AS q FROM pb GROUP BY pos), kl AS (SELECT id, sum(p * ln(p / q)) AS d FROM pb JOIN mg USING (pos) GROUP BY id), "
    "fr AS (SELECT avg(v) AS m, var_samp(v) AS s FROM ft GROUP BY pos) "
    f"SELECT 'inception' AS tag, {R('exp(avg(d))')} AS value FROM kl UNION ALL SELECT 'frechet', {R('sum((m - 0.25::DOUBLE) * (m - 0.25::DOUBLE) + s)')} FROM fr"
)
def h7_generation_scores(spark, sf_dir):
    """Both scores, from the log. The stored statistics are a point (no spread), which SQL can follow."""
    rows, log = _with_stats(spark, sf_dir, numbered=True), scratch(spark, "metric-log")
    stats = spark.createDataFrame([(8, [0.25] * 10, [[0.0] * 10] * 10)], "res int, mu array<double>, sigma array<array<double>>")
    evaluate.evaluate_generation(rows, scoring.predictor("class_gaussian"), lambda px: F.slice(px, 1, 10), stats, 10, 32, 2, res=8, log=log, steps=3, method="euler", like="blank")
    return sinks.read_metric_log(spark, log).select("tag", rounded(F.col("value")).alias("value"))


# I. Meters

_W20 = "OVER (PARTITION BY meter ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_ROLLING = f"SELECT meter, step, list_sort(list(value) {_W20}) AS l, avg(value) {_W20} AS mean, max(value) {_W20} AS max, value AS latest, sum(value * n) OVER (PARTITION BY meter ORDER BY step) / sum(n) OVER (PARTITION BY meter ORDER BY step) AS g FROM m"


@query(f"WITH {METRICS}, r AS ({_ROLLING}) SELECT meter, step, l[(len(l) + 1) // 2] AS median, {R('mean')} AS mean, max, latest FROM r")
def i1_rolling_meters(spark, sf_dir):
    return meters.rolling_meters(X.metric_rows(spark, sf_dir)).withColumn("mean", rounded(F.col("mean")))


@query(f"WITH {METRICS}, r AS ({_ROLLING}) SELECT meter, step, {R('g * pi()', 8)} AS global_avg_pi FROM r")
def i2_global_average(spark, sf_dir):
    out = meters.global_average(X.metric_rows(spark, sf_dir))
    return out.select("meter", "step", rounded(F.col("global_avg") * F.pi(), 8).alias("global_avg_pi"))  # so that no value is a rounding tie


@query(f"WITH {METRICS} SELECT meter, sum(n)::BIGINT AS count, {R('sum(value * n)', 4)} AS total, {R('sum(value * n) / sum(n)')} AS global_avg FROM m GROUP BY meter")
def i3_merge_shards(spark, sf_dir):
    return meters.merge_shards(X.metric_rows(spark, sf_dir)).withColumns({"total": rounded(F.col("total"), 4), "global_avg": rounded(F.col("global_avg"))})


@query(f"WITH {METRICS} SELECT 'all' AS meter, step // 4 AS step, {R('avg(value)')} AS value, count(*) AS ranks FROM m GROUP BY step // 4")
def i4_cross_rank_mean(spark, sf_dir):
    rows = X.metric_rows(spark, sf_dir).select(F.lit("all").alias("meter"), F.floor(F.col("step") / 4).alias("step"), "value")
    return meters.cross_rank_mean(rows).withColumn("value", rounded(F.col("value")))


@query(f"WITH {METRICS} SELECT step, value, floor((step % 130 / 130::DOUBLE + step // 130) * 1000)::BIGINT AS x FROM m WHERE step % 130 % 10 = 0")
def i5_thin_log(spark, sf_dir):
    return meters.thin_log(X.metric_rows(spark, sf_dir).select("step", "value"), 10, 130)


@query(
    f"WITH {METRICS}, a AS (SELECT meter, step, row_number() OVER w - 1 AS iteration, count(*) OVER (PARTITION BY meter) AS rows, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS iter_s, "
    "CASE WHEN lag(epoch_us(ts)) OVER w IS NOT NULL THEN greatest(0, epoch_us(ts) - 1000000 * (step % 7) - lag(epoch_us(ts)) OVER w) / 1e6 END AS data_s FROM m WINDOW w AS (PARTITION BY meter ORDER BY step)), "
    "b AS (SELECT *, avg(iter_s) OVER w AS mean_s, avg(data_s) OVER w AS mean_data_s, coalesce(sum(iter_s) OVER w, 0) AS total_s FROM a WINDOW w AS (PARTITION BY meter ORDER BY step ROWS UNBOUNDED PRECEDING)) "
    f"SELECT meter, step, iteration, {R('iter_s')} AS iter_s, {R('mean_s')} AS mean_s, {R('mean_s * (rows - iteration)', 3)} AS eta_s, {R('data_s')} AS data_s, {R('mean_data_s')} AS mean_data_s, {R('total_s')} AS total_s, {R('total_s / (iteration + 1)')} AS s_per_it "
    "FROM b WHERE iteration % 50 = 0 OR iteration = rows - 1"
)
def i6_progress(spark, sf_dir):
    """Events as ends of iterations, whose data came up to six seconds before."""
    loaded = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - 1_000_000 * (F.col("step") % 7))
    out = meters.progress(X.metric_rows(spark, sf_dir).select("meter", "step", "ts", loaded.alias("loaded")), 50)
    names = ("iter_s", "mean_s", "data_s", "mean_data_s", "total_s", "s_per_it")
    return out.withColumns({c: rounded(F.col(c)) for c in names} | {"eta_s": rounded(F.col("eta_s"), 3)})


@query(
    f"WITH {METRICS}, r AS ({_ROLLING}), k AS (SELECT meter, arg_max(l[(len(l) + 1) // 2], step) AS median, arg_max(g, step) AS global_avg FROM r GROUP BY meter) "
    "SELECT string_agg(format('{}: {:.4f} ({:.4f})', meter, median, global_avg), '  ' ORDER BY meter) AS line FROM k"
)
def i7_format_meters(spark, sf_dir):
    rows = X.metric_rows(spark, sf_dir)
    both = meters.rolling_meters(rows).join(meters.global_average(rows), ["meter", "step"])
    last = both.groupBy("meter").agg(F.max_by("median", "step").alias("median"), F.max_by("global_avg", "step").alias("global_avg"))
    return meters.format_meters(last)


def _live(spark, sf_dir):
    """The events as a stream of metrics."""
    events = X.table(spark, sf_dir, "events")
    folder, name = sf_dir.rstrip("/"), "event[s].parquet"  # a stream wants a folder or a pattern
    live = spark.readStream.schema(events.schema).parquet(f"{folder}/{name}")
    k = F.col("event_id")
    return live.select(F.col("event_type").alias("meter"), k.alias("step"), "value", (1 + k % 3).alias("n"))


def _run(spark, writer):
    """Run a stream's writer over all that is there."""
    writer.option("checkpointLocation", scratch(spark, "stream-marks")).trigger(availableNow=True).start().awaitTermination()


@query(
    f"WITH {METRICS}, r AS ({_ROLLING}) SELECT meter, step, l[(len(l) + 1) // 2] AS median, {R('mean')} AS mean, max, latest, {R('g * pi()', 8)} AS global_avg_pi, 0::BIGINT AS late FROM r"
)
def i8_stream_meters(spark, sf_dir):
    path = scratch(spark, "stream")
    _run(spark, streams.stream_meters(_live(spark, sf_dir), path, delay=50))
    streams.finish(spark, path)
    out = streams.read_meters(spark, path)
    return out.withColumns({"mean": rounded(F.col("mean")), "global_avg_pi": rounded(F.col("global_avg") * F.pi(), 8)}).drop("global_avg")


@query("SELECT event_type AS meter, event_id AS step FROM events WHERE event_id % 97 = 3")
def i9_stream_alert(spark, sf_dir):
    """Alerts are logged by micro-batch, once each."""
    broken = _live(spark, sf_dir).withColumn("value", F.when(F.col("step") % 97 == 3, float("nan")).otherwise(F.col("value")))
    path = scratch(spark, "alerts")
    log = lambda batch, number: sinks.write_metric_log(batch.select(F.col("meter").alias("tag"), "value", "step"), path, number)
    _run(spark, streams.stream_alert(broken, log))
    return sinks.read_metric_log(spark, path).select(F.col("tag").alias("meter"), "step")


# J. Schedules and parameters

_LR = "CASE WHEN e < 5 THEN 0.0004::DOUBLE * e / 5 ELSE 0.00001::DOUBLE + (0.0004::DOUBLE - 0.00001::DOUBLE) * 0.5 * (1 + cos(pi() * (e - 5) / (60 - 5))) END"


@query(f"WITH i AS (SELECT event_id, event_id % 200 / 200::DOUBLE + (event_id // 200) % 60 AS e FROM events) SELECT event_id, {R(_LR, 10)} AS lr FROM i")
def j1_learning_rate(spark, sf_dir):
    k = F.col("event_id")
    rows = X.table(spark, sf_dir, "events").select(k, (k % 200 / 200.0 + F.floor(k / 200) % 60).alias("epoch"))
    return params.learning_rate(rows, 4e-4, 1e-5, 5, 60, "cosine").select("event_id", rounded(F.col("lr"), 10).alias("lr"))


@query(f"WITH {_GROUPS} SELECT name, decay FROM g")
def j2_parameter_groups(spark, sf_dir):
    return _grouped(spark, sf_dir)


@query(f"WITH {_GROUPS} SELECT name, {R('0.001::DOUBLE * CASE WHEN decay > 0 THEN 0.5 ELSE 1 END', 8)} AS lr FROM g")
def j4_group_lr(spark, sf_dir):
    rows = c7_attach_group_config(spark, sf_dir).withColumn("lr", F.lit(0.001))
    return params.group_lr(rows).select("name", rounded(F.col("lr"), 8).alias("lr"))


@query(f"WITH {_LAST}, e AS (SELECT name, idx, {_ema_sql(0.9999, 'ema1')}, {_ema_sql(0.9996, 'ema2')} FROM l GROUP BY name, idx) SELECT name, idx, {R('ema1', 4)} AS ema1, {R('ema2', 4)} AS ema2 FROM e")
def j6_ema(spark, sf_dir):
    return params.two_emas(X.snapshots(spark, sf_dir)).withColumns({c: rounded(F.col(c), 4) for c in ("ema1", "ema2")})


@query(f"WITH {PARAMS} SELECT {R('sum(list_product(shape)) / 1e6', 9)} AS millions FROM p WHERE trainable")
def j7_parameter_count(spark, sf_dir):
    return params.parameter_count(X.params(spark, sf_dir)).withColumn("millions", rounded(F.col("millions"), 9))


# K. Encodings


@query(
    "WITH k AS (SELECT event_id AS id, i::INT AS i, value * exp(-ln(10000::DOUBLE) * i / 8) AS a FROM events, UNNEST(range(8)) AS u(i)), "
    "b AS (SELECT id, i AS pos, cos(a) AS enc FROM k UNION ALL SELECT id, 8 + i, sin(a) FROM k) " + dig("b", "enc")
)
def k1_sinusoidal_encode(spark, sf_dir):
    return digest(X.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), A.sinusoidal_encode("value", 17).alias("enc")), "enc")


@query(
    "WITH k AS (SELECT event_id AS id, i::INT AS i, event_id % 16 * exp(-ln(10000::DOUBLE) * i / 4) AS a, event_id // 16 % 16 * exp(-ln(10000::DOUBLE) * i / 4) AS b FROM events, UNNEST(range(4)) AS u(i)), "
    "g AS (SELECT id, i AS pos, sin(a) AS enc FROM k UNION ALL SELECT id, 4 + i, cos(a) FROM k UNION ALL SELECT id, 8 + i, sin(b) FROM k UNION ALL SELECT id, 12 + i, cos(b) FROM k) " + dig("g", "enc")
)
def k2_grid_encode(spark, sf_dir):
    k = F.col("event_id")
    return digest(X.table(spark, sf_dir, "events").select(k.alias("id"), A.grid_encode(F.floor(k / 16) % 16, k % 16, 16).alias("enc")), "enc")


# M. What users add, and SQL


@query(
    f"WITH {PX}, b AS (SELECT id, y, x, round_even({U8}, 0) AS u FROM px), r AS (SELECT id, y, x // 2 AS x, floor(avg(u) + 0.5) AS u FROM b GROUP BY id, y, x // 2), "
    "s AS (SELECT id, y // 2 * 4 + x AS pos, 255 - floor(avg(u) + 0.5) AS pixels FROM r GROUP BY id, y // 2, x) " + dig("s", "pixels")
)
def m1_transform_hook(spark, sf_dir):
    """A user's function on each image, in the pass that scales and cuts it."""
    return digest(images.halving_center_crop(X.imgs_u8(spark, sf_dir), 4, lambda image: 255 - image), "pixels")


@scoring.register_predictor("scaled")
def _scaled(factor: float = 0.5) -> scoring.Predictor:
    """Predicts a part of the state: a user's predictor, known by name."""
    return lambda z, t, label, condition: F.transform(z, lambda x: x * factor)


_SCALED = "(0.25::DOUBLE * z - z)"


@query(
    f"WITH {PR}, z0 AS (SELECT id, pos, {N(repr('0:noise'), 'id', 'pos')} AS z FROM pr), z1 AS (SELECT id, pos, z + 0.5::DOUBLE * {_SCALED} AS z FROM z0), "
    f"z2 AS (SELECT id, pos, z + 0.5::DOUBLE * ({_SCALED} / 0.5::DOUBLE) AS pixels FROM z1) " + dig("z2", "pixels")
)
def m2_predictor_registry(spark, sf_dir):
    rows = X.pairs(spark, sf_dir).select("id", "label", "target")
    return digest(scoring.generate(rows, scoring.predictor("scaled", factor=0.25), 10, "euler", 2), "pixels")


def _in_sql(spark, sf_dir, statement):
    """A statement over the pairs, with the library's functions."""
    sql.register(spark, "ft_")
    return spark.sql(statement, pairs=X.pairs(spark, sf_dir))


@query(
    f"WITH {PR}, q AS ({_psnr_sql('condition', 'pr', 'id, label')}), e AS (SELECT id, pos, (target - (0.25::DOUBLE * target + 0.75::DOUBLE * condition)) / 0.75::DOUBLE AS v FROM pr), d AS ({dig('e', 'v')}), "
    "m AS (SELECT id, max(target) AS top FROM pr GROUP BY id), x AS (SELECT id, exp(max(target) - any_value(top)) / sum(exp(target - top)) AS p FROM pr JOIN m USING (id) GROUP BY id) "
    f"SELECT id, {R('psnr')} AS psnr, v_sum, v_pos, {R('p')} AS top_share, {R('cos(label)')} AS c, {R('sin(label)')} AS s FROM q JOIN d USING (id) JOIN x USING (id)"
)
def m3_sql_functions(spark, sf_dir):
    """Quality, velocities, shares and codes of pairs, by functions of SQL."""
    rows = _in_sql(
        spark, sf_dir,
        "SELECT id, ft_psnr(ft_to_unit(condition), ft_to_unit(target)) AS psnr, ft_velocity(target, ft_interpolate(target, condition, 0.25D), 0.25D) AS v, "
        "array_max(ft_softmax(target)) AS top_share, ft_sinusoidal_encode(label, 2) AS code FROM {pairs}",
    )
    numbers = {"psnr": rounded(F.col("psnr")), "top_share": rounded(F.col("top_share")), "c": rounded(F.col("code")[0]), "s": rounded(F.col("code")[1])}
    return digest(rows.withColumns(numbers), "v", by=("id", *numbers))


@query(f"WITH {PR}, b AS (SELECT id, y // 4 * 2 + x // 4 AS patch, y % 4 * 4 + x % 4 AS pos, target AS cells FROM pr WHERE label < 5) " + dig("b", "cells", by="id, patch"))
def m3_sql_patchify(spark, sf_dir):
    """Patches by a table function of SQL."""
    rows = _in_sql(spark, sf_dir, "SELECT id, t.patch, t.patch_values AS cells FROM {pairs}, LATERAL ft_patchify(target, h, w, c, 4) AS t WHERE label < 5")
    return digest(rows, "cells", by=("id", "patch"))
