"""Training batches from files and pairs, and the functions of SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtab.functions import arrays as A
from flowtab.functions import sql
from flowtab.operators import images
from flowtab.plans import training
from flowtab.sources import files, sinks


def shapes(spark, n, names=("pixels",), sides=((6, 7), (9, 5))):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        h, w = sides[i % len(sides)]
        rows.append((i, i % 3, h, w, 3, *(rng.integers(0, 256, h * w * 3).astype(float).tolist() for _ in names)))
    return spark.createDataFrame(rows, "id long, label int, h int, w int, c int, " + ", ".join(f"{n} array<double>" for n in names))


def test_an_epoch_from_class_folders(spark, tmp_path):
    rows = shapes(spark, 11).withColumn("file_name", F.concat(F.lit("train/k"), F.col("label"), F.lit("/"), F.col("id"), F.lit(".png")))
    files.save_files(sinks.export_images(rows), str(tmp_path / "set"))
    read = training.read_training_images(spark, str(tmp_path / "set"))
    assert {(r.id, r.label) for r in read.collect()} == {(f"k{i % 3}/{i}.png", i % 3) for i in range(11)}
    made = {e: training.training_batches(read, e, 1, 2, 2, 3, size=4, drop=0.0).collect() for e in (0, 1)}
    again = training.training_batches(read.repartition(7), 0, 1, 2, 2, 3, size=4, drop=0.0).collect()
    assert sorted(map(str, again)) == sorted(map(str, made[0])) and sorted(map(str, made[1])) != sorted(map(str, made[0]))
    for rows in made.values():
        # Eleven images are twelve places on two workers: six each, in three batches of two.
        assert sorted((r.shard, r.pos, r.batch) for r in rows) == [(s, p, p // 2) for s in range(2) for p in range(6)]
        assert len({r.id for r in rows}) == 11
        for r in rows:
            assert len(r.target) == len(r.z) == 48 and max(map(abs, r.target)) <= 1
            assert np.allclose(np.array(r.v), (np.array(r.target) - np.array(r.z)) / max(1 - r.t, 0.05))
    plain = {r.id: np.array(r.pixels).reshape(4, 4, 3) for r in images.halving_center_crop(read, 4).collect()}
    mirrored = 0
    for r in made[0]:
        got, want = (np.array(r.target).reshape(4, 4, 3) + 1) / 2 * 255, plain[r.id]
        mirrored += not np.allclose(got, want)
        assert np.allclose(got, want) or np.allclose(got, want[:, ::-1])
    assert 0 < mirrored < 12


def test_an_epoch_of_pairs(spark):
    pairs = shapes(spark, 7, ("condition", "target")).drop("label")
    made = training.training_batches(pairs, 4, 9, 1, 3, 10, size=5, task="restoration", drop=0.0).collect()
    assert len(made) == 6 and {r.label for r in made} == {0} and all(len(r.condition) == len(r.target) == 75 for r in made)
    for r in made:
        assert np.allclose(r.z, r.t * np.array(r.target) + (1 - r.t) * np.array(r.condition))
    assert training.training_batches(pairs.limit(0), 4, 9, 1, 3, 10, size=5, task="restoration").count() == 0
    with pytest.raises(ValueError):
        training.training_batches(pairs, 0, 0, 1, 1, 10, task="restoration")
    with pytest.raises(ValueError):
        training.training_batches(pairs, 0, 0, 1, 1, 10, task="other")


def test_sql_functions_are_the_columns(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *(rng.uniform(-2, 2, 12).tolist() for _ in range(2)), float(i) / 3) for i in range(5)], "id int, a array<double>, b array<double>, t double")
    assert "ft_psnr" in sql.register(spark, "ft_")
    both = {
        "ft_normalize(a)": A.normalize("a"), "ft_denormalize_u8(a)": A.denormalize_u8("a"), "ft_to_unit(a)": A.to_unit("a"), "ft_interpolate(a, b, t)": A.interpolate("a", "b", F.col("t")),
        "ft_velocity(a, b, t)": A.velocity("a", "b", F.col("t")), "ft_velocity(a, b, t, 0.5D)": A.velocity("a", "b", F.col("t"), 0.5), "ft_mean_squared(a, b)": A.mean_squared("a", "b"),
        "ft_mean_absolute(a, b)": A.mean_absolute("a", "b"), "ft_psnr(a, b)": A.psnr("a", "b"), "ft_psnr(a, a)": A.psnr("a", "a"), "ft_softmax(a)": A.softmax("a"),
        "ft_sinusoidal_encode(t, 7)": A.sinusoidal_encode("t", 7), "ft_sinusoidal_encode(t, 8, 50D)": A.sinusoidal_encode("t", 8, 50.0),
    }
    df.createOrReplaceTempView("ft_rows")
    for text, column in both.items():
        got = [r.x for r in spark.sql(f"SELECT {text} AS x FROM ft_rows ORDER BY id").collect()]
        want = [r.x for r in df.orderBy("id").select(column.alias("x")).collect()]
        assert np.allclose(got, want, rtol=1e-12, atol=1e-12), text
    gone = spark.sql("SELECT ft_psnr(NULL, array(1D)) AS p, ft_softmax(CAST(NULL AS ARRAY<DOUBLE>)) AS s, ft_normalize(NULL) AS n").first()
    assert gone.p is None and gone.s is None and gone.n is None
    # The body stands in the plan: no Python, compiled as one.
    plan = spark.sql("SELECT ft_psnr(a, b) FROM ft_rows WHERE ft_mean_squared(a, b) > 0")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_patches(spark):
    df = shapes(spark, 4).withColumn("pixels", F.when(F.col("id") != 3, F.col("pixels")))
    sql.register(spark, "ft_")
    got = spark.sql("SELECT id, t.* FROM {df} AS d, LATERAL ft_patchify(d.pixels, d.h, d.w, d.c, 2) AS t", df=df)
    want = images.patchify(df, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 9
    assert spark.sql("SELECT t.* FROM {df} AS d, LATERAL ft_patchify(d.pixels, d.h, d.w, d.c, 10) AS t", df=df).count() == 0
