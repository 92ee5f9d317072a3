"""Golden values, identities and plan checks of the image-flow operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtab.functions import arrays as A
from flowtab.functions.rand import hash_normal, hash_uniform
from flowtab.operators import flow, images, meters, metrics, order, pairing, params
from flowtab.plans import evaluate, scoring
from flowtab.sources import images as sources
from flowtab.sources import sinks
from flowtab.streaming import meters as streams

IMG = "id bigint, label int, h int, w int, c int, pixels array<double>"


def image_rows(spark, sides=((4, 6, 3),), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, i % 2, h, w, c, rng.integers(0, 256, h * w * c).astype(float).tolist()) for i, (h, w, c) in enumerate(sides)]
    return spark.createDataFrame(rows, IMG)


def array_of(row, col="pixels"):
    return np.array(row[col]).reshape(row.h, row.w, row.c)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_hash_random_is_the_same_on_any_partitioning(spark):
    df = spark.range(2000)
    cols = [hash_uniform(1, F.col("id")).alias("u"), hash_normal(1, F.col("id")).alias("n")]
    a, b = (sorted(df.repartition(k).select("id", *cols).collect()) for k in (1, 7))
    assert a == b
    u, n = np.array([r.u for r in a]), np.array([r.n for r in a])
    assert abs(u.mean() - 0.5) < 0.03 and abs(n.mean()) < 0.1 and abs(n.std() - 1) < 0.1


def test_normalize_round_trip_and_half_even(spark):
    df = spark.createDataFrame([([float(v) for v in range(256)],)], "p array<double>")
    assert df.select(A.denormalize_u8(A.normalize("p"))).first()[0] == list(range(256))
    half = spark.createDataFrame([([0.0, -9.0, 9.0],)], "p array<double>")
    assert half.select(A.denormalize_u8("p")).first()[0] == [128, 0, 255]


def test_pairing_tiers_ties_and_errors(spark):
    cond = spark.createDataFrame([(r,) for r in ("a/1.png", "a/2.png", "b/3.png", "c/4.PNG", "d/zz.png", "x/b.png")], "rel string")
    target = spark.createDataFrame([(r,) for r in ("a/1.png", "a/2.jpg", "other/3.png", "c/4.PNG", "a/b.png", "a-b/b.png")], "rel string")
    got = {r.rel: (r.target_rel, r.match_tier) for r in pairing.pair_images(cond, target).collect()}
    assert got == {
        "a/1.png": ("a/1.png", 1), "a/2.png": ("a/2.jpg", 2), "b/3.png": ("other/3.png", 3), "c/4.PNG": ("c/4.PNG", 1),
        "d/zz.png": (None, None), "x/b.png": ("a-b/b.png", 3),
    }
    missing = pairing.unpaired(pairing.pair_images(cond, target)).first()
    assert (missing.missing, missing.first_missing) == (1, "d/zz.png")
    with pytest.raises(ValueError):
        pairing.check_pairs(pairing.pair_images(cond.where("rel like 'd%'"), target))
    with pytest.raises(ValueError):
        pairing.check_pairs(pairing.pair_images(cond.limit(0), target))
    assert pairing.self_pair(cond).where("has_target or rel != target_rel").count() == 0


def test_suffixes(spark):
    df = spark.createDataFrame([(p,) for p in (".png", "..png", "a.tar.png", "a.txt", "d/.PNG", "d/x.PNG", None)], "path string")
    assert sorted(r.path for r in sources.image_paths(df).collect()) == ["..png", "a.tar.png", "d/x.PNG"]


def test_layout_needs_both_training_folders(spark):
    df = spark.createDataFrame([("Drop/1.png",), ("test/Drop/2.png",)], "rel string")
    with pytest.raises(ValueError):
        sources.resolve_layout(df)
    got = {(r.split, r.role): r.prefix for r in sources.resolve_layout(df, {("train", "target"): "my/gt"}).collect()}
    assert got == {("train", "condition"): "Drop", ("train", "target"): "my/gt", ("val", "condition"): "test/Drop"}


def test_class_index_keeps_null_classes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "class_name string")
    assert sorted((r.class_name or "", r.label) for r in pairing.class_index(df).collect()) == [("", None), ("a", 0), ("b", 1), ("b", 1)]


def test_index_shard_and_batch(spark):
    df = spark.range(1001).withColumn("k", F.col("id") % 3).repartition(5)
    got = order.global_index(df, ["k", "id"])
    rows = sorted((r.k, r.id, r.idx) for r in got.collect())
    assert [r[2] for r in rows] == list(range(1001))
    assert "SinglePartition" not in plan_of(got).split("== Physical Plan ==")[1].replace("Window", "") or got.count() == 1001
    shuffled = order.epoch_shuffle(df.select("id"), 1, 2)
    assert sorted(r.idx for r in shuffled.collect()) == list(range(1001))
    sharded = order.shard(shuffled, 4)
    kept = order.batch(sharded, 32, True)
    assert kept.count() == sum(n // 32 * 32 for n in (251, 250, 250, 250))
    assert order.batch(sharded, 32, False).count() == 1001
    padded = order.shard(shuffled, 4, pad=True).groupBy("shard").count().collect()
    assert [r["count"] for r in padded] == [251] * 4
    with pytest.raises(ValueError):
        order.label_plan(shuffled, 10)
    empty = order.global_index(df.limit(0), ["id"])
    assert empty.count() == 0


def test_moves_are_numpy_moves(spark):
    df = image_rows(spark, [(4, 6, 3), (5, 5, 1), (7, 4, 3), (2, 3, 1)])
    before = {r.id: array_of(r) for r in df.collect()}
    for k in range(4):
        for r in images.rot90(df, k).collect():
            assert (array_of(r) == np.rot90(before[r.id], k)).all()
    for r in images.center_crop(df, 4).collect():
        a = before[r.id]
        top, left = max(0, (a.shape[0] - 4) // 2), max(0, (a.shape[1] - 4) // 2)
        want, part = np.zeros((4, 4, a.shape[2])), a[top : top + 4, left : left + 4]
        want[: part.shape[0], : part.shape[1]] = part
        assert (array_of(r) == want).all()
    flipped = images.hflip(images.hflip(df, 3), 3).collect()
    assert all((array_of(r) == before[r.id]).all() for r in flipped)
    assert all((array_of(r) == before[r.id][:, ::-1]).all() for r in images.hflip(df, 3, 1.1).collect())


def test_patches_round_trip(spark):
    df = image_rows(spark, [(6, 6, 3), (6, 6, 3)])
    patches = images.patchify(df, 2)
    first = patches.where("id = 0 and patch = 1").first()["values"]
    a = {r.id: array_of(r) for r in df.collect()}
    assert first == a[0][0:2, 2:4].ravel().tolist()
    assert all((array_of(r) == a[r.id]).all() for r in images.unpatchify(patches, 2, 3).collect())


def test_sizes_and_resampling(spark):
    cases = [(256, 256), (255, 300), (512, 1030), (513, 511), (100, 80)]
    df = spark.createDataFrame([(i, h, w) for i, (w, h) in enumerate(cases)], "id int, h int, w int")
    up = df.select("id", *images.upscaled_size(F.col("h"), F.col("w"), 256)).collect()
    down = df.select("id", *images.halved_size(F.col("h"), F.col("w"), 256)).collect()
    for (w, h), u, d in zip(cases, sorted(up), sorted(down), strict=True):
        s = 256 / min(w, h)
        assert (u[1], u[2]) == ((h, w) if min(w, h) >= 256 else (round(h * s), round(w * s)))
        a, b, n = h, w, 0
        while min(a, b) >= 512:
            a, b, n = a // 2, b // 2, n + 1
        s = 256 / min(a, b)
        assert tuple(d[1:]) == (round(a * s), round(b * s), n)
    flat = np.full((2, 5, 7, 3), 93.0)
    assert (images.resample(flat, 9, 4) == 93).all() and images.halve(np.full((1, 41, 50, 1), 7.0), 2).shape == (1, 10, 12, 1)
    mixed = images.halving_center_crop(image_rows(spark, [(40, 50, 1), (8, 9, 3), (33, 17, 1), (40, 50, 1)]), 8).collect()
    assert all((r.h, r.w, len(r.pixels)) == (8, 8, 64 * r.c) for r in mixed) and len(mixed) == 4
    got = images.prepare_pairs(image_rows(spark, [(9, 8, 3)] * 3).withColumn("condition", F.col("pixels")).withColumnRenamed("pixels", "target"), 8, True, 5).collect()
    assert all(r.condition == r.target and len(r.target) == 192 and r.h == 8 for r in got)
    with pytest.raises(ValueError):
        images.prepare_pairs(image_rows(spark), 8, True, resize=4)


def test_losses_golden(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 48).tolist()
    df = spark.createDataFrame([(0, 4, 4, 3, x, x, [0.0] * 48, x, x), (1, 4, 4, 3, [0.0] * 48, [0.2] * 48, [0.1] * 48, x, x)], "id int, h int, w int, c int, pred array<double>, target array<double>, condition array<double>, v array<double>, v_hat array<double>")
    got = {r.id: r for r in df.select("id", metrics.psnr().alias("p"), metrics.ssim_loss().alias("s"), metrics.gradient_loss().alias("g"), metrics.l1_recon().alias("l"), metrics.l1_residual().alias("r"), metrics.total_loss({"recon": 1.0}).alias("t")).collect()}
    assert got[0].p == 100 and got[0].s == 0 and got[0].g == 0 and got[0].t == 0
    assert abs(got[1].p - 20) < 1e-9 and abs(got[1].l - got[1].r) < 1e-12 and abs(got[1].t - got[1].l) < 1e-12 and got[1].g > 0
    assert "ArrowEvalPython" not in plan_of(df.select(metrics.total_loss({"recon": 1.0, "ssim": 0})))


def test_frechet_and_inception(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=(200, 5))
    a = spark.createDataFrame([(r.tolist(),) for r in f], "f array<double>").repartition(3)
    b = spark.createDataFrame([((r + 0.5).tolist(),) for r in f], "f array<double>")
    _, mu, sigma = metrics.feature_moments(a)
    assert np.allclose(mu, f.mean(0)) and np.allclose(sigma, np.cov(f.T))
    assert abs(metrics.frechet_distance(a, a)) < 1e-6 and abs(metrics.frechet_distance(a, b) - 5 * 0.25) < 1e-6
    stats = spark.createDataFrame([(256, f.mean(0).tolist(), np.cov(f.T).tolist())], "res int, mu array<double>, sigma array<array<double>>")
    assert abs(metrics.frechet_to_stored(a, stats, 256)) < 1e-6
    with pytest.raises(ValueError):
        metrics.frechet_to_stored(a, stats, 512)
    one_hot = spark.createDataFrame([([1.0 if i == k else 0.0 for i in range(4)],) for k in range(4)], "p array<double>")
    assert abs(metrics.inception_score(one_hot).first().score - 4) < 1e-9
    same = spark.createDataFrame([([0.25] * 4,)] * 3, "p array<double>")
    assert abs(metrics.inception_score(same).first().score - 1) < 1e-12


@pytest.mark.parametrize(("method", "steps", "want"), [("euler", 1, 1.0), ("heun", 8, 1.0), ("heun", 20, 1.0), ("euler", 21, 0.9931972789), ("heun", 21, 0.9930353094), ("euler", 50, 0.9568), ("heun", 50, 0.948592)])
def test_sampler_golden(spark, method, steps, want):
    df = spark.createDataFrame([(1, 0, [1.0, 1.0], [-2.0, -2.0])], "id bigint, label int, target array<double>, source array<double>")
    got = scoring.generate(df, scoring.predictor("target"), 10, method, steps).first().pixels
    assert np.allclose(got, want, atol=1e-6 if want != 1 else 1e-12)
    called = scoring.generate_with(df, lambda z, t, labels, carried: np.ones_like(z), 10, method, steps).first().pixels
    assert np.allclose(got, called, atol=1e-9)


def test_sampler_arguments_and_registry(spark):
    with pytest.raises(ValueError):
        scoring.predictor("nobody")
    with pytest.raises(ValueError):
        scoring.sampled(F.lit(None), None, "midpoint", 3)
    with pytest.raises(ValueError):
        flow.bridge_source(spark.range(1), 0, "other")
    df = spark.createDataFrame([(1, [0.5, 0.5], [0.0, 1.0])], "id bigint, condition array<double>, target array<double>")
    got = scoring.restore(df, scoring.predictor("condition"), 10, steps=2).first()
    assert np.allclose(got.pixels, got.condition)


def test_restoration_without_targets_has_no_metric(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], None)], "id bigint, condition array<double>, target array<double>")
    _, scores = evaluate.evaluate_restoration(df, scoring.predictor("condition"), 10, steps=2)
    assert scores.collect()[0].psnr is None


def test_meters_and_schedules(spark):
    df = spark.createDataFrame([("m", i, v, 1) for i, v in enumerate((3.0, 1.0, 2.0, 10.0))], "meter string, step bigint, value double, n int")
    last = meters.rolling_meters(df, 4).where("step = 3").first()
    assert (last.median, last.mean, last.max, last.latest) == (2.0, 4.0, 10.0, 10.0)
    many = spark.createDataFrame([("ab"[i % 5 == 0], i, float(i * 31 % 17), 1 + i % 3) for i in range(400)], "meter string, step bigint, value double, n int")
    for whole, cut in ((meters.rolling_meters(many), meters.rolling_meters(many, block=23)), (meters.global_average(many), meters.global_average(many, block=7))):
        r = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect())
        assert r(whole) == r(cut)
    timed = many.withColumn("ts", F.timestamp_seconds(F.col("step") * 3 + F.col("step") % 4))
    assert sorted(meters.progress(timed, 10).collect()) == sorted(meters.progress(timed, 10, block=9).collect())
    with pytest.raises(Exception, match="not a number"):
        meters.drop_nulls_check_numeric(spark.createDataFrame([("x",), (None,)], "value string")).collect()
    lr = params.learning_rate(spark.createDataFrame([(0.0,), (5.0,), (60.0,)], "epoch double"), 1.0, 0.1, 5, 60, "cosine")
    assert np.allclose([r.lr for r in lr.orderBy("epoch").collect()], [0, 1, 0.1])
    with pytest.raises(ValueError):
        params.learning_rate(df, 1, 0, 1, 2, "step")
    snaps = spark.createDataFrame([("p", 0, s, float(s + 1)) for s in range(3)], "name string, idx bigint, step int, value double")
    assert abs(params.ema(snaps, 0.9).first().ema - 1.29) < 1e-12


def test_files_round_trip(spark, tmp_path):
    df = image_rows(spark, [(5, 7, 3), (4, 4, 1), (6, 9, 3)])
    named = df.withColumn("file_name", F.concat(F.lit("train/k"), F.col("label").cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".PNG")))
    root = str(tmp_path)

    def put(name, content):
        import os

        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(content)

    sinks.write_files(sinks.export_images(named), put)
    put("train/k0/broken.png", b"no image")
    assert sources.count_undecodable(spark, root) == 1
    want = {r.id: array_of(r) for r in df.collect()}
    got = {int(r.path.rsplit("/", 1)[1].split(".")[0]): array_of(r) for r in sources.read_images(spark, root).collect()}
    assert set(got) == {0, 1, 2} and all((got[i] == np.broadcast_to(want[i], got[i].shape)).all() for i in got)
    scanned = sources.scan_images(spark, root, index=True)
    assert [r.rel for r in scanned.orderBy("idx").collect()] == ["train/k0/0.PNG", "train/k0/2.PNG", "train/k0/broken.png", "train/k1/1.PNG"]
    assert "content" not in plan_of(sources.scan_images(spark, root)).split("ReadSchema")[-1]
    made = evaluate.prepare_reference_set(spark, root, 4, transform=lambda a: a)
    assert sorted((r.idx, r.label, r.file_name) for r in made.select("idx", "label", "file_name").collect()) == [(0, 0, "transformed_00000000.png"), (1, 0, "transformed_00000001.png"), (3, 1, "transformed_00000003.png")]


def test_snapshots_overwrite_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("w", 0, 1.0)], "name string, idx bigint, value double")
    path = str(tmp_path / "s")
    sinks.write_snapshot(rows, path, 0)
    sinks.write_snapshot(rows, path, 0, "milestone_0")
    sinks.write_snapshot(rows.withColumn("value", F.lit(2.0)), path, 1)
    assert [r.value for r in sinks.read_snapshot(spark, path).collect()] == [2.0]
    assert [r.value for r in sinks.read_snapshot(spark, path, "milestone_0").collect()] == [1.0] and sinks.resume_epoch(spark, path) == 2


def test_export_names(spark):
    df = spark.createDataFrame([("a/b\\c.x.jpg", 123456)], "rel string, i bigint")
    row = df.select(sinks.export_name("reference", index=F.col("i")), sinks.export_name("generated", index=F.col("i")), sinks.export_name("flat", F.col("rel"), batch=F.lit(7), rank=F.lit(1))).first()
    assert tuple(row) == ("transformed_00123456.png", "123456.png", "00007_1_a__b__c.x.png")


def test_encodings(spark):
    df = spark.createDataFrame([(2.0, 3, 5)], "v double, r int, c int")
    got = df.select(A.sinusoidal_encode("v", 5).alias("s"), A.grid_encode("r", "c", 8).alias("g")).first()
    f = [1.0, math.exp(-math.log(10000) / 2)]
    assert np.allclose(got.s, [math.cos(2 * k) for k in f] + [math.sin(2 * k) for k in f] + [0])
    half = lambda v: [math.sin(v * k) for k in f] + [math.cos(v * k) for k in f]
    assert np.allclose(got.g, half(5) + half(3))
    with pytest.raises(ValueError):
        A.grid_encode("r", "c", 6)


def test_frechet_by_another_way(spark):
    """The trace of the root of the product by the product's own eigenvalues."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(i % 2, 1 + i % 3, 5).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, f array<double>")
    a, b = (np.array([f for i, f in rows if i % 2 == k]) for k in (0, 1))
    sa, sb = np.cov(a.T), np.cov(b.T)
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(sa) + np.trace(sb) - 2 * np.sqrt(np.linalg.eigvals(sa @ sb).real).sum()
    assert math.isclose(metrics.frechet_distance(df.where("id % 2 = 0"), df.where("id % 2 = 1")), want, rel_tol=1e-9)


def test_exported_pixels_are_those_of_the_images(spark):
    """What the export query writes, read by a PNG reader of another make."""
    rows = image_rows(spark, [(4, 6, 3), (5, 3, 1)]).withColumn("file_name", F.col("id").cast("string"))
    got = {r.file_name: r.p for r in sinks.export_images(rows).select("file_name", sinks.unpng("content").alias("p")).collect()}
    assert got == {r.file_name: r.pixels for r in rows.collect()}


def test_tasks_give_arrays_and_hot_keys_are_dealt(spark):
    df = image_rows(spark, [(4, 4, 1)] * 20).withColumnRenamed("pixels", "target")
    plan = plan_of(metrics.fit_class_gaussian(df, 9))
    assert "collect_list" not in plan and "explode" not in plan.lower()
    tiles, _ = metrics.moment_tiles(df, "target", 5)
    assert sorted((r.i, r.j, len(r.x)) for r in tiles.collect()) == sorted([(-1, -1, 17), *((i, j, (5 if i < 3 else 1) * (5 if j < 3 else 1)) for i in range(4) for j in range(i, 4))])
    steps = spark.createDataFrame([("a", 0, k, float(k)) for k in range(50)], "name string, idx int, step int, value double")
    assert "Join" not in plan_of(params.ema(steps, 0.9))
    files = spark.createDataFrame([("a/x.png",), ("b/x.png",)], "rel string")
    assert "__ft_salt" in plan_of(pairing.pair_images(files, files, 1)) and "explode" not in plan_of(pairing.pair_images(files, files)).lower()


def test_progress_counts_waits_and_totals(spark):
    rows = [("a", k, 10.0 * k, 10.0 * k - 3) for k in range(5)]
    df = spark.createDataFrame(rows, "meter string, step bigint, e double, l double").select("meter", "step", F.timestamp_seconds("e").alias("ts"), F.timestamp_seconds("l").alias("loaded"))
    got = meters.progress(df, 2).orderBy("step").collect()
    assert [(r.iteration, r.iter_s, r.data_s, r.eta_s, r.total_s) for r in got] == [(0, None, None, None, 0.0), (2, 10.0, 7.0, 30.0, 20.0), (4, 10.0, 7.0, 10.0, 40.0)]
    assert got[-1].s_per_it == 8.0 and "data_s" not in meters.progress(df.drop("loaded"), 2).columns


def test_a_shared_folder_is_needed(spark, monkeypatch):
    from flowtab.functions import joins

    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda key, other=None: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="share"):
        joins.shared_folder(Bare)


@pytest.mark.parametrize("with_targets", [True, False])
def test_restore_folder(spark, tmp_path, with_targets):
    """From files to restored files, metric and log; the predictor hands the condition back."""
    rng, pixels = np.random.default_rng(5), {}
    for name, (h, w) in {"a/x.png": (6, 6), "a/y.png": (6, 9), "z.png": (8, 6)}.items():
        for role in ("rainy", "clean")[: 1 + with_targets]:
            pixels[role, name] = rng.integers(0, 256, (h, w, 3))
            file = tmp_path / "data" / "val" / role / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(sinks.png(pixels[role, name], h, w, 3))
    out, log = tmp_path / "out", str(tmp_path / "log")
    made, scores = evaluate.restore_folder(spark, str(tmp_path / "data"), 6, scoring.predictor("condition"), 10, out=str(out), batch=2, log=log, steps=2)
    middle = lambda a: a[(a.shape[0] - 6) // 2 :, (a.shape[1] - 6) // 2 :][:6, :6]
    assert sorted(f.name for f in out.iterdir() if f.suffix == ".png") == ["00000_0_a__x.png", "00000_0_a__y.png", "00001_0_z.png"]
    for r in made.collect():
        box = middle(pixels["rainy", r.id])
        assert np.allclose((array_of(r) + 1) / 2 * 255, box)
        if with_targets:
            assert math.isclose(r.psnr, -10 * math.log10(np.mean((box - middle(pixels["clean", r.id])) ** 2 / 255**2)), rel_tol=1e-6)
    if with_targets:
        assert scores.first().n == 3 and math.isclose(sinks.read_metric_log(spark, log).first().value, scores.first().psnr)


def test_arrow_sampling_is_the_expression(spark):
    """The same images to 1e-12, for two shapes, by ids that are numbers or text, from noise and from a source."""
    rng = np.random.default_rng(8)
    rows = [(f"x{i}", int(i % 4), *(rng.normal(size=n).tolist() for _ in range(2)), *(rng.uniform(0.1, 1, n).tolist() for _ in range(2)), rng.normal(size=n).tolist()) for i, n in enumerate([6, 6, 9, 6, 9, 4])]
    df = spark.createDataFrame(rows, "id string, label int, mu array<double>, mu_null array<double>, var array<double>, var_null array<double>, target array<double>").withColumn("a.b", F.lit(1))
    carry = ("mu", "var", "mu_null", "var_null")
    for extra in ({}, {"source": F.col("target")}):
        for method, scale in (("euler", 1.0), ("heun", 2.0)):
            how = dict(method=method, steps=5, scale=scale, low=0.1, high=0.9, seed=3, noise_scale=2.0)
            want = {r.id: r.pixels for r in scoring.generate(df.withColumns(extra), scoring.predictor("class_gaussian", null_class=3), 3, **how).collect()}
            made = scoring.generate_with(df.withColumns(extra), scoring.class_gaussian_arrays(3), 3, carry=carry, **how)
            assert made.columns[:8] == df.columns
            got = {r.id: r.pixels for r in made.collect()}
            assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want) and len(got) == 6
    gone = scoring.generate_with(df.withColumn("target", F.lit(None).cast("array<double>")), scoring.class_gaussian_arrays(3), 3, carry=carry, steps=2)
    assert gone.where("pixels is null").count() == 6


def test_numpy_normals_are_the_columns(spark):
    from flowtab.functions import rand

    df = spark.createDataFrame([(7,), (None,), (-3,)], "id bigint").withColumn("n", F.array(*(rand.hash_normal("5:noise", F.col("id"), F.lit(i)) for i in range(12))))
    rows = df.collect()
    assert np.allclose(rand.normals("5:noise", [r.id for r in rows], 12), [r.n for r in rows], rtol=0, atol=1e-14)


def test_hot_keys_alone_are_dealt(spark):
    from flowtab.functions.joins import hot_left

    left = spark.range(1000).select("id", F.when(F.col("id") < 600, 0).when(F.col("id") < 990, F.col("id")).alias("k").cast("bigint"))
    right = spark.range(0, 2000, 2).select(F.col("id").alias("r"), (F.col("id") * 10).alias("v"))
    want = sorted((r.id, r.v) for r in left.join(right, F.col("k") == F.col("r"), "left").select("id", "v").collect() if r.v is not None)
    for share in (50, 100_000):
        got = hot_left(left, right, F.col("k"), F.col("r"), F.xxhash64("id"), share)
        assert got.columns == ["id", "k", "r", "v"] and got.count() == 1000
        assert sorted((r.id, r.v) for r in got.where("v is not null").collect()) == want
        # The right side is copied for hot keys alone, and not at all where there are none.
        assert ("Generate explode" in plan_of(got)) == (share == 50)
    conditions = spark.createDataFrame([(f"{i}/x.png",) for i in range(40)] + [("b/y.png",)], "rel string")
    targets = spark.createDataFrame([("t/x.png",), ("b/y.png",)], "rel string")
    both = [sorted(map(tuple, pairing.pair_images(conditions, targets, share).collect())) for share in (7, 1000)]
    assert both[0] == both[1] and sum(r[1] == "t/x.png" for r in both[0]) == 40


@pytest.mark.parametrize("decay", [0.0, 0.01, 0.5, 0.9, 0.9999, 1.0])
def test_averages_of_many_steps(spark, decay):
    steps = 700
    rows = [("p", 0, s, math.sin(s)) for s in range(steps)] + [("p", 1, 0, 4.0)]
    got = {r.idx: r.ema for r in params.ema(spark.createDataFrame(rows, "name string, idx bigint, step int, value double").repartition(5), decay).collect()}
    want = 0.0
    for s in range(steps):
        want = math.sin(s) if s == 0 else decay * want + (1 - decay) * math.sin(s)
    assert math.isclose(got[0], want, rel_tol=1e-9, abs_tol=1e-12) and got[1] == 4.0
    assert "Join" not in plan_of(params.ema(spark.createDataFrame(rows, "name string, idx bigint, step int, value double"), decay))


def test_validation_reads_once(spark):
    from pyspark.sql import Observation

    good, bad = image_rows(spark, [(4, 4, 3)] * 3), image_rows(spark, [(4, 4, 3), (4, 5, 3)])
    assert images.validate_images(good, 4, 3).count() == 3
    assert plan_of(images.validate_images(good, 4)).count("Scan") == 1
    with pytest.raises(Exception, match="not 4 x 4: 4 x 5"):
        images.validate_images(bad, 4).select("id").count()
    with pytest.raises(Exception, match="not 4 x 4"):
        images.validate_images(good, 4, 1).count()
    with pytest.raises(Exception, match=r"not 4 x 4: \? x 4"):
        images.validate_images(good.withColumn("h", F.lit(None).cast("int")), 4).count()
    seen = Observation()
    images.validate_images(bad, 4, observation=seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"wrong": 1, "images": 2}
    with pytest.raises(ValueError, match="1 of 2"):
        images.check_observed(seen)
    seen = Observation()
    images.validate_images(good, 4, observation=seen).collect()
    assert images.check_observed(seen) == 3


def test_moves_with_missing_images(spark):
    df = image_rows(spark, [(4, 6, 3), (5, 5, 1)]).withColumn("pixels", F.when(F.col("id") == 1, F.col("pixels")).cast("array<double>")).withColumn("a.b", F.lit("x"))
    a = next(array_of(r) for r in df.collect() if r.id == 1)
    for made, want in ((images.rot90(df, 5), np.rot90(a)), (images.vflip(df, 1, 1.1), a[::-1]), (images.swap_channels(df), a[..., ::-1])):
        rows = {r.id: r for r in made.collect()}
        assert rows[0].pixels is None and (rows[0].h, rows[0].w, rows[0]["a.b"]) == (4, 6, "x") and made.schema == df.schema
        assert (array_of(rows[1]) == want).all()
    assert images.patchify(df, 2).count() == 4 and images.patchify(df.limit(0), 2).count() == 0
    ints = df.withColumn("pixels", F.col("pixels").cast("array<int>"))
    assert images.hflip(ints, 1, 1.1).schema == ints.schema


def test_moments_in_tiles(spark, monkeypatch):
    """Any tile and any number of passes give the moments; wide features never stand in a task as d x d numbers."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 23)) + 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, f array<double>").union(spark.createDataFrame([(99, None)], "id int, f array<double>")).repartition(3)
    for tile, most in ((256, 1 << 30), (7, 1 << 30), (7, 8 * 7 * 7 * 2)):
        monkeypatch.setattr(metrics, "TASK_BYTES", most)
        n, mu, sigma = metrics.feature_moments(df, tile=tile)
        assert n == 40 and np.allclose(mu, x.mean(0)) and np.allclose(sigma, np.cov(x.T))
        rows = {(r.i, r.j): r for r in metrics.covariance_rows(df, tile=tile).collect()}
        assert len(rows) == 23 * 23 and all(math.isclose(rows[i, j].cov, np.cov(x.T)[i, j], rel_tol=1e-9, abs_tol=1e-12) for i, j in rows)
        assert all(math.isclose(rows[i, j].mean_i, x.mean(0)[i], rel_tol=1e-12) for i, j in rows)


def test_wide_moments(spark):
    df = spark.range(0, 30, 1, 2).select(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda k: F.sin(F.col("id") * (k + 1)).cast("double")).alias("f"))
    n, mu, sigma = metrics.feature_moments(df)
    x = np.sin(np.arange(30)[:, None] * (np.arange(4096) + 1))
    assert n == 30 and np.allclose(mu, x.mean(0), atol=1e-9)
    at = np.random.default_rng(1).integers(0, 4096, (200, 2))
    assert np.allclose([sigma[i, j] for i, j in at], [np.cov(x[:, i], x[:, j])[0, 1] for i, j in at], atol=1e-9)
