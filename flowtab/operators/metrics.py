"""Losses and quality metrics. Per-image values are columns; tables of them are plain aggregations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.joins import cut

#: Default weights of the loss terms after the velocity error.
WEIGHTS = {"recon": 1.0, "residual": 0.2, "ssim": 0.1, "gradient": 0.05}


def velocity_mse(v: str = "v", v_hat: str = "v_hat") -> Column:
    """Mean squared velocity error of an image; average it over a table."""
    return A.mean_squared(v, v_hat)


def l1_recon(pred: str = "pred", target: str = "target") -> Column:
    return A.mean_absolute(pred, target)


def l1_residual(pred: str = "pred", target: str = "target", condition: str = "condition") -> Column:
    """Mean absolute difference of the residuals over the condition."""
    minus = lambda a: F.zip_with(a, condition, lambda x, c: x - c)
    return A.mean_absolute(minus(pred), minus(target))


def _box(images):
    """3 x 3 means over (N, H, W, C), zeros outside, always divided by nine."""
    import numpy as np

    p = np.pad(images, ((0, 0), (1, 1), (1, 1), (0, 0)))
    h, w = images.shape[1:3]
    return sum(p[:, y : y + h, x : x + w] for y in range(3) for x in range(3)) / 9


def ssim_of(a, b):
    """Mean of (1 - SSIM), clipped to 0..2, of each of N images on [0, 1]."""
    import numpy as np

    c1, c2 = 0.01**2, 0.03**2
    ma, mb = _box(a), _box(b)
    va, vb, ab = _box(a * a) - ma * ma, _box(b * b) - mb * mb, _box(a * b) - ma * mb
    ssim = (2 * ma * mb + c1) * (2 * ab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return np.clip(1 - ssim, 0, 2).mean((1, 2, 3))


def gradient_of(a, b):
    """Mean absolute difference of the Sobel gradients (kernels over 8) in x plus that in y, zeros outside."""
    import numpy as np

    p = np.pad(a - b, ((0, 0), (1, 1), (1, 1), (0, 0)))
    h, w = a.shape[1:3]
    at = lambda y, x: p[:, y : y + h, x : x + w]
    gx = (at(0, 2) + 2 * at(1, 2) + at(2, 2) - at(0, 0) - 2 * at(1, 0) - at(2, 0)) / 8
    gy = (at(2, 0) + 2 * at(2, 1) + at(2, 2) - at(0, 0) - 2 * at(0, 1) - at(0, 2)) / 8
    return np.abs(gx).mean((1, 2, 3)) + np.abs(gy).mean((1, 2, 3))


def _image_udf(fn, unit: bool):
    """Arrow UDF of (a, b, h, w, c): images of one shape are worked on at once."""

    @F.pandas_udf("double")
    def apply(a, b, h, w, c):
        import numpy as np
        import pandas as pd

        out = np.full(len(a), np.nan)
        shapes = pd.DataFrame({"h": h, "w": w, "c": c})
        for shape, rows in shapes.groupby(["h", "w", "c"]).indices.items():
            x, y = (np.stack(s.iloc[rows].to_list()).astype(float).reshape(-1, *map(int, shape)) for s in (a, b))
            if unit:
                x, y = (np.clip((v + 1) / 2, 0, 1) for v in (x, y))
            out[rows] = fn(x, y)
        return pd.Series(out)

    return apply


def ssim_loss(pred: str = "pred", target: str = "target") -> Column:
    return _image_udf(ssim_of, True)(pred, target, "h", "w", "c")


def gradient_loss(pred: str = "pred", target: str = "target") -> Column:
    return _image_udf(gradient_of, False)(pred, target, "h", "w", "c")


def total_loss(weights: dict[str, float] | None = None) -> Column:
    """Velocity error plus the weighted terms; a term whose weight is not positive is not planned at all."""
    weights = WEIGHTS if weights is None else weights
    terms = {"recon": l1_recon, "residual": l1_residual, "ssim": ssim_loss, "gradient": gradient_loss}
    out = velocity_mse()
    for name, term in terms.items():
        if weights.get(name, 0) > 0:
            out = out + weights[name] * term()
    return out


def psnr(pred: str = "pred", target: str = "target") -> Column:
    """Decibels of images on [-1, 1], at most 100."""
    return A.psnr(A.to_unit(pred), A.to_unit(target))


def mean_psnr(df: DataFrame, *by: str) -> DataFrame:
    """``n`` and ``psnr``, the mean over all rows with a value; null without any."""
    return df.groupBy(*by).agg(F.count("psnr").alias("n"), (F.sum("psnr") / F.nullif(F.count("psnr"), F.lit(0))).alias("psnr"))


def _summed(parts: DataFrame, *by: str) -> DataFrame:
    """``by, x``: the sum of the arrays ``x`` of each group, element by element, added up by tasks before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return parts.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("x"))


#: Columns of a tile, and bytes of tiles that a task adds up at once.
TILE, TASK_BYTES = 256, 64 << 20


def moment_tiles(df: DataFrame, col: str = "f", tile: int = TILE) -> tuple[DataFrame, object]:
    """Rows ``i, j, x`` and the pilot: one row of features, about which the sums are taken.

    ``x`` is the tile of the sum of outer products at block row i and block column j >= i, row by row; i = j = -1 has the sums and the
    count. Tasks add up their own tiles, and Spark the tasks', by tile. A task holds ``TASK_BYTES`` of tiles at most: wider features are read
    once for each such group of tiles.
    """
    import numpy as np

    first = df.where(F.col(col).isNotNull()).select(F.col(col).cast("array<double>").alias("f"))
    some = first.take(1)
    if not some:
        raise ValueError("no features")
    pilot, d = np.array(some[0].f), len(some[0].f)
    blocks = [slice(at, min(d, at + tile)) for at in range(0, d, tile)]
    every = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]
    each = max(1, TASK_BYTES // (8 * tile * tile))

    def partial(group: list[tuple[int, int]], sums: bool) -> DataFrame:
        def run(batches: Iterable) -> Iterator:
            import pyarrow as pa

            gram = {(i, j): np.zeros((blocks[i].stop - blocks[i].start, blocks[j].stop - blocks[j].start)) for i, j in group}
            shift, rows = np.zeros(d), 0
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - pilot
                for i, j in group:
                    gram[i, j] += x[:, blocks[i]].T @ x[:, blocks[j]]
                shift += x.sum(0)
                rows += len(x)
            found = [(-1, -1, np.append(shift, rows)), *((i, j, g.ravel()) for (i, j), g in gram.items())][0 if sums else 1 :]
            for i, j, x in found:  # a tile at a time
                values = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), values], names=["i", "j", "x"])

        return first.mapInArrow(run, "i int, j int, x array<double>")

    parts = [partial(every[at : at + each], at == 0) for at in range(0, len(every), each)]
    return _summed(reduce(DataFrame.unionAll, parts), "i", "j"), pilot


def feature_moments(df: DataFrame, col: str = "f", tile: int = TILE) -> tuple[int, object, object]:
    """Count, mean vector and sample covariance of a feature column of equal lengths; half of d x d numbers reaches the driver."""
    import numpy as np

    sums, pilot = moment_tiles(df, col, tile)
    d = len(pilot)
    gram, shift, n = np.zeros((d, d)), None, 0
    for batch in sums.toArrow().to_batches():
        for i, j, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = x.values.to_numpy()
            if i < 0:
                shift, n = x[:-1], int(x[-1])
                continue
            rows, across = slice(i * tile, (i + 1) * tile), slice(j * tile, (j + 1) * tile)
            gram[rows, across] = x.reshape(gram[rows, across].shape)
            gram[across, rows] = gram[rows, across].T
    return n, pilot + shift / n, (gram - np.outer(shift, shift) / n) / max(1, n - 1)


def covariance_rows(df: DataFrame, col: str = "f", tile: int = TILE) -> DataFrame:
    """The same as rows ``i, j, mean_i, cov``, made by Spark; the driver sees the sums (d numbers) alone."""
    sums, pilot = moment_tiles(df, col, tile)
    sums = cut(sums)
    d = len(pilot)
    last = sums.where("i = -1").first().x
    n = last[d]
    means = sums.sparkSession.createDataFrame([(k, s / n, float(p) + s / n) for k, (s, p) in enumerate(zip(last, pilot, strict=False))], "k int, shift double, mean double")
    across = F.least(F.lit(tile), d - F.col("bj") * tile)
    cells = sums.where("i >= 0").select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.posexplode("x").alias("at", "g"))
    upper = cells.select("bi", "bj", (F.col("bi") * tile + F.floor(F.col("at") / across)).cast("int").alias("i"), (F.col("bj") * tile + F.col("at") % across).cast("int").alias("j"), "g")
    flat = upper.select("i", "j", "g").union(upper.where("bi < bj").select("j", "i", "g"))
    here, there = means.alias("a"), means.alias("b")
    met = flat.join(here, F.col("i") == F.col("a.k")).join(there, F.col("j") == F.col("b.k"))
    return met.select("i", "j", F.col("a.mean").alias("mean_i"), ((F.col("g") - n * F.col("a.shift") * F.col("b.shift")) / max(1.0, n - 1)).alias("cov"))


def frechet(mu_a, sigma_a, mu_b, sigma_b) -> float:
    """Squared Frechet distance of two normal distributions."""
    import numpy as np

    values, vectors = np.linalg.eigh(sigma_a)
    root = vectors * np.sqrt(np.clip(values, 0, None)) @ vectors.T
    cross = np.linalg.eigvalsh(root @ sigma_b @ root)
    return float(((mu_a - mu_b) ** 2).sum() + np.trace(sigma_a) + np.trace(sigma_b) - 2 * np.sqrt(np.clip(cross, 0, None)).sum())


def frechet_distance(a: DataFrame, b: DataFrame, col: str = "f") -> float:
    """Between the features of two tables."""
    (_, *x), (_, *y) = feature_moments(a, col), feature_moments(b, col)
    return frechet(*x, *y)


def frechet_to_stored(a: DataFrame, stats: DataFrame, res: int, col: str = "f") -> float:
    """Against stored statistics ``res, mu, sigma``; an error where there are none for the resolution."""
    import numpy as np

    rows = stats.where(F.col("res") == res).select("mu", "sigma").take(1)
    if not rows:
        raise ValueError(f"no reference statistics for resolution {res}")
    _, mu, sigma = feature_moments(a, col)
    return frechet(mu, sigma, np.array(rows[0].mu), np.array(rows[0].sigma))


def inception_score(df: DataFrame, probs: str = "p", split: Column | None = None) -> DataFrame:
    """``split, score``: exp of the mean divergence of the rows' class probabilities from their mean."""
    rows = df.select((split if split is not None else F.lit(0)).alias("split"), F.col(probs).alias("p"))
    marginal = (
        rows.select("split", F.posexplode("p").alias("k", "q")).groupBy("split", "k").agg(F.avg("q").alias("q"))
        .groupBy("split").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda s: s["q"]).alias("q"))
    )
    term = lambda p, q: F.when(p > 0, p * F.ln(p / q)).otherwise(0.0)
    joined = rows.join(marginal, "split")  # one row of class means for each split
    return joined.groupBy("split").agg(F.exp(F.avg(A.total(F.zip_with("p", "q", term)))).alias("score"))


def fit_class_gaussian(df: DataFrame, null_class: int, col: str = "target") -> DataFrame:
    """``label, mu, var``: mean and population variance of each pixel by class, and over all as the null class.

    Each task adds up, for each label, the differences from one image (the pilot), their squares and the pixels there are; the tasks' sums meet
    by label and are added up as they come. Nothing is listed by task.

    Null pixels, and those that a shorter or null image does not have, count for nothing; a pixel that no image of a class has is null. Images
    without a label are a class of their own, with a null label, and count in the null class.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = df.select(F.col("label").cast("int").alias("label"), F.col(col).cast("array<double>").alias("x"))
    some = rows.where("x is not null").select(F.transform("x", lambda v: F.when(F.abs(v) < float("inf"), v).otherwise(0.0)).alias("x")).take(1)
    pilot = np.array(some[0].x if some else [], float)
    doubles = pa.list_(pa.float64())
    parts = pa.schema([("label", pa.int32()), ("s", doubles), ("q", doubles), ("n", doubles)])
    fitted = pa.schema([("label", pa.int32()), ("mu", doubles), ("var", doubles)])

    def added(found: dict, label: int | None, sums) -> None:
        """Add an array of sums, squares and counts to the label's, whichever is wider."""
        if label in found and found[label].shape[1] < sums.shape[1]:
            found[label], sums = sums.copy(), found[label]
        if label in found:
            found[label][:, : sums.shape[1]] += sums
        else:
            found[label] = sums.copy()

    def partial(batches: Iterable) -> Iterator:
        found: dict = {}
        for batch in batches:
            labels, images = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(images), 0).to_numpy(zero_copy_only=False)
            unknown = np.isnan(labels.astype(float))
            for label in np.unique(labels[~unknown]).astype(int).tolist() + [None] * bool(unknown.any()):
                own = unknown if label is None else labels == label
                for d in np.unique(lengths[own]).tolist():
                    x = images.take(pa.array(np.flatnonzero(own & (lengths == d)))).flatten()
                    there = pc.is_valid(x).to_numpy(zero_copy_only=False).reshape(-1, d) if d else np.zeros((1, 0), bool)
                    x = (pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False).reshape(-1, d) if d else np.zeros((1, 0))) - np.pad(pilot, (0, max(0, d - len(pilot))))[:d]
                    x = np.where(there, x, 0.0)
                    with np.errstate(over="ignore", invalid="ignore"):
                        sums = np.stack([x.sum(0), (x * x).sum(0), there.sum(0).astype(float)])
                        for k in {label, null_class}:
                            added(found, k, sums)
        for label, sums in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), *(pa.array([r], doubles) for r in sums)], schema=parts)

    def final(batches: Iterable) -> Iterator:
        found: dict = {}
        for batch in batches:
            for label, *sums in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                added(found, label, np.stack([r.values.to_numpy() for r in sums]))
        for label, (s, q, n) in found.items():
            with np.errstate(divide="ignore", invalid="ignore"):
                shift = s / n
                mu, var = np.pad(pilot, (0, max(0, len(s) - len(pilot))))[: len(s)] + shift, np.maximum(0, q / n - shift * shift)
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), *(pa.array([pa.array(v, mask=n == 0)], doubles) for v in (mu, var))], schema=fitted)

    sums = rows.mapInArrow(partial, "label int, s array<double>, q array<double>, n array<double>")
    return sums.repartition("label").mapInArrow(final, "label int, mu array<double>, var array<double>")
