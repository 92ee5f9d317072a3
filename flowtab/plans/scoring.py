"""Batch sampling: a state is led from noise (or a condition) to an image along predicted velocities.

A predictor is either a function of columns, ``predict(z, t, label, condition) -> Column``, which keeps the whole loop one
expression, or a callable over NumPy stacks, ``predict(z, t, labels, carried) -> stack``, which runs in Arrow batches. Either
way rows do not move: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.arrow import map_in_arrow
from ..functions.joins import dealt_left
from ..functions.rand import normals
from ..operators.flow import bridge_source, noise

Predictor = Callable[[Column, Column, Column, Column], Column]
_REGISTRY: dict[str, Callable[..., Predictor]] = {}


def register_predictor(name: str) -> Callable:
    """Make a predictor's builder known by name."""

    def known(build: Callable[..., Predictor]) -> Callable[..., Predictor]:
        _REGISTRY[name] = build
        return build

    return known


def predictor(name: str, **options) -> Predictor:
    if name not in _REGISTRY:
        raise ValueError(f"unknown predictor: {name}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name](**options)


@register_predictor("target")
def target_predictor(column: str = "target") -> Predictor:
    """Knows the answer; for tests."""
    return lambda z, t, label, condition: F.col(column)


@register_predictor("condition")
def condition_predictor(column: str = "condition") -> Predictor:
    return lambda z, t, label, condition: F.col(column)


@register_predictor("class_gaussian")
def class_gaussian(null_class: int = 10, scale: float = 1.0) -> Predictor:
    """Posterior mean under the label's pixel-wise Gaussian; rows carry ``mu, var`` and ``mu_null, var_null``.

    With source scale s: mu + t var / (t^2 var + (1 - t)^2 s^2) * (z - t mu).
    """

    def predict(z: Column, t: Column, label: Column, condition: Column) -> Column:
        free = label == null_class
        mu, var = (F.when(free, F.col(f"{c}_null")).otherwise(F.col(c)) for c in ("mu", "var"))
        gain = F.zip_with(mu, var, lambda m, v: F.struct(m.alias("m"), (t * v / (t * t * v + (1.0 - t) * (1.0 - t) * scale * scale)).alias("g")))
        return F.zip_with(gain, z, lambda s, x: s["m"] + s["g"] * (x - t * s["m"]))

    return predict


def with_class_gaussian(df: DataFrame, stats: DataFrame, null_class: int) -> DataFrame:
    """Add ``mu, var`` of each row's label and ``mu_null, var_null``.

    Statistics have one row for each class, of the images' size; Spark broadcasts them only if they are small. Else the rows of a
    label are dealt to several tasks, by ``id``.
    """
    both = stats.join(stats.where(F.col("label") == null_class).select(F.lit(True).alias("one"), F.col("mu").alias("mu_null"), F.col("var").alias("var_null")), F.col("one"))
    known = both.drop("one").withColumnRenamed("label", "__ft_label")
    return dealt_left(df, known, F.col("label") == F.col("__ft_label"), F.xxhash64("id")).drop("__ft_label")


def guided_velocity(predict: Predictor, null_class: int, scale: float = 1.0, drop: float = 0.1, low: float = 0.0, high: float = 1.0, eps: float = 0.05) -> Callable:
    """``v(z, t)``: the label's velocity, or its mix with the null class's where guidance is on.

    Guidance needs a scale other than 1 and labels that were dropped in training; it acts for t < high and, unless low is
    0, t > low.
    """

    def of(z: Column, t: Column, label: Column) -> Column:
        return A.velocity(predict(z, t, label, F.lit(None)), z, t, eps)

    def velocity(z: Column, t: Column) -> Column:
        v = of(z, t, F.col("label"))
        if scale == 1.0 or drop <= 0:
            return v
        inside = (t < high) & (t > low) if low else t < high
        weight = F.when(inside, scale).otherwise(1.0)
        return F.zip_with(of(z, t, F.lit(null_class)), v, lambda u, c: u + weight * (c - u))

    return velocity


def euler_step(velocity: Callable, z: Column, t: Column, t_next: Column) -> Column:
    return F.zip_with(z, velocity(z, t), lambda x, v: x + (t_next - t) * v)


def heun_step(velocity: Callable, z: Column, t: Column, t_next: Column) -> Column:
    """The mean of the velocities here and where the Euler step leads."""
    slopes = F.struct(velocity(z, t).alias("a"), z.alias("z"))
    # Bound by a one-entry transform, so that the first velocity is worked out once.
    return F.transform(
        F.array(slopes),
        lambda s: F.zip_with(
            s["z"],
            F.zip_with(s["a"], velocity(F.zip_with(s["z"], s["a"], lambda x, v: x + (t_next - t) * v), t_next), lambda a, b: 0.5 * (a + b)),
            lambda x, v: x + (t_next - t) * v,
        ),
    )[0]


def sampled(source: Column, velocity: Callable, method: str, steps: int) -> Column:
    """The state after ``steps`` uniform steps from t = 0 to 1; the last one is always Euler."""
    if method not in ("euler", "heun"):
        raise ValueError(f"unknown method: {method}")
    step = {"euler": euler_step, "heun": heun_step}[method]
    at = lambda i: i / float(steps)
    z = source
    if steps > 1:
        z = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 2)), source, lambda z, i: step(velocity, z, at(i), at(i + 1)))
    return F.transform(F.array(z), lambda last: euler_step(velocity, last, F.lit(at(steps - 1)), F.lit(1.0)))[0]


def generate(
    df: DataFrame, predict: Predictor, null_class: int, method: str = "heun", steps: int = 50, scale: float = 1.0, drop: float = 0.1,
    low: float = 0.0, high: float = 1.0, eps: float = 0.05, seed: int = 0, noise_scale: float = 1.0, like: str = "target", out: str = "pixels",
) -> DataFrame:
    """Add ``out``: images sampled for each row's ``label`` from noise by the row's ``id``; a column ``source`` is used if there."""
    df = df if "source" in df.columns else df.withColumn("source", noise(like, noise_scale, seed))
    return df.withColumn(out, sampled(F.col("source"), guided_velocity(predict, null_class, scale, drop, low, high, eps), method, steps))


def restore(df: DataFrame, predict: Predictor, null_class: int, method: str = "heun", steps: int = 8, mode: str = "condition", bridge_noise: float = 0.0, seed: int = 0, out: str = "pixels", **options) -> DataFrame:
    """``generate`` from the condition; rows without a label have 0."""
    df = df if "label" in df.columns else df.withColumn("label", F.lit(0))
    return generate(bridge_source(df, seed, mode, bridge_noise), predict, null_class, method, steps, seed=seed, out=out, **options)


def class_gaussian_arrays(null_class: int = 10, scale: float = 1.0) -> Callable:
    """``class_gaussian`` over stacks; rows carry ``mu, var, mu_null, var_null``, so ask for these by ``carry``."""

    def predict(z, t, labels, carried):
        import numpy as np

        free = (labels == null_class)[:, None]
        mu, var = (np.where(free, carried[f"{c}_null"], carried[c]) for c in ("mu", "var"))
        return mu + t * var / (t * t * var + (1.0 - t) * (1.0 - t) * scale * scale) * (z - t * mu)

    return predict


def generate_with(
    df: DataFrame, predict: Callable, null_class: int, method: str = "heun", steps: int = 50, scale: float = 1.0, drop: float = 0.1,
    low: float = 0.0, high: float = 1.0, eps: float = 0.05, seed: int = 0, noise_scale: float = 1.0, like: str = "target", carry: tuple[str, ...] = (), out: str = "pixels",
) -> DataFrame:
    """``generate`` in Arrow batches, with a callable over NumPy stacks, such as a network: ``predict(z, t, labels, carried) -> stack``.

    ``df`` has ``id`` and ``label``, and ``source`` or else an array column ``like``, of whose length the noise is made, the same numbers as
    ``generate``'s. ``carried`` has the columns of ``carry`` as stacks. The callable goes to the workers once, as a broadcast; its size is the
    caller's to bound. States of one length are worked on together; a null state gives a null image. All columns of ``df`` stay.
    """
    if method not in ("euler", "heun"):
        raise ValueError(f"unknown method: {method}")
    df = df.drop(out) if out != like else df
    begin = "source" if "source" in df.columns else like
    shipped = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(predict))
    target = df.withColumn("__ft_out", F.lit(None).cast("array<double>")).schema

    def sampled(model, z, labels, carried):
        import numpy as np

        of = lambda z, t, labels: (model(z, t, labels, carried) - z) / max(1.0 - t, eps)

        def velocity(z, t):
            v = of(z, t, labels)
            if scale == 1.0 or drop <= 0:
                return v
            u = of(z, t, np.full_like(labels, null_class))
            return u + (scale if t < high and (low == 0 or t > low) else 1.0) * (v - u)

        for k in range(steps):
            t, t_next = k / steps, (k + 1) / steps
            v = velocity(z, t)
            if method == "heun" and k < steps - 1:
                v = 0.5 * (v + velocity(z + (t_next - t) * v, t_next))
            z = z + (t_next - t) * v
        return z

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(target)
        kind, model = schema.field("__ft_out").type, cloudpickle.loads(shipped.value)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(begin)), -1).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                rows = batch.take(pa.array(np.flatnonzero(lengths == n)))
                if n < 0:
                    made = pa.nulls(rows.num_rows, kind)
                else:
                    stack = lambda c: rows.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)  # noqa: B023, E731
                    z = stack(begin) if begin == "source" else noise_scale * normals(f"{seed}:noise", rows.column("id").to_pylist(), int(n))
                    labels = rows.column("label").to_numpy(zero_copy_only=False)
                    made = sampled(model, z, labels, {c: stack(c) for c in carry})
                    ends = pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * n)
                    made = pa.ListArray.from_arrays(ends, pa.array(made.ravel())).cast(kind)
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name).cast(f.type) for f in list(schema)[:-1]), made], schema=schema)

    done = map_in_arrow(df, run, target)
    return done.drop(out).withColumnRenamed("__ft_out", out) if out in df.columns else done.withColumnRenamed("__ft_out", out)
