"""The library's expressions as functions of SQL: ``register(spark)`` makes them known to a session.

They are SQL's own functions, defined by a body that Spark puts in their place, so a query with them is planned and compiled as one with the
body written out: no Python, and filters and columns are pushed down through them. ``patchify`` is a table function, for ``LATERAL``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_A = "ARRAY<DOUBLE>"
_SUM = "aggregate({0}, 0D, (s, x) -> s + x)"

#: Name, parameters, what is returned, and the body.
FUNCTIONS: list[tuple[str, str, str, str]] = [
    ("normalize", f"pixels {_A}", _A, "transform(pixels, x -> x / 255D * 2D - 1D)"),
    ("denormalize_u8", f"pixels {_A}", "ARRAY<INT>", "transform(pixels, x -> CAST(bround(least(greatest((x + 1D) / 2D * 255D, 0D), 255D), 0) AS INT))"),
    ("to_unit", f"pixels {_A}", _A, "transform(pixels, x -> least(greatest((x + 1D) / 2D, 0D), 1D))"),
    ("interpolate", f"x {_A}, s {_A}, t DOUBLE", _A, "zip_with(x, s, (a, b) -> t * a + (1D - t) * b)"),
    ("velocity", f"x {_A}, z {_A}, t DOUBLE, eps DOUBLE DEFAULT 0.05D", _A, "zip_with(x, z, (a, b) -> (a - b) / greatest(1D - t, eps))"),
    ("mean_squared", f"a {_A}, b {_A}", "DOUBLE", f"{_SUM.format('zip_with(a, b, (x, y) -> (x - y) * (x - y))')} / size(a)"),
    ("mean_absolute", f"a {_A}, b {_A}", "DOUBLE", f"{_SUM.format('zip_with(a, b, (x, y) -> abs(x - y))')} / size(a)"),
    ("psnr", f"a {_A}, b {_A}", "DOUBLE", f"IF(a IS NULL OR b IS NULL, NULL, -10D * log10(greatest({_SUM.format('zip_with(a, b, (x, y) -> (x - y) * (x - y))')} / size(a), 1e-10D)))"),
    # One-entry arrays bind what all entries need: the maximum, then the sum of the powers.
    (
        "softmax", f"scores {_A}", _A,
        "transform(transform(transform(array(named_struct('v', scores, 'm', array_max(scores))), s -> transform(s.v, x -> exp(x - s.m))), "
        f"e -> named_struct('e', e, 'n', {_SUM.format('e').replace('(s, x) -> s + x', '(n, x) -> n + x')})), s -> transform(s.e, x -> x / s.n))[0]",
    ),
    (
        "sinusoidal_encode", "value DOUBLE, dim INT, period DOUBLE DEFAULT 10000D", _A,
        "concat(transform(sequence(0, dim DIV 2 - 1), i -> cos(value * exp(-ln(period) * i / (dim DIV 2)))), transform(sequence(0, dim DIV 2 - 1), i -> sin(value * exp(-ln(period) * i / (dim DIV 2)))), "
        "IF(dim % 2 = 1, array(0D), CAST(array() AS ARRAY<DOUBLE>)))",
    ),
    (
        "patchify", f"pixels {_A}, h INT, w INT, c INT, p INT", f"TABLE(patch INT, patch_values {_A})",
        "SELECT k, transform(sequence(0, p * p * c - 1), i -> pixels[((k DIV (w DIV p) * p + i DIV (p * c)) * w + k % (w DIV p) * p + i DIV c % p) * c + i % c]) "
        "FROM explode(IF(pixels IS NULL OR h < p OR w < p, CAST(array() AS ARRAY<INT>), sequence(0, (h DIV p) * (w DIV p) - 1))) AS t(k)",
    ),
]


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the functions known to this session, as temporary ones; gives their names. ``prefix`` keeps them apart from others."""
    for name, parameters, returns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {returns} RETURN {body}")
    return [prefix + name for name, *_ in FUNCTIONS]
