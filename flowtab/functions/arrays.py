"""Expressions on pixel and feature arrays. Images are row-major H, W, C."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(values: Column | str) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda a, x: a + x)


def mean(values: Column | str) -> Column:
    return total(values) / F.size(_col(values))


def normalize(pixels: Column | str) -> Column:
    """0..255 to -1..1."""
    return F.transform(_col(pixels), lambda x: x / 255.0 * 2.0 - 1.0)


def denormalize_u8(pixels: Column | str) -> Column:
    """-1..1 to 0..255, clipped, rounded half to even: the inverse of ``normalize``."""
    return F.transform(_col(pixels), lambda x: F.bround(F.least(F.greatest((x + 1.0) / 2.0 * 255.0, F.lit(0.0)), F.lit(255.0)), 0).cast("int"))


def to_unit(pixels: Column | str) -> Column:
    """-1..1 to 0..1, clipped."""
    return F.transform(_col(pixels), lambda x: F.least(F.greatest((x + 1.0) / 2.0, F.lit(0.0)), F.lit(1.0)))


def bind(fn: Callable[..., Column], *values: Column) -> Column:
    """``fn(*values)`` with each value worked out once, however often the result looks at it.

    An expression inside a lambda is worked out again for every element; a lambda's own argument is not.
    """
    packed = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.transform(F.array(packed), lambda s: fn(*(s[f"v{i}"] for i in range(len(values)))))[0]


def concat_channels(a: Column | str, b: Column | str, channels: int) -> Column:
    """Channels of ``a``, then of ``b``, for every pixel."""

    def joined(a: Column, b: Column) -> Column:
        pixel = lambda i: F.concat(F.slice(a, i * channels + 1, channels), F.slice(b, i * channels + 1, channels))
        return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(a) / channels).cast("int") - 1), pixel))

    return bind(joined, _col(a), _col(b))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def axpy(scale: Column | float, a: Column | str, b: Column | str) -> Column:
    """``scale * a + b``."""
    scale = F.lit(scale)
    return F.zip_with(_col(a), _col(b), lambda x, y: scale * x + y)


def interpolate(x: Column | str, s: Column | str, t: Column | float) -> Column:
    """``t * x + (1 - t) * s``."""
    t = F.lit(t)
    return F.zip_with(_col(x), _col(s), lambda a, b: t * a + (1.0 - t) * b)


def velocity(x: Column | str, z: Column | str, t: Column | float, eps: float = 0.05) -> Column:
    """``(x - z) / max(1 - t, eps)``."""
    rest = F.greatest(1.0 - F.lit(t), F.lit(eps))
    return F.zip_with(_col(x), _col(z), lambda a, b: (a - b) / rest)


def mean_squared(a: Column | str, b: Column | str) -> Column:
    return mean(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def mean_absolute(a: Column | str, b: Column | str) -> Column:
    return mean(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y)))


def psnr(a: Column | str, b: Column | str) -> Column:
    """Decibels between two images on [0, 1]; the squared error counts as 1e-10 at least, so 100 is the most."""
    return -10.0 * F.log10(F.greatest(mean_squared(a, b), F.lit(1e-10)))


def softmax(values: Column | str) -> Column:
    powers = bind(lambda v, top: F.transform(v, lambda x: F.exp(x - top)), _col(values), F.array_max(_col(values)))
    return bind(lambda e: bind(lambda e, whole: F.transform(e, lambda x: x / whole), e, total(e)), powers)


def remap(
    pixels: Column | str, h: Column, w: Column, c: Column, out_h: Column, out_w: Column, source: Callable[..., tuple[Column, Column]], *bound: Column
) -> Column:
    """An image of ``out_h`` by ``out_w`` whose (y, x) shows ``source(y, x, *bound)``; zero outside."""

    def made(px: Column, h: Column, w: Column, c: Column, out_h: Column, out_w: Column, *bound: Column) -> Column:
        def at(i: Column) -> Column:
            y, x = F.floor(i / (out_w * c)).cast("int"), (F.floor(i / c) % out_w).cast("int")
            sy, sx = source(y, x, *bound)
            inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
            return F.when(inside, F.get(px, ((sy * w + sx) * c + i % c).cast("int"))).otherwise(F.lit(0.0))

        return F.transform(F.sequence(F.lit(0), (out_h * out_w * c - 1).cast("int")), at)

    return bind(made, _col(pixels), h, w, c, out_h, out_w, *bound)


def sinusoidal_encode(value: Column | str, dim: int, period: float = 10_000.0, order: str = "cos,sin") -> Column:
    """Cosines and sines of the value at geometric frequencies; an odd ``dim`` ends in a zero."""
    half, v = dim // 2, _col(value).cast("double")
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: v * F.exp(-math.log(period) * i / float(half)))
    waves = {"cos": F.transform(angles, F.cos), "sin": F.transform(angles, F.sin)}
    parts = [waves[p] for p in order.split(",")]
    return F.concat(*parts, *([F.array(F.lit(0.0))] if dim % 2 else []))


def grid_encode(row: Column | str, col: Column | str, dim: int, period: float = 10_000.0) -> Column:
    """Sines and cosines of a place in a grid: the column's in the first half, the row's in the second."""
    if dim % 4:
        raise ValueError("dim must be a multiple of 4")
    return F.concat(*(sinusoidal_encode(v, dim // 2, period, "sin,cos") for v in (col, row)))
