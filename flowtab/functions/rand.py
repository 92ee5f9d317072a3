"""Random numbers as functions of keys: the same on any partitioning, retry or engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed: int | str, keys: tuple) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys)))


def _unit(digest: Column, at: int) -> Column:
    """Eight hex digits as a number in [0, 1)."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("double") / float(1 << 32)


def hash_uniform(seed: int | str, *keys: Column | str | int) -> Column:
    """Uniform in [0, 1), by the MD5 of seed and keys."""
    return _unit(_key(seed, keys), 1)


def hash_normal(seed: int | str, *keys: Column | str | int) -> Column:
    """Standard normal by Box-Muller from the two halves of the MD5 of seed and keys."""
    digest = _key(seed, keys)
    return F.sqrt(-2 * F.ln(_unit(digest, 1) + 2.0**-33)) * F.cos(2 * math.pi * _unit(digest, 9))


def normals(seed: int | str, ids, n: int):
    """``hash_normal(seed, id, place)`` for places 0 to n - 1 of each id, as a NumPy array (ids, n): the same numbers without a column for each."""
    import hashlib

    import numpy as np

    digests = bytearray()
    md5 = hashlib.md5
    for i in ids:
        # A key that is null is left out of the text, as concat_ws does.
        state = md5(f"{seed}:".encode() if i is None else f"{seed}:{i}:".encode())
        for place in range(n):
            one = state.copy()
            one.update(b"%d" % place)
            digests += one.digest()[:8]
    words = np.frombuffer(bytes(digests), ">u4").reshape(len(ids), n, 2) / float(1 << 32)
    return np.sqrt(-2 * np.log(words[..., 0] + 2.0**-33)) * np.cos(2 * math.pi * words[..., 1])
