"""The grid of segment counts: no link is lost, and the counts are what keeps candidates few."""

import random

from pyspark.sql import functions as F

from flowtab.llm import simhash


def prints(spark, n):
    """Random fingerprints, a tenth of them with a neighbour at one to four bits, and some of middling counts alone."""
    rng = random.Random(11)
    found = {rng.getrandbits(64) for _ in range(n)}
    for x in list(found)[: n // 10]:
        for bits in (1, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), bits):
                y ^= 1 << b
            found.add(y)
    # In each two-bit segment one bit: all in one cell of a single segmentation.
    found |= {sum(1 << (2 * s + rng.getrandbits(1)) for s in range(32)) for _ in range(n // 4)}
    found |= {0, (1 << 64) - 1, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA, 1, 1 << 63}
    signed = [x - (1 << 64) if x >> 63 else x for x in found]
    return found, spark.createDataFrame([(x,) for x in signed], "fp bigint").checkpoint()


def met(df):
    x, y, (same_cell, _) = simhash.candidates(df)
    return x.join(y, same_cell).count()


def test_no_link_is_lost_and_candidates_are_few(spark, monkeypatch):
    found, df = prints(spark, 1200)
    every = sorted(found)
    want = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if (a ^ b).bit_count() <= 3}
    got = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(df).collect()}
    assert got == want and len(want) > 300
    per_print = met(df) / len(found)
    assert per_print < 2
    # Without the counts all fingerprints are candidates of all others.
    monkeypatch.setattr(simhash, "counts", lambda half: F.lit(0).cast("bigint"))
    small, some = prints(spark, 150)
    assert met(some) > len(small) * (len(small) - 1)


def test_counts(spark):
    rng = random.Random(3)
    halves = [rng.getrandbits(32) for _ in range(200)] + [0, (1 << 32) - 1]
    rows = spark.createDataFrame([(h,) for h in halves], "h bigint").select("h", simhash.counts(F.col("h")).alias("c")).collect()
    assert all((r.c >> 2 * s) & 3 == ((r.h >> 2 * s) & 3).bit_count() for r in rows for s in range(16))
