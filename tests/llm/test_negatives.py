"""Strassen products, heaps and mined negatives against plain versions, and edge cases."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtab.llm import negatives, queries
from tests_llm_common import DATA, table


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 64, 7), (17, 33, 40), (130, 64, 97), (64, 3, 64), (3, 0, 4)])
def test_strassen(shape):
    g = np.random.default_rng(3)
    m, k, n = shape
    for most in (137, 1 << 40):
        a, b = g.integers(-most, most, (m, k)), g.integers(-most, most, (k, n))
        got = negatives.strassen(a, b) if k else a @ b
        with np.errstate(over="ignore"):
            assert (got == a @ b).all()  # modulo 2^64, where products pass a long


@pytest.mark.parametrize("least", [33, 34, 65, 66, 129, 131])
def test_strassen_sides_padded_past_a_leaf(least):
    g = np.random.default_rng(7)
    for shape in ((least, 64, 140), (140, least, 64), (64, 140, least)):
        m, k, n = (max(s, least) for s in shape)
        a, b = g.integers(-137, 137, (m, k)), g.integers(-137, 137, (k, n))
        assert (negatives.strassen(a, b) == a @ b).all()


def test_heaps_merge():
    g = np.random.default_rng(4)
    for kept in (1, 3, 5):
        scores, nulls = g.integers(0, 6, (4, 300)), g.random(300) < 0.05
        ids = np.where(nulls, 0, g.integers(0, 50, 300))
        allowed = g.random((4, 300)) < 0.8
        heaps = negatives.Heaps(4, kept)
        for at in range(0, 300, 60):
            heaps.push_where(0, scores[:, at : at + 60], allowed[:, at : at + 60], nulls[at : at + 60], ids[at : at + 60])
        row, score, null, i = heaps.entries
        for r in range(4):
            want = sorted((-s, n, x) for s, n, x, ok in zip(scores[r], nulls, ids, allowed[r]) if ok)[:kept]
            assert [(-s, n, x) for s, n, x in zip(score[row == r], null[row == r], i[row == r])] == want


def plain(rows, kept=5, low=80, high=100):
    """By the definition, pair by pair: rows of (id, label, vector, is_anchor)."""
    usable = [(i, lab, [math.floor(256 * float(x)) for x in v], anchor) for i, lab, v, anchor in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for a, lab, v, anchor in {(i, lab, tuple(v), anchor) for i, lab, v, anchor in usable if anchor}:
        near = sorted(((score(v, w), i) for i, other, w, _ in usable if other == lab and i != a), key=key)[:kept]
        for best, p in near:
            found = sorted(((s, i) for s, i in ((score(v, w), i) for i, other, w, _ in usable if other != lab) if low * best <= 100 * s <= high * best), key=key)[:kept]
            out += [(a, p, rank, i, best, s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, label int, embedding array<double>, anchor boolean, key int, `a.b` string")
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("anchor"), **how).collect()), key=str)


def test_ties_nulls_and_repeated_rows(spark):
    g = random.Random(5)
    rows = []
    for i in range(160):
        v = [g.choice([0.25, 0.5, 0.75, -0.25, 1.0]) for _ in range(g.choice([3, 3, 3, 2, 0]))]
        rows.append((i, g.choice([0, 0, 0, 1, 2, 70]), v, i % 9 == 0))
    rows += rows[:12]  # repeated, anchors among them
    rows += [(None, 0, [1.0, 1.0, 1.0], False), (None, 1, [1.0, 0.5], False), (200, None, [1.0], True), (201, 1, None, True), (202, 1, [1.0, None], True), (203, 0, [math.nan], True), (204, 0, [-math.inf, 1.0], True)]
    rows += [(9, 1, [0.5, 0.5, 0.5], True)]  # one id twice, as two anchors
    want = plain(rows)
    assert want
    assert mined(spark, rows) == want
    assert mined(spark, rows, tile=7) == want  # many tiles, sides that are padded


def test_parameters_and_large_components(spark):
    g = random.Random(6)
    rows = [(i, i % 3, [g.uniform(-9e3, 9e3) for _ in range(20)], i % 10 == 0) for i in range(90)]
    for how in ({"low": 33, "high": 97}, {"low": 0, "high": 100}):
        assert mined(spark, rows, **how) == plain(rows, **how)
    assert len(mined(spark, rows, positives=2, negatives=1)) > 0
    with pytest.raises(Exception, match="would not fit a long"):
        mined(spark, [(0, 1, [1e9] * 2, True), (1, 1, [1e9] * 2, False)])


def test_empty_and_without_anchors(spark):
    assert mined(spark, [(1, 0, [1.0], False), (2, 1, [1.0], False)]) == []
    assert mined(spark, [(1, 0, [1.0], True)]) == []
    assert mined(spark, [(1, None, [1.0], True)]) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    table(spark, sf, "embeddings")
    got = queries.op12_hard_negatives(spark, f"{DATA}/{sf}")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/{sf}/embeddings.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op12_hard_negatives']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
