"""Frequent phrases and collocations against a plain version, both ways of the semi-join, and edge cases."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from flowtab.llm import collocations, queries
from tests_llm_common import DATA, edge, table  # noqa: F401

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, longest=5, first=2000):
    """By the definition, text by text: rows of (lang, text)."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    out = []
    for (lang, p), a in f.items():
        if len(p) > 1:
            inside = any(g == lang and len(q) > len(p) and f[g, q] >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for g, q in f)
            if not inside:
                score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
                out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out.sort()
    got, rank = [], Counter()
    for lang, score, a, phrase, left, right, total in out:
        rank[lang] += 1
        if rank[lang] <= first:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -score))
    return got


def found(df, **how):
    return sorted(map(tuple, collocations.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["New", "new", "york", "CITY", "the", "of", "É", "é", "a-b", "x\xa0y", "z"]
    rows = []
    for _ in range(200):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "! ", " \r\n", " \x0b"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "en", "de", None]), " " * rng.randint(0, 2) + text))
    return rows + rows[:20] + [("en", None), ("en", ""), (None, None), ("fr", " . "), ("en", "new york city the " * 400)]


@pytest.mark.parametrize("least,longest,first,most_sent", [(5, 5, 2000, 500_000), (3, 4, 7, 0), (9, 2, 3, 4), (1, 5, 50, 10)])
def test_against_plain(spark, texts, least, longest, first, most_sent):
    df = spark.createDataFrame(texts, "lang string, text string")
    want = plain(texts, least, longest, first)
    assert want and found(df, least=least, longest=longest, first=first, most_sent=most_sent) == sorted(want)


def test_scores_beyond_64_bits(spark):
    got = collocations.F.call_function("div", F.lit(1000) * F.lit(10**17).cast("decimal(20,0)") * F.lit(10**17).cast("decimal(20,0)"), F.lit(10**17).cast("decimal(20,0)") * F.lit(10**16 + 1).cast("decimal(20,0)"))
    assert spark.range(1).select(got).first()[0] == 1000 * 10**34 // (10**17 * (10**16 + 1))


def test_merge_joins_in_place(spark, texts):
    """A relation's join with itself neither shuffles nor sorts its left side."""
    rows = [(d, p, i, i % 3) for d in range(20) for p in range(2) for i in range(5)]
    df = spark.createDataFrame(rows, "doc bigint, piece int, pos int, g bigint").repartition(8, "doc")
    with collocations._ordered_buckets(spark):
        pairs = collocations._adjacent(collocations._relation(df, 8))
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Sort [") <= 1
        assert pairs.count() == 20 * 2 * 4


def test_edges(spark, edge):  # noqa: F811
    rows = [(r.lang, r.text) for r in edge.select("lang", "text").collect()]
    assert found(edge, least=20) == sorted(plain(rows, 20))
    assert found(edge.limit(0)) == []
    assert found(edge.where("text is null")) == []
    every_null = spark.createDataFrame([(None, "a b a b a b c")] * 3, "lang int, text string")
    assert found(every_null, least=3) == sorted(plain([(None, "a b a b a b c")] * 3, 3))


def test_against_sql(spark):
    table(spark, "sf0.01")
    got = queries.op13_collocations(spark, f"{DATA}/sf0.01")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.01/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op13_collocations']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
