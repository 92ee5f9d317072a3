"""Tables and edge cases that several tests of the training-data operators share."""

import os
import random

import pytest

DATA = "/root/testdata"
WORDS = "the of and to in is was for on with as at by from that this river stone cloud paper lamp green seven walk table north".split()
#: Names that operators may use for columns of their own.
CLASH = ["i", "k", "t", "c0", "n", "s", "y", "w", "a", "b", "doc", "piece", "pos", "g", "at", "raw", "word", "score", "rank", "tile", "a.b"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "s"]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in ids, texts and other columns, empty and long texts, repeated rows and ids, clashing names."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 12) for _ in range(3000))
    one = prose(rng, 40) + "\n" + prose(rng, 30)
    texts = [(1, one), (1, one), (1, prose(rng, 60)), (2, None), (3, ""), (None, one), (None, None), (4, long), (5, " \n\t\n "), (6, one + " x"), (8, "é\x00  ß\x1c½")]
    rows = [(i, t, "en" if i else None, None, len(t or ""), *[7] * len(CLASH)) for i, t in texts]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in CLASH)
    return spark.createDataFrame(rows, schema)


def table(spark, sf, name="documents"):
    path = f"{DATA}/{sf}/{name}.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    return spark.read.parquet(path)
