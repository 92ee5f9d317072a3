"""Line dedup as the pipeline runs it."""

import random

import corpus_pipeline as pipeline
from flowtab.llm import line_dedup


def line(rng, n):
    return " ".join(rng.choice("abcdefghij") + "".join(rng.choices("klmnopqrst", k=5)) for _ in range(n))


def left(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r.text for r in pipeline.dedup_lines(spark, df, "").collect()}


def test_long_lines_of_two_texts(spark):
    rng = random.Random(31)
    passage, edge, short = line(rng, 55), line(rng, line_dedup.LONG), line(rng, line_dedup.LONG - 1)
    own = [line(rng, 60) for _ in range(3)]
    got = left(spark, ["\n".join([own[0], passage, short, edge]), "\n".join([passage, own[1], short]), "\n".join([own[2], edge])])
    assert got == {0: "\n".join([own[0], passage, short, edge]), 1: f"{own[1]}\n{short}", 2: own[2]}


def test_passage_in_short_texts(spark):
    rng = random.Random(32)
    passage, own = line(rng, 80), [line(rng, 12) for _ in range(4)]
    got = left(spark, [f"{own[0]}\n{passage}", f"{passage}\n{own[1]}", f"{own[2]}\n{passage}\n{own[3]}", passage])
    # The last one would lose all: near-dedup's to decide.
    assert got == {0: f"{own[0]}\n{passage}", 1: own[1], 2: f"{own[2]}\n{own[3]}", 3: passage}
