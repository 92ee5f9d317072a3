"""The stages one after the other on a small corpus with planted cases."""

import os
import random

import pytest

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == columns, name
        counts.append(out.count())
        docs = out
        if name == "toxicity":
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            assert len(left & toxic) <= 0.3 * len(toxic)
        if name == "near-dedup":
            texts = [r.text for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts))
        if name == "secret scans":
            assert docs.where(r"text rlike 'AKIA[A-Z0-9]{12,}|password=[0-9a-f]{8,}'").count() == 0
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    assert 4 <= len(pipeline.STAGES) <= 5


def test_edges_of_each_stage(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names, and an empty table, through every stage."""
    rng = random.Random(41)
    line = lambda n: " ".join(rng.choice("abcdefghij") + "".join(rng.choices("klmnopqrst", k=5)) for _ in range(n))
    one, long = "\n".join(line(30) for _ in range(4)), "\n".join(line(40) for _ in range(20_000))  # some 5 MB
    rows = [(1, one), (1, one), (1, line(50)), (2, None), (3, ""), (None, one), (None, None), (None, None), (4, long), (5, " \n\t\n"), (6, f"password=abcdefgh12 at https://db.example.com/x {line(20)}")]
    names = ["n_lines", "n_dropped", "row_key", "fp", "spans", "a.b", "text2", "__ft", "w", "s"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, None, None, None, *["x"] * len(names)) for i, t in rows], schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        out = stage(spark, docs, DATA)
        if name == "packing":
            assert out.select("doc_id").distinct().count() == 7
            continue
        assert out.columns == docs.columns, name
        got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
        if name == "near-dedup":
            assert [i for i, _ in got] == [1, 1, 2, 4, 6]
        else:
            assert len(got) == len(rows), name
            # The long text, without anything that recurs or is secret, stays as it is.
            assert (4, long) in got
        if name == "secret scans":
            assert any(t.startswith("[assign] at [endpoint] ") for _, t in got)


def test_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
