"""Near-dedup's second method reads what the first one stored, not the first one's joins again."""

import corpus_pipeline as pipeline


def test_simhash_is_stored_once(spark, tmp_path):
    words = [" ".join(f"{w}{i}" for w in "abcdefghijklmnopqrstuvwxyz") for i in range(12)]
    rows = [(i, words[i % 12] + (" z" if i == 13 else "")) for i in range(30)]
    source = str(tmp_path / "given")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(source)
    out = pipeline.drop_near_duplicates(spark, spark.read.parquet(source), "")
    assert not any("/given/" in f for f in out.inputFiles())
    assert sorted(r.doc_id for r in out.collect()) == list(range(12))
