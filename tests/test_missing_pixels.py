"""Images with single null pixels, whole null images, and files split into tasks without rows, against each query's SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

QUERIES = ["h2_guided_velocity", "h3_euler_step", "h4_heun_step", "h5_generate", "h6_restore", "h7_evaluate_generation", "h7_generation_scores"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    g, schema = np.random.default_rng(5), pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    rows = [{"vec_id": i, "embedding": g.normal(0, 0.2, 64).tolist(), "label": i % 10} for i in range(80)]
    rows[3]["embedding"][0] = rows[14]["embedding"][63] = rows[14]["embedding"][7] = None
    rows[25]["embedding"] = [None] * 64
    rows[36]["embedding"] = None
    rows[47]["label"] = None
    found = tmp_path_factory.mktemp("missing")
    (found / "embeddings.parquet").mkdir()
    for k in range(2):
        pq.write_table(pa.Table.from_pylist(rows[k * 40 : k * 40 + 40], schema=schema), found / f"embeddings.parquet/part-{k}.parquet")
    return str(found)


@pytest.mark.parametrize("name", QUERIES)
def test_against_sql(spark, folder, name):
    bytes_before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # each file has one group of rows, so most tasks have none
    try:
        found = entry.queries()[name](spark, folder)
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_before)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: [str(round(v, 4) + 0.0 if isinstance(v, float) else v) for v in r]
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want)) and want
