"""Tasks without rows, counts that do not divide, and images without label or pixels, against plain figures and each query's SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from flowtab.operators import metrics, order

ROWS = 93
GAUSSIAN = ["c5_lookup_embedding", "g13_class_gaussian", "h2_guided_velocity", "h3_euler_step", "h4_heun_step", "h5_generate", "h7_evaluate_generation", "h7_generation_scores"]
RESTORED = ["h6_restore", "h8_evaluate_restoration"]


def fitted(df, null_class=3):
    return {r.label: (r.mu, r["var"]) for r in metrics.fit_class_gaussian(df, null_class).collect()}


def test_class_gaussian_of_tasks_without_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 2.0]), (1, [5.0, 8.0])], "label int, target array<double>")
    want = {0: ([2.0, 2.0], [1.0, 0.0]), 1: ([5.0, 8.0], [0.0, 0.0]), 3: ([3.0, 4.0], [8 / 3, 8.0])}
    got = fitted(df.repartition(16))
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k])
    assert fitted(df.limit(0)) == {}


def test_class_gaussian_of_missing_pixels(spark):
    nan = float("nan")
    rows = [(0, [1.0, None, 4.0]), (0, None), (0, [3.0, 6.0]), (1, [None, None]), (None, [7.0]), (2, [nan, 1.0]), (2, [1.0, 1.0, float("inf")])]
    for n in (1, 4, 9):
        got = fitted(spark.createDataFrame(rows, "label int, target array<double>").repartition(n))
        assert got[0] == ([2.0, 6.0, 4.0], [1.0, 0.0, 0.0]) and got[None] == ([7.0], [0.0]) and set(got[1][0]) == {None}
        assert np.isnan(got[2][0][0]) and got[2][0][1] == 1.0 and np.isinf(got[2][0][2])
        assert np.isnan(got[3][0][0]) and np.isclose(got[3][0][1], 8 / 3)  # all images, those without a label too


def test_label_plan_with_rows_left_over(spark):
    rows = spark.range(23).withColumnRenamed("id", "idx")
    with pytest.raises(ValueError, match="evenly"):
        order.label_plan(rows, 10)
    assert [r.label for r in order.label_plan(rows, 10, even=False).orderBy("idx").collect()] == [i // 2 for i in range(23)]
    assert {r.label for r in order.label_plan(rows.limit(4), 10, even=False).collect()} == {None}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Embeddings in files of which one is empty; ``plain`` ones, and such with null labels and vectors."""
    g, schema = np.random.default_rng(2), pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    rows = [{"vec_id": i, "embedding": g.normal(0, 0.2, 64).tolist(), "label": int(g.integers(0, 10)) if i > 9 else i} for i in range(ROWS)]
    out = {}
    for kind in ("plain", "odd"):
        if kind == "odd":
            for i in (20, 41, 77):
                rows[i]["embedding"], rows[i + 1]["label"] = None, None
        folder = tmp_path_factory.mktemp(kind)
        (folder / "embeddings.parquet").mkdir()
        table = pa.Table.from_pylist(rows, schema=schema)
        for k in range(3):
            pq.write_table(table.slice(k * 60, 60), folder / f"embeddings.parquet/part-{k}.parquet")
        out[kind] = str(folder)
    return out


@pytest.mark.parametrize("kind, name", [*(("plain", n) for n in ["e5_label_plan", *GAUSSIAN, *RESTORED]), *(("odd", n) for n in ["e5_label_plan", *GAUSSIAN])])
def test_against_sql(spark, odd, kind, name):
    got = entry.queries()[name](spark, odd[kind])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{odd[kind]}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: [(v is None, round(v, 4) + 0.0 if isinstance(v, float) else v) for v in r]
    said = lambda rows: sorted(([str(v) for v in key(r)] for r in rows), key=str)
    assert said(map(tuple, got.collect())) == said(want) and want
