"""What collocations leave on disk, what moves beyond the limits, and both widths of words' numbers."""

from pathlib import Path

import pytest

from flowtab.llm import collocations
from test_collocations import found, plain, texts  # noqa: F401


def test_relations_go(spark, texts):  # noqa: F811
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    there = lambda: (set(folder.glob("flowtab-relation*")), {t.name for t in spark.catalog.listTables()}, {d.name for d in spark.catalog.listDatabases()})
    before = there()
    assert collocations.frequent_phrases(spark.createDataFrame(texts, "lang string, text string"), least=5)[0].count()
    assert there() == before


def test_occurrences_stay(spark):
    """Beyond the limit the frequent groups' occurrences are kept where they are, not joined by a shuffle."""
    rows = [(d, 0, i, i if i < 10 else 30 * d + i) for d in range(40) for i in range(30)]
    df = spark.createDataFrame(rows, "doc bigint, piece int, pos int, g bigint").repartition(8, "doc")
    packed = collocations._Packed(1200)
    with collocations._ordered_buckets(spark):
        longer = packed.longer(collocations._adjacent(collocations._relation(df, 8)), 1)
        groups = longer.groupBy("g").count().where("count > 25").select("g")
        kept = collocations._frequent(longer, groups, ["g"], False)
        plan = kept._jdf.queryExecution().executedPlan().toString().split("===== Subqueries")[0]
        assert plan.count("Join") == 1 and "Exchange hashpartitioning" not in plan
        exact = longer.join(groups, "g", "left_semi").select(longer.columns)
        assert 0 < exact.count() <= kept.count() < longer.count() and not exact.exceptAll(kept).count()


@pytest.mark.parametrize("most_sent", [0, 500_000])
def test_wide_numbers(spark, texts, monkeypatch, most_sent):  # noqa: F811
    wide = collocations._Packed(1 << 22)
    assert (wide.ids(5), collocations._Packed(1 << 21).ids(5)) == (["g", "g1", "g2"], ["g", "g1"])
    monkeypatch.setattr(collocations, "_Packed", lambda words: wide)
    assert found(spark.createDataFrame(texts, "lang string, text string"), least=3, most_sent=most_sent) == sorted(plain(texts, 3))
