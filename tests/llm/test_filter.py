"""The filter of keys that is sent to tasks."""

from pyspark.sql import functions as F

from flowtab.llm import line_dedup
from flowtab.llm.common import key_filter, may_hold


def hashes(spark, first, n):
    return spark.range(first, first + n).select(F.xxhash64("id").alias("k"))


def test_filter_holds_all_and_few_others(spark):
    for n in (0, 1, 700, 90_000):
        found = key_filter(hashes(spark, 0, n), "k")
        assert hashes(spark, 0, n).where(may_hold(found, F.col("k"))).count() == n
        assert hashes(spark, 1 << 40, 50_000).where(may_hold(found, F.col("k"))).count() < 1500
    assert key_filter(hashes(spark, 0, 700), "k", 4096) is None


def test_plans_do_not_spell_the_filter_out(spark):
    # 20,000 texts lose a line each: a filter of 32 KB, which was in the plan's text a dozen times.
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one line that recurs in all of the texts\n"), F.md5(F.col("id").cast("string"))).alias("text"))
    out = line_dedup.dedup_lines(docs)
    assert len(out._jdf.queryExecution().toString()) < 200_000
    assert out.where("instr(text, 'recurs') > 0").count() == 1
