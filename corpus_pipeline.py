"""A corpus pipeline: toxic documents, recurring lines, near-duplicates and secrets go, the rest is packed.

Each stage takes the documents that the one before kept, as Parquet, and works on all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtab.llm import line_dedup, near_copies, packing, secrets, simhash, toxicity
from flowtab.llm.common import shared_path, stored
from flowtab.llm.queries import table, vocabulary


def _sized(df: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now, where the table has that column."""
    if "n_chars" not in df.columns:
        return df
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(line_dedup.dedup_lines(docs, keep_whole=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash components first, as in op10; of the texts they leave, those that are alike by their exact shingles go too.

    What SimHash leaves is stored: the shingles read it four times, and each time its joins would be planned, compiled and run again.
    """
    return near_copies.keep_one(stored(simhash.keep_one(docs), "simhash"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack),
]
#: No SQL: a trained model, XXH64 fingerprints and tokenizers are beyond it; tests/llm holds it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{at}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
