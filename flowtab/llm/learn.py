"""What the trained operators share: folds, bounded samples, terms, selection of terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import per_row, row_key, use_checkpoints

_WORD = re.compile(r"[^\W\d_]+")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids get 1, so they are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1)).cast("int")


def word_terms(word: str) -> list[str]:
    """A word and its beginnings, which compounds and inflections share."""
    return [word, *beginnings(word)]


def beginnings(word: str) -> list[str]:
    return [f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n]


def word_counts(text: str | None) -> dict[str, int]:
    return Counter(_WORD.findall(text.lower())) if text else {}


def is_frequent(count: int, words: int) -> bool:
    """Whether a beginning is frequent in a text: twice or more, and in one word of a hundred."""
    return count >= 2 and 100 * count >= words


def text_terms(text: str | None) -> set[str]:
    """Words, beginnings, and once more the beginnings that are frequent in the text."""
    words = word_counts(text)
    total, found = sum(words.values()), set(words)
    starts: Counter[str] = Counter()
    for word, n in words.items():
        for start in beginnings(word):
            starts[start] += n
    found.update(starts)
    found.update(f"{start}+" for start, n in starts.items() if is_frequent(n, total))
    return found


def hashed(term: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) - (1 << 63)


def labelled_ids(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids of folds 1 to 4, by the order of their hash: ``doc_id, y, fold``.

    An id with several labels has the largest; rows without id or label are left out.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .withColumn("fold", fold(F.col("doc_id")))
        .where("fold != 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def sample_features(df: DataFrame, ids: DataFrame, make: Callable, columns: list[str], fields: str) -> DataFrame:
    """Features of the documents in ``ids``, one row per id (of several texts, that with the smallest hash).

    ``ids`` is bounded by its caller, so it is broadcast; the documents do not move.
    """
    use_checkpoints(df.sparkSession)
    rows = df.join(F.broadcast(ids), "doc_id").withColumn("__ft_key", row_key(F.col("text")))
    kind = ids.schema["doc_id"].dataType.simpleString()
    got = per_row(rows, ["doc_id", "y", "fold", "__ft_key", *columns], make, f"doc_id {kind}, y int, fold int, k binary, {fields}")
    names = [c for c in got.columns if c not in ("doc_id", "k")]
    return got.groupBy("doc_id").agg(*(F.min_by(c, "k").alias(c) for c in names)).checkpoint()


def within(sample: DataFrame, array: str, most: int) -> DataFrame:
    """The rows of a sample, in the order of their ids' hashes, whose arrays hold ``most`` entries altogether: a bound in bytes.

    Only ids and sizes, one for each of the sample's bounded rows, meet in one place.
    """
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sample.select("doc_id", F.sum(F.size(array)).over(order).alias("n"))
    return sample.join(F.broadcast(sizes.where(F.col("n") <= most).select("doc_id")), "doc_id", "left_semi")


def telling_terms(sample: DataFrame, least_documents: int = 4, least: float = 12.0) -> list[int]:
    """All terms of ``sample(y, terms)`` whose chi-square against the label is ``least`` or more; as many as there are in the sample."""
    n, pos = sample.agg(F.count("y"), F.sum("y")).first()
    if not n or not pos or pos == n:
        return []
    expected = F.col("d") * pos / n
    chi = (F.col("p") - expected) ** 2 / expected + (F.col("d") - F.col("p") - F.col("d") * (n - pos) / n) ** 2 / (F.col("d") * (n - pos) / n)
    return _terms_of(_counts(sample).where((F.col("d") >= least_documents) & (chi >= least)))


def supported_terms(sample: DataFrame, least_documents: int, share: float) -> list[int]:
    """All terms that stand in ``share`` of the sample's documents of label 1, and in ``least_documents`` of these."""
    pos = sample.where("y = 1").count()
    return _terms_of(_counts(sample).where(F.col("p") >= max(least_documents, share * pos))) if pos else []


def _counts(sample: DataFrame) -> DataFrame:
    return sample.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("d"), F.sum("y").alias("p"))


def _terms_of(counted: DataFrame) -> list[int]:
    return sorted(counted.select("t").toArrow()["t"].to_pylist())


class Rows:
    """Sparse rows: the numbers of all, one row after the other, and the rows' lengths."""

    def __init__(self, flat, sizes) -> None:
        import numpy as np

        self.flat, self.sizes = np.asarray(flat, np.int64), np.asarray(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    @property
    def row(self):
        """The row of each number; made when it is asked for, as it is as large as the numbers."""
        import numpy as np

        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def places(self, which):
        """Of the rows ``which``: where their numbers lie, and the row (from 0) of each."""
        import numpy as np

        n = self.sizes[which]
        seg = np.repeat(np.arange(len(which)), n)
        return np.repeat(self.starts[which] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum()), seg

    def take(self, which) -> Rows:
        at, _ = self.places(which)
        return Rows(self.flat[at], self.sizes[which])

    def only(self, numbers, size: int) -> Rows:
        """The rows with the given numbers of 0 .. size - 1 alone, renumbered by their places in ``numbers``."""
        import numpy as np

        new = np.full(size, -1)
        new[numbers] = np.arange(len(numbers))
        kept = new[self.flat] >= 0
        return Rows(new[self.flat[kept]], np.bincount(self.row[kept], minlength=len(self)))
