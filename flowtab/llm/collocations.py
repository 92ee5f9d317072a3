"""Phrase collocations by SETM: relations of occurrences, merge-joined by piece and adjacent position.

Texts are split into pieces and words. The first relation holds the occurrences ``(doc, piece, pos, g)`` of the frequent words of
each language, ``g`` being the word's number. A longer phrase is a pair of neighbours: an occurrence of ``k`` words at ``pos`` and one at
``pos + 1`` make one of ``k + 1`` words. So each round merge-joins the relation with itself by piece and adjacent position, counts the groups of
equal words, and keeps the occurrences of those that are frequent (a semi-join) as the next relation. A phrase is told by the numbers of its
words, two or three of them packed in one ``bigint`` (``g, g1, ...``), so no occurrence is looked up to be named, and none moves.
Parts of a frequent phrase are frequent, so nothing is lost.

Relations are written as tables bucketed by document and sorted by ``doc, piece, pos``: texts move once, before they are split, and
every merge-join finds its sides in place and in order. All occurrences of a piece come from one row of the input, so a hot
word or phrase never gathers in a task: groups are counted within tasks before they are shuffled. The frequent ones are sent to all tasks where they
are fewer than ``MOST_SENT`` (counted first), beyond that a Bloom filter of them is, and beyond its 16 MB nothing: occurrences that are kept
too many make groups that are counted exactly in the next round, and found to be too few there. Words are sent by a 64-bit hash,
seeded so that no two words of the tables share it; beyond ``WORDS_SENT`` times as many they meet their occurrences by a join with dealt keys.
On disk are two relations at a time at most, in a database of their own in the shared folder, and one step's shuffles.

Edge cases. A null text has no words; a null language is ``und``. Texts and pieces of any length are split by one task, line by
line of the relation. Repeated rows count as often as they stand there. Ties of the lowest score of a phrase's cuts go to the shortest first
part. An empty table gives an empty result. Only the named columns are read, so others may have any name; ids are not used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import global_index
from .common import key_filter, may_hold, salted_left, shared_path, stored

#: Occurrences from which on a phrase is frequent, the longest phrase in words, and the phrases of each language that are returned.
LEAST, LONGEST, FIRST = 100, 5, 2000
#: Frequent groups that are sent to all tasks, and times as many spellings of words; beyond the one a filter is sent, beyond the other they are joined by a shuffle.
MOST_SENT, WORDS_SENT = 500_000, 4
#: Words of one bucket, and the fewest and most buckets.
BUCKET_WORDS, LEAST_BUCKETS, MOST_BUCKETS = 3_000_000, 8, 100_000
_PLACE = ["doc", "piece", "pos"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextmanager
def _ordered_buckets(spark: SparkSession) -> Iterator[None]:
    """Let a scan of a bucket's one file tell its order, buckets by document serve joins by document, piece and place, and shuffles go with their step."""
    wanted = {
        "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def _database(spark: SparkSession) -> Iterator[str]:
    """A database in the shared folder, which goes with its tables' files."""
    name = f"flowtab_{uuid.uuid4().hex}"
    path = shared_path(spark, "relations").replace("'", "\\'")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def _relation(df: DataFrame, buckets: int, name: str | None = None) -> DataFrame:
    """Write a relation, bucketed and sorted: as table ``name``, or else in a file of the shared folder that stays."""
    spark, out = df.sparkSession, df.write.format("parquet").bucketBy(buckets, "doc").sortBy(*_PLACE)
    if name is None:
        name, out = f"flowtab_{uuid.uuid4().hex}", out.option("path", shared_path(spark, "relation"))
    out.saveAsTable(name)
    return spark.table(name)


def _pieces(text: Column) -> Column:
    return F.split(text, "[.,;:!?\\x0A-\\x0D]", -1)


def _words(piece: Column) -> Column:
    return F.split(piece, "[\\x20\\x09]+", -1)


def _seed(raw: DataFrame) -> int:
    """The first seed by which no two of the words ``lang, raw`` have one hash."""
    return next(seed for seed in count() if raw.groupBy(_hash(seed).alias("h")).agg(F.count("*").alias("n")).where("n > 1").isEmpty())


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang", "raw")


def _with_number(rows: DataFrame, spelt: DataFrame, seed: int, sent: bool, buckets: int) -> DataFrame:
    """Rows ``lang, raw`` of the numbered words, with ``g``, and places."""
    if sent:
        return rows.withColumn("h", _hash(seed)).join(F.broadcast(spelt.select(_hash(seed).alias("h"), "g")), "h")
    left = rows.withColumn("__ft_key", F.struct("lang", "raw"))
    right = spelt.select(F.struct("lang", "raw").alias("__ft_group"), "g")
    met = salted_left(left, right, "__ft_key", "__ft_group", F.xxhash64(*_PLACE)).where("g is not null")
    return met.select(*_PLACE, "g").repartition(buckets, "doc")


def _adjacent(relation: DataFrame) -> DataFrame:
    """Neighbours of a relation: its columns, and ``next``, the last of the second one's numbers."""
    ids = [c for c in relation.columns if c not in _PLACE]
    x = relation.select(*_PLACE, *ids)
    y = relation.select("doc", "piece", (F.col("pos") - 1).alias("pos"), F.col(ids[-1]).alias("next"))
    return x.hint("merge").join(y, _PLACE)


class _Packed:
    """Phrases as words' numbers, as many to a ``bigint`` as go in: the first ones in ``g``, its lowest bits first, the next in ``g1``."""

    def __init__(self, words: int) -> None:
        self.bits = 21 if words <= 1 << 21 else 31
        self.each = 63 // self.bits

    def ids(self, k: int) -> list[str]:
        """The columns of phrases of ``k`` words."""
        return ["g", *(f"g{i}" for i in range(1, -(-k // self.each)))]

    def longer(self, pairs: DataFrame, k: int) -> DataFrame:
        """Places and columns of ``k + 1`` words, of neighbours of ``k``."""
        ids, at = self.ids(k), k % self.each * self.bits
        last = F.shiftrightunsigned("next", (k - 1) % self.each * self.bits)
        if not at:
            return pairs.select(*_PLACE, *ids, last.alias(self.ids(k + 1)[-1]))
        return pairs.select(*_PLACE, *ids[:-1], F.col(ids[-1]).bitwiseOR(F.shiftleft(last, at)).alias(ids[-1]))

    def parted(self, groups: DataFrame, k: int) -> DataFrame:
        """``groups`` of ``k + 1`` words, with the columns of the first ``k`` as ``a0, ...`` and the last one's number as ``b``."""
        ids, at = self.ids(k), k % self.each * self.bits
        if not at:
            return groups.select("*", *(F.col(c).alias(f"a{i}") for i, c in enumerate(ids)), F.col(self.ids(k + 1)[-1]).alias("b"))
        first = [F.col(c) for c in ids[:-1]] + [F.col(ids[-1]).bitwiseAND(F.lit((1 << at) - 1))]
        return groups.select("*", *(c.alias(f"a{i}") for i, c in enumerate(first)), F.shiftrightunsigned(ids[-1], at).alias("b"))


def _frequent(rows: DataFrame, groups: DataFrame, ids: list[str], sent: bool) -> DataFrame:
    """Rows of the groups; where these are not sent, of some others too."""
    if sent:
        return rows.join(F.broadcast(groups.select(*ids)), ids, "left_semi")
    found = key_filter(groups.select(F.xxhash64(*ids).alias("key")), "key", places=1)
    return rows if found is None else rows.where(may_hold(found, F.xxhash64(*ids), places=1))


def frequent_phrases(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, most_sent: int = MOST_SENT) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases ``lang, words array<string>, f`` of 1 to ``longest`` words, and ``lang, n``, the words of each language."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    # Words are lower-cased once each, not in every text.
    raw = docs.select("lang", F.explode(_pieces(F.col("text"))).alias("piece")).select("lang", F.explode(_words(F.col("piece"))).alias("raw")).where("raw != ''")
    raw = stored(raw.groupBy("lang", "raw").agg(F.count("*").alias("f")), "words")
    totals = raw.groupBy("lang").agg(F.sum("f").alias("n"))
    word = F.translate("raw", _UPPER, _LOWER)
    words = raw.groupBy("lang", word.alias("word")).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    words = stored(global_index(words, ["lang", "word"], "g"), "groups")
    spelt = stored(raw.withColumn("word", word).join(words.select("lang", "word", "g"), ["lang", "word"]).select("lang", "raw", "g"), "spelt")
    packed, sent = _Packed(words.count()), spelt.count() <= WORDS_SENT * most_sent
    n = raw.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-n // BUCKET_WORDS)))

    moved = docs.where("text is not null").withColumn("doc", F.monotonically_increasing_id())
    moved = moved.repartition(buckets, "doc") if sent else moved
    split = moved.select("doc", "lang", F.posexplode(_pieces(F.col("text"))).alias("piece", "words")).where("words != ''")
    # Empty words are left by white space at a piece's begin and end alone, so places of words stay adjacent.
    split = split.select("doc", "lang", "piece", F.posexplode(_words(F.col("words"))).alias("pos", "raw")).where("raw != ''")
    phrases = words.select("lang", "g", F.array("word").alias("words"), "f")
    found = phrases.select("lang", "words", "f")
    with _ordered_buckets(spark), _database(spark) as base:
        relation = _relation(_with_number(split, spelt, _seed(raw) if sent else 0, sent, buckets).select(*_PLACE, "g"), buckets, f"{base}.r1")
        for k in range(1, longest):
            ids = packed.ids(k + 1)
            longer = packed.longer(_adjacent(relation), k)
            groups = stored(longer.groupBy(*ids).agg(F.count("*").alias("f")).where(F.col("f") >= least), "groups")
            first = phrases.select(*(F.col(c).alias(f"a{i}") for i, c in enumerate(packed.ids(k))), "lang", "words")
            last = words.select(F.col("g").alias("b"), F.col("word").alias("last"))
            met = packed.parted(groups, k).join(first, [f"a{i}" for i in range(len(packed.ids(k)))]).join(last, "b")
            phrases = stored(met.select("lang", *ids, F.concat("words", F.array("last")).alias("words"), "f"), "phrases")
            found = found.union(phrases.select("lang", "words", "f"))
            size = groups.count()
            if not size or k == longest - 1:
                break
            relation = _relation(_frequent(longer, groups, ids, size <= most_sent), buckets, f"{base}.r{k + 1}")
            spark.sql(f"DROP TABLE {base}.r{k}")
    return found, totals


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, first: int = FIRST, most_sent: int = MOST_SENT
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first phrases of each language, by the score of their weakest cut.

    A phrase inside a longer one that is as frequent is left out.
    """
    found, totals = frequent_phrases(df, lang_col, text_col, least, longest, most_sent)
    found = found.withColumn("k", F.size("words"))
    candidates = found.where("k > 1").withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "words", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("cut")).alias("left"), F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = lambda name, f: found.select("lang", F.col("words").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", F.lit(1000) * exact("a") * exact("n"), exact("l") * exact("r"))
    weakest = cuts.withColumn("score", score).groupBy("lang", "words").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"), F.first("a").alias("a"), F.first("n").alias("n"))
    # Phrases inside longer ones: of each candidate all its parts of two or more words, with its count. As frequent means just as frequent.
    inner = candidates.where("k > 2").select("lang", "k", "words", F.col("a").alias("f"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "words", "f", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", F.slice("words", F.col("at"), F.col("size")).alias("words"), F.col("f").alias("a")).distinct()
    left = weakest.join(inner, ["lang", "words", "a"], "left_anti").select("lang", F.array_join("words", " ").alias("phrase"), "a", "m.l", "m.r", "n", "m.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, '{_UPPER}', '{_LOWER}') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
t AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY lang),
f AS (SELECT lang, w[i : i + k - 1] AS words, k, count(*) AS f FROM o, range(1, {LONGEST + 1}) AS s(k) WHERE i + k - 1 <= len(w)
      GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, words, k, f AS a FROM f WHERE k > 1),
e AS (SELECT c.lang, c.words, c.a, x.f AS l, y.f AS r, t.n, cut,
             CAST((1000 * CAST(c.a AS HUGEINT) * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM c, UNNEST(range(1, c.k)) AS u(cut) JOIN f x ON x.lang = c.lang AND x.words = c.words[1 : cut]
           JOIN f y ON y.lang = c.lang AND y.words = c.words[cut + 1 : c.k] JOIN t ON t.lang = c.lang),
m AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
q AS (SELECT DISTINCT lang, words[i : j] AS words, a AS longer FROM c, UNNEST(range(1, k)) AS u(i), UNNEST(range(2, k + 1)) AS v(j)
      WHERE j > i AND j - i + 1 < k),
b AS (SELECT m.*, array_to_string(words, ' ') AS phrase FROM m
      WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.lang = m.lang AND q.words = m.words AND 100 * q.longer >= 100 * m.a))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= {FIRST}
"""
