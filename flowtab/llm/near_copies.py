"""Near copies by word shingles: MinHash bands for candidates, exact similarity, the smallest id stays.

Two texts are near copies if the Jaccard similarity of their sets of ``WIDTH``-word shingles is ``ALIKE`` or more. Candidates
share one of ``BANDS`` bands of ``ROWS`` minima; a pair at 0.8 is missed with a chance of 3 in a million, more alike ones with
less. Every candidate is held against the exact sets (of 64-bit hashes). In the order of ids, a text goes if it is a near copy
of one that stays; so no two that stay are near copies, and none goes for a chain of ever less similar ones.

A bucket of many near copies is not paired off: in rounds, every member is held against the first one only, and firsts that
no bucket puts behind another stay, their near copies go. Once few pairs are left, or rounds no longer help, small buckets are
paired off. The texts of crowded ones, which share a passage without being alike, are paired by the rarest of their shingles:
texts at ``ALIKE`` share one of the rarest fifth of each, so none is lost, and what all of a bucket share pairs nothing.

Edge cases. Words are told apart as in SimHash: cut at white space, ASCII letters small. Texts of fewer words than a shingle are
one shingle, so only equal ones are alike; null and empty texts are equal. Ties (one id with several texts) go by the text's
hash, null ids come last. Repeated rows are one. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, row_key, salted_left, stored, use_checkpoints
from .simhash import keep_first

WIDTH, ALIKE = 5, 0.8
BANDS, ROWS = 24, 4
#: Candidate pairs for each bucket entry up to which rounds end; buckets with more for each are crowded.
PAIRS = 4
#: Pairs with one text that meet in one place.
SHARE = 64
#: Holders of one shingle that are held against in one place.
HOLDERS = 256
#: Shingles hashed and mixed at a time.
_BLOCK = 1 << 12


def _words(text: str | None) -> list[bytes]:
    raw = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "").encode("utf-8", "surrogatepass")
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


def _hashes(words: list[bytes], width: int):
    """Sorted distinct XXH64 of the shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    each = (xxh64_intdigest(joined[i:j]) for i, j in zip(starts, ends[width - 1 :], strict=False))
    return np.unique(np.fromiter(each, np.uint64, len(words) - width + 1))


def shingles(text: str | None, width: int = WIDTH) -> list[int]:
    """Signed hashes of the distinct shingles."""
    return _hashes(_words(text), width).view("<i8").tolist()


def _names(raw: bytes) -> tuple[int, int]:
    """Two hashes of a text's words: its node, and what tells texts of one node apart."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(raw), xxh64_intdigest(raw, 1)


def _signer():
    """A function of a text: both hashes of its words, number of distinct shingles, hashes of its bands."""
    import numpy as np
    from xxhash import xxh64_intdigest

    draw = np.random.default_rng(7)
    times, plus = (draw.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * 2 + 1 for _ in range(2))

    def sign(text: str | None) -> tuple[int, int, int, list[int]]:
        words = _words(text)
        hashes = _hashes(words, WIDTH)
        node, check = (h - ((h >> 63) << 64) for h in _names(b" ".join(words)))
        if not len(hashes):
            return node, check, 0, []
        least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
        for at in range(0, len(hashes), _BLOCK):
            least = np.minimum(least, (hashes[at : at + _BLOCK] * times + plus).min(axis=1))
        bands = (xxh64_intdigest(m.tobytes(), k) for k, m in enumerate(least.reshape(BANDS, ROWS)))
        return node, check, len(hashes), [b - ((b >> 63) << 64) for b in bands]

    return sign


def _signed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row: ``doc_id, row_key, node, check, n, bands``."""
    source = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def make():
        sign = _signer()
        return lambda i, k, t: (i, k, *sign(t))

    schema = f"doc_id {source.schema['i'].dataType.simpleString()}, row_key binary, node bigint, check bigint, n int, bands array<bigint>"
    return per_row(source.select("i", "t", row_key(F.col("t")).alias("k")), ["i", "k", "t"], make, schema)


def _sets(df: DataFrame, id_col: str, text_col: str, nodes: DataFrame) -> DataFrame:
    """``node, set`` of the nodes' first texts."""
    texts = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), row_key(F.col(text_col)).alias("k"))
    wanted = nodes.select("node", F.col("rank.i").alias("wi"), F.col("rank.k").alias("wk"))
    met = texts.join(wanted, F.col("i").eqNullSafe(F.col("wi")) & (F.col("k") == F.col("wk")))
    found = per_row(met.select("node", "t"), ["node", "t"], lambda: lambda n, t: (n, shingles(t)), "node bigint, set array<bigint>")
    return found.groupBy("node").agg(F.first("set").alias("set"))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``x, xn, m, mn`` whose sets are alike. A text of many pairs is dealt out in copies."""
    pairs = pairs.where(F.least("xn", "mn") >= ALIKE * F.greatest("xn", "mn")).select("x", "m")
    counts = pairs.groupBy("m").agg(F.floor((F.count("*") - 1) / SHARE).alias("more"))
    dealt = salted_left(pairs, counts.where("more > 0").withColumnRenamed("m", "k"), "m", "k", F.xxhash64("x"))
    # Another seed than the salt's, so that the parts are independent of it.
    dealt = dealt.select("x", "m", F.pmod(F.xxhash64(F.lit(1), "x"), F.coalesce("more", F.lit(0)) + 1).alias("part"))
    copies = sets.join(counts, F.col("node") == F.col("m")).select(F.col("m").alias("cm"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("more"))).alias("cp"), F.col("set").alias("ms"))
    met = dealt.join(sets.select(F.col("node").alias("x"), F.col("set").alias("xs")), "x").join(copies, (F.col("m") == F.col("cm")) & (F.col("part") == F.col("cp")))
    both = F.size(F.array_intersect("xs", "ms"))
    return met.where(both >= ALIKE * (F.size("xs") + F.size("ms") - both)).select("x", "m")


def _decide(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs ``x, m`` whose ``m`` is one of ``firsts``."""
    return salted_left(pairs, firsts.select(F.col("m").alias("k")), "m", "k", F.xxhash64("x")).where("k is not null").drop("k")


def _gone(edges: DataFrame) -> DataFrame:
    return edges.groupBy("x").agg(F.min("m").alias("m")).checkpoint()


def _without(df: DataFrame, key: str, nodes: DataFrame, column: str) -> DataFrame:
    gone = nodes.select(F.col(column).alias("__ft_gone"))
    return df.join(gone, F.col(key) == F.col("__ft_gone"), "left_anti")


def _in_pairs(a: str, b: str) -> list:
    return [F.col(f"{a}.node").alias("x"), F.col(f"{a}.n").alias("xn"), F.col(f"{b}.node").alias("m"), F.col(f"{b}.n").alias("mn")]


def _by_rarest(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``x, xn, m, mn`` of ``nodes`` (``node, rank, n``) that may be alike, ``m`` before ``x``; every alike pair is among them.

    Shingles are ordered by the number of nodes that hold them. Alike sets have ``ALIKE`` of the larger in common, so each holds a
    common one among its first ``n - ALIKE * n + 1``. At the first common one, what follows it must suffice for the overlap.
    """
    held = stored(nodes.join(sets.withColumnRenamed("node", "__ft_node"), F.col("node") == F.col("__ft_node")).select("node", "rank", "n", F.explode("set").alias("h")), "held")
    shared = held.groupBy(F.col("h").alias("sh")).agg(F.count("*").alias("df")).where("df > 1")
    told = salted_left(held, shared, "h", "sh", F.xxhash64("node")).where("df is not null")
    # Shingles of one node alone come first and meet nothing, so only the shared ones are listed.
    lists = told.groupBy("node").agg(F.first("rank").alias("rank"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("held"))
    first = (F.size("held") + 1 - F.ceil(F.col("n") * ALIKE - 1e-9)).cast("int")
    rarest = lists.where(first > 0).select("node", "rank", "n", F.size("held").alias("size"), F.posexplode(F.slice("held", 1, first)).alias("pos", "at"))
    rarest = rarest.select("node", "rank", "n", F.col("at.h").alias("h"), (F.col("size") - F.col("pos") - 1).alias("rest"), F.floor((F.col("at.df") - 1) / HOLDERS).alias("more")).checkpoint()
    a = rarest.withColumn("part", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("more") + 1)).alias("a")
    b = rarest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("more")))).alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    may = (F.least(n, m) >= ALIKE * F.greatest(n, m)) & (1 + F.least("a.rest", "b.rest") >= ALIKE / (1 + ALIKE) * (n + m) - 1e-9)
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.rank") > F.col("b.rank")) & may)
    return met.select(*_in_pairs("a", "b"))


def _leaving(entries: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Tables ``x, m``: the nodes that go, and one that stays of which each is a near copy. ``entries``: ``band, node, rank, n``."""
    found, before = [], None
    while True:
        buckets = entries.groupBy("band").agg(F.count("*").alias("c"), F.min(F.struct("rank", "node", "n")).alias("first")).where("c > 1")
        buckets = buckets.select(F.col("band").alias("b"), "c", F.col("first.node").alias("m"), F.col("first.n").alias("mn")).checkpoint()
        members, pairs = buckets.agg(F.sum("c"), F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2)).first()
        if not members:
            return found
        if pairs <= PAIRS * members or (before is not None and pairs > before / 2):
            break
        before = pairs
        met = salted_left(entries, buckets, "band", "b", F.xxhash64("node")).where("node != m")
        behind = met.select(F.col("node").alias("x"), F.col("n").alias("xn"), "m", "mn").distinct().checkpoint()
        firsts = _without(buckets.select("m").distinct(), "m", behind.select("x").distinct(), "x").checkpoint()
        gone = _gone(_alike(_decide(behind, firsts), sets))
        found.append(gone)
        entries = _without(entries, "node", gone.select("x").union(firsts), "x").checkpoint()
    counted = salted_left(entries, buckets.select("b", "c"), "band", "b", F.xxhash64("node")).where("c is not null").checkpoint()
    few = counted.where(F.col("c") <= 2 * PAIRS + 1)
    a, b = few.alias("a"), few.alias("b")
    close = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.rank") > F.col("b.rank"))).select(*_in_pairs("a", "b"))
    crowded = counted.where(F.col("c") > 2 * PAIRS + 1).select("node", "rank", "n").distinct()
    every = close if crowded.isEmpty() else close.union(_by_rarest(crowded, sets))
    every = every.distinct()
    edges = _alike(every, sets).checkpoint()
    while not edges.isEmpty():
        firsts = _without(edges.select("m").distinct(), "m", edges.select("x").distinct(), "x")
        gone = _gone(_decide(edges, firsts))
        found.append(gone)
        edges = _without(_without(edges, "x", gone, "x"), "m", gone, "x").checkpoint()
    return found


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` in which texts of one node are the same 128 bits: those of a node that several have are known by their second hash
    instead, and meet no bands, so that they stay (but for their own copies)."""
    met = rows.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a < b").select(F.col("node").alias("shared")).checkpoint()
    if met.isEmpty():
        return rows
    told = rows.join(met, F.col("node") == F.col("shared"), "left")
    twice = F.col("shared").isNotNull()
    none = F.array().cast("array<bigint>")
    return told.select("doc_id", "row_key", F.when(twice, F.col("check")).otherwise(F.col("node")).alias("node"), "check", "n", F.when(twice, none).otherwise(F.col("bands")).alias("bands")).checkpoint()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, row_key, component_fp``, the last one naming the text that stays in its place."""
    use_checkpoints(df.sparkSession)
    rows = _told_apart(_signed(df, id_col, text_col).checkpoint())
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row_key").alias("k"))
    nodes = rows.groupBy("node").agg(F.min(rank).alias("rank"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    entries = nodes.select("node", "rank", "n", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select(F.col("band").alias("b"))
    entries = salted_left(entries, shared, "band", "b", F.xxhash64("node")).where("b is not null").drop("b").checkpoint()
    sets = stored(_sets(df, id_col, text_col, entries.select("node", "rank").distinct()), "shingles")
    tables, own = _leaving(entries, sets), rows.select("doc_id", "row_key", "node")
    if not tables:
        return own.withColumnRenamed("node", "component_fp")
    leaving = tables[0]
    for t in tables[1:]:
        leaving = leaving.union(t)
    met = salted_left(own, leaving, "node", "x", F.xxhash64("doc_id", "row_key"))
    return met.select("doc_id", "row_key", F.coalesce("m", "node").alias("component_fp"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies of others that stay; of repeated rows one stays. Columns stay as they are."""
    return keep_first(df, near_copies(df, id_col, text_col), id_col, text_col)
