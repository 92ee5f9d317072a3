"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A fingerprint is mapped to the bit counts of its two-bit segments, under two segmentations, the second one bit on (and round the
end of its half). A fingerprint's distance by Manhattan of either is never more than the Hamming distance. Of two fingerprints at Hamming distance
3 or less, one of the two halves (32 bits, 2 x 16 counts) is at Hamming distance 1 or less, and so at Manhattan distance 1 or less in each
segmentation; so the counts of each half are a grid, joined at radius one: a fingerprint is stored in its own cell and looks into that and into those
where one count of each segmentation, in segments that overlap, is one higher. One segmentation alone would have cells of middling
counts that fill up as the input grows; both together leave few fingerprints to a cell. Pairs that meet are held against the Manhattan
bound of the whole vector of counts and then the exact Hamming distance, in the join itself.

Edge cases. Null or empty texts and texts without words have the fingerprint zero and link like any other. Very long texts are
hashed in blocks. Null ids take part; the id of a component is its smallest id that is not null, so ties do not occur. Repeated rows
share a fingerprint. An empty table gives an empty result. Only the two named columns are read, others may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, columns_of, dealt_join, key_filter, may_hold, per_row, row_key, salted_left, use_checkpoints

_LOW = 0x5555555555555555
_HALF = 0xFFFFFFFF
MAX_BITS = 3
#: Shingles hashed and counted at a time, so that a text of any length needs bounded memory.
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash: bit set where over half of the shingles' XXH64 have it; 0 without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    raw = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "").encode("utf-8", "surrogatepass")
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        hashes = [xxh64_intdigest(joined[i:j], seed) for i, j in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, row_key, fp`` (signed 64-bit)."""
    source = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return per_row(
        source.select("i", "t", row_key(F.col("t")).alias("k")),
        ["i", "k", "t"],
        lambda: lambda i, k, t: (i, k, fingerprint(t)),
        f"doc_id {source.schema['i'].dataType.simpleString()}, row_key binary, fp bigint",
    )


def embedding(fp: Column) -> Column:
    """Segment bit counts in unary code: the two bits of each segment, sorted."""
    up = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(up).bitwiseAND(F.lit(_LOW))
    both = fp.bitwiseAND(up).bitwiseAND(F.lit(_LOW))
    return either.bitwiseOR(F.shiftleft(both, 1))


def counts(half: Column) -> Column:
    """Bit counts (0 to 2) of a half's two-bit segments, two bits for each count."""
    return half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(_LOW & _HALF))


def _cell(which: Column, even: Column, odd: Column) -> Column:
    """A cell's name: which half, and its counts in both segmentations. Cells of one name by chance add candidates, and no links."""
    return F.xxhash64(which, even, odd)


def _cells(which: Column, half: Column, radius: bool) -> Column:
    """The cell of a half, or, with ``radius``, that and the cells where a count of each segmentation is one higher."""
    turned = F.shiftrightunsigned(half, 1).bitwiseOR(F.shiftleft(half.bitwiseAND(F.lit(1)), 31))
    grid = F.struct(half.alias("bits"), counts(half).alias("even"), counts(turned).alias("odd"))
    if not radius:
        return F.transform(F.array(grid), lambda g: _cell(which, g["even"], g["odd"]))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)

    def raised(g: Column, i: Column) -> Column:
        """Bit i is in one segment of each segmentation; where it is set already no neighbour is one higher by it."""
        place = lambda at: one(F.floor(at / 2).cast("int") * 2)
        return F.when(g["bits"].bitwiseAND(one(i)) == 0, _cell(which, g["even"] + place(i), g["odd"] + place(F.pmod(i - 1, F.lit(32)))))

    return F.flatten(F.transform(F.array(grid), lambda g: F.array_compact(F.concat(F.array(_cell(which, g["even"], g["odd"])), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: raised(g, i))))))


def candidates(prints: DataFrame) -> tuple[DataFrame, DataFrame, tuple[Column, Column]]:
    """Both sides of the grid join of distinct ``fp``: ``x``, each in its own cells, and ``y``, each in those it looks into; and what makes a pair a
    candidate (the cell), and a link (the bounds by counts and by bits)."""
    half = lambda k: F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(_HALF))
    side = lambda radius: prints.select("fp", embedding(F.col("fp")).alias("e"), F.explode(F.concat(*(_cells(F.lit(k), half(k), radius) for k in (0, 1)))).alias("cell"))
    near = F.bit_count(F.col("x.e").bitwiseXOR(F.col("y.e"))) <= MAX_BITS
    exact = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS
    met = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") != F.col("y.fp"))
    return side(False).alias("x"), side(True).alias("y"), (met, near & exact)


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``a, b`` (a < b) of distinct fingerprints at ``MAX_BITS`` or fewer bits. ``prints``: distinct ``fp``."""
    x, y, (met, bounds) = candidates(prints)
    found = x.join(y, met & bounds)
    return found.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``a, b``: one row ``node, root`` per node, root its smallest node.

    Rounds of large-star and small-star, each a partially aggregated minimum joined back to the edges, until
    the edges no longer change; every round is checkpointed. The edges of a hub are dealt to ``SALTS`` tasks.
    """
    use_checkpoints(edges.sparkSession)

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Link neighbours to the smallest node near: the larger ones, or the smaller ones and the node."""
        ordered = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        both = ordered.union(ordered.select("b", "a")) if large else ordered
        dealt = both.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("s"))
        # The minimum of a node goes to the salts that it has, of which a node of few neighbours has few.
        parts = dealt.groupBy("a", "s").agg(F.min("b").alias("m"))
        least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("s").alias("ss")).select("a", F.least("a", "m").alias("m"), "ss")
        near = dealt.join(least.select("a", "m", F.explode("ss").alias("s")), ["a", "s"])
        if large:
            out = near.where("b > a").select("b", "m")
        else:
            out = near.select("b", "m").union(least.select("a", "m"))
        return out.toDF("a", "b").where("a != b").distinct()

    now, before = edges.select("a", "b").distinct().checkpoint(), None
    while True:
        now = star(star(now, True), False).checkpoint()
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, row_key, fp, component_fp, component_id``.

    ``component_fp`` names the component by one of its fingerprints; ``component_id`` is its smallest id.
    """
    use_checkpoints(df.sparkSession)
    docs = fingerprints(df, id_col, text_col).checkpoint()
    least = docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).checkpoint()
    groups = components(links(least.select("fp")))
    joined = groups.join(least, groups.node == least.fp)
    roots = joined.groupBy("root").agg(F.min("least").alias("id"))
    linked = salted_left(joined.select("fp", "root"), roots.withColumnRenamed("root", "r"), "root", "r", F.xxhash64("fp")).select("fp", "root", "id")
    # Only fingerprints that are linked or met more than once tell a row anything; a hot one is dealt to many tasks.
    shared = (
        least.join(linked, "fp", "left")
        .where("root is not null or n > 1")
        .select(F.col("fp").alias("k"), F.coalesce("root", "fp").alias("component_fp"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("id")).alias("id"))
    )
    met = dealt_join(docs, shared, "fp", "k", F.xxhash64("doc_id", "row_key"))  # copies for hot fingerprints alone
    alone = F.col("k").isNull()
    return met.select("doc_id", "row_key", "fp", F.coalesce("component_fp", "fp").alias("component_fp"), F.when(alone, F.col("doc_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest id stays.

    Ties (one id with several texts) go by the text's hash, null ids come last, and of repeated rows one
    stays. Columns stay as they are. Ids and hashes alone meet in the joins before the last one, to which only those texts move
    that a filter of bounded size does not clear.
    """
    return keep_first(df, near_duplicates(df, id_col, text_col).select("doc_id", "row_key", "component_fp"), id_col, text_col)


def keep_first(df: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of each component. ``marked``: one row ``doc_id, row_key, component_fp`` per row of ``df``."""
    marked = marked.checkpoint()
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row_key").alias("k"))
    rows = marked.groupBy("doc_id", "row_key", "component_fp").agg(F.count("*").alias("n"))
    # A row alone in its component stays, so only the components of more rows are looked at.
    winners = marked.groupBy("component_fp").agg(F.min(rank).alias("w"), F.count("*").alias("rows")).where(F.col("rows") > 1).select(F.col("component_fp").alias("k"), "w")
    verdicts = (
        salted_left(rows, winners, "component_fp", "k", F.xxhash64("doc_id", "row_key"))
        .where("k is not null")
        .select("doc_id", "row_key", "n", (F.col("doc_id").eqNullSafe(F.col("w.i")) & (F.col("row_key") == F.col("w.k"))).alias("wins"))
        .where("not wins or n > 1")
        .select(F.col("doc_id").alias("__ft_id"), F.col("row_key").alias("__ft_key"), F.col("wins").alias("__ft_wins"))
        .checkpoint()
    )
    keyed = df.withColumn("__ft_row", row_key(F.col(text_col)))
    # Texts without a verdict need not move; where those with one are too many for a filter, all move.
    known = key_filter(verdicts.select(F.xxhash64("__ft_id", "__ft_key").alias("k")), "k")
    hit = F.lit(True) if known is None else may_hold(known, F.xxhash64(id_col, "__ft_row"))
    met = keyed.where(hit).join(verdicts, F.col(id_col).eqNullSafe(F.col("__ft_id")) & (F.col("__ft_row") == F.col("__ft_key")), "left")
    single = met.where("__ft_wins is null").select(*columns_of(df))
    if known is not None:
        single = keyed.where(~hit).select(*columns_of(df)).union(single)
    # Of repeated rows the one with the smallest hash, found by tasks before the shuffle: however many there are, few meet.
    order = F.xxhash64(*(c for c, (_, t) in zip(columns_of(df), df.dtypes, strict=True) if "map<" not in t and "variant" not in t))
    rows = met.where("__ft_wins").select("__ft_id", "__ft_key", order.alias("__ft_order"), F.struct(*columns_of(df)).alias("__ft_row"))
    repeated = rows.groupBy("__ft_id", "__ft_key").agg(F.min_by("__ft_row", "__ft_order").alias("r"))
    return single.union(repeated.select(*(F.col("r")[c].alias(c) for c in df.columns)))
