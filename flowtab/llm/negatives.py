"""Hard-negative mining by Strassen products of integer tiles, with heaps of positives and of windows that merge.

Vectors become integers, ``floor(scale * x)``, and are packed into tiles of up to ``TILE`` rows: anchors by a hash of the row within
their cell, all candidates as they stand in their partition. A cell is a hash of the label. An anchor tile and its candidate tiles meet by a
shuffle on the anchor tile's number and a deal of ``DEAL`` candidate tiles, sorted so that the anchors come first; a task
multiplies each pair of tiles, padded by zeros to even sides, by Strassen's seven products on int64, down to sides of ``LEAF``. Additions of
int64 are exact modulo 2^64, so a result that fits is exact whatever the steps between do.

In a first pass candidate tiles go to the anchor tiles of their own cell, and each anchor keeps a heap of its best candidates of the same label: its
positives. In a second pass they go to all anchor tiles, with a heap for each positive: the best of other labels in the window of scores
under it. Heaps of different tasks hold few rows each; they are merged by rank.

The work is anchors x candidates, in blocks, and nothing but counts of anchors for each of at most ``CELLS`` cells reaches the driver.

Edge cases. Rows with a null label, a null vector or a component that is null or no finite number take no part. A null id is no anchor and
comes last among ties. Rows with an anchor's id are that anchor, never its partner; repeated anchors count once, repeated candidates
each take a place, as a repeated positive has a window of its own. Vectors of different lengths are padded by zeros; an empty one scores 0. Where
a product might not fit a long, it is an error. An anchor without positives, and a positive without negatives, have no rows; a window below zero is
empty. An empty table gives an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stored

#: Rows of a tile, the side down to which products are divided, cells of labels, and candidate tiles that one task meets at most, about.
TILE, LEAF, CELLS, DEAL = 512, 16, 64, 256
_NONE = -(1 << 63)


def strassen(a, b):
    """Exact product of two int64 matrices (modulo 2^64)."""
    import numpy as np

    def product(a, b):
        (m, k), n = a.shape, b.shape[1]
        if min(m, k, n) <= LEAF:
            return a @ b
        i, j, l = m // 2, n // 2, k // 2
        top, low, left, right = np.s_[:i], np.s_[i:], np.s_[:l], np.s_[l:]
        a11, a12, a21, a22 = a[top, left], a[top, right], a[low, left], a[low, right]
        b11, b12, b21, b22 = b[:l, :j], b[:l, j:], b[l:, :j], b[l:, j:]
        both, lower, upper_diff = product(a11 + a22, b11 + b22), product(a21 + a22, b11), product(a11, b12 - b22)
        lower_diff, upper = product(a22, b21 - b11), product(a11 + a12, b22)
        c = np.empty((m, n), np.int64)
        c[:i, :j] = both + lower_diff - upper + product(a12 - a22, b21 + b22)
        c[:i, j:] = upper_diff + upper
        c[i:, :j] = lower + lower_diff
        c[i:, j:] = both - lower + upper_diff + product(a21 - a11, b11 + b12)
        return c

    sides, smallest, unit = (*a.shape, b.shape[1]), min(*a.shape, b.shape[1]), 1
    while -(-smallest // unit) > LEAF:  # rounded up, as the padded side is what is halved
        unit *= 2  # each halving needs even sides
    m, k, n = (-(-side // unit) * unit for side in sides)
    padded = lambda x, rows, cols: np.pad(x, ((0, rows - x.shape[0]), (0, cols - x.shape[1])))
    return product(padded(a, m, k), padded(b, k, n))[: sides[0], : sides[2]]


class Heaps:
    """The best ``size`` entries of each of ``n`` rows: higher scores first, then smaller ids, null ids last."""

    def __init__(self, n: int, size: int) -> None:
        import numpy as np

        self.n, self.size = n, size
        self.least = np.full(n, _NONE, np.int64)  # a full heap's last score: what is below it is not looked at
        self.entries = tuple(np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def push(self, rows, scores, nulls, ids) -> None:
        import numpy as np

        row, score, null, i = (np.concatenate(pair) for pair in zip(self.entries, (rows, scores, nulls, ids), strict=True))
        order = np.lexsort((i, null, -score, row))
        row, score, null, i = row[order], score[order], null[order], i[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.size
        last = place == self.size - 1
        self.least[row[last]] = score[last]
        self.entries = row[kept], score[kept], null[kept], i[kept]

    def push_where(self, first: int, scores, allowed, nulls, ids) -> None:
        """Push what is allowed of a matrix of scores: its rows are this one's from ``first`` on, its columns have ``ids``."""
        import numpy as np

        least = self.least[first : first + len(scores)]
        allowed = allowed & (scores >= least[:, None])
        if allowed.sum() > 4 * self.size * len(scores) and scores.shape[1] > self.size:
            # Many at once: what is below a row's own best few cannot stay.
            own = np.partition(np.where(allowed, scores, _NONE), -self.size, axis=1)[:, -self.size]
            allowed &= scores >= own[:, None]
        r, c = np.nonzero(allowed)
        if len(r):
            self.push(r + first, scores[r, c], nulls[c], ids[c])


_TILE = "a bigint, deal int, part int, width int, size int, ids binary, nulls binary, labels binary, vectors binary, keys binary, windows binary"


def _packed(rows: list[tuple]) -> dict:
    """One tile of ``(id, label, vector[, key, windows])``; vectors in the smallest integers that hold them."""
    import numpy as np

    width = max(len(r[2]) for r in rows)
    flat = np.zeros((len(rows), width), np.int64)
    for at, r in enumerate(rows):
        flat[at, : len(r[2])] = r[2]
    most = int(max(flat.max(initial=0), -int(flat.min(initial=0)) - 1))
    kind = next(k for k in ("<i2", "<i4", "<i8") if most < 1 << (8 * int(k[2]) - 1))
    longs = lambda values: np.array(list(values), "<i8").tobytes()
    return {
        "width": width, "size": int(kind[2]), "ids": longs(r[0] or 0 for r in rows), "nulls": bytes(r[0] is None for r in rows), "labels": longs(r[1] for r in rows),
        "vectors": flat.astype(kind).tobytes(), "keys": longs(r[3] for r in rows) if len(rows[0]) > 3 else None,
        "windows": longs(x for r in rows for x in r[4]) if len(rows[0]) > 4 else None,
    }


class _Tile:
    def __init__(self, width: int, size: int, ids: bytes, nulls: bytes, labels: bytes, vectors: bytes, keys: bytes | None, windows: bytes | None) -> None:
        import numpy as np

        self.ids, self.nulls, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(nulls, bool), np.frombuffer(labels, "<i8")
        self.vectors = np.frombuffer(vectors, f"<i{size}").reshape(len(self.ids), width).astype(np.int64)
        self.most = max(int(self.vectors.max(initial=0)), -int(self.vectors.min(initial=0)))
        self.keys = None if keys is None else np.frombuffer(keys, "<i8")
        self.windows = None if windows is None else np.frombuffer(windows, "<i8").reshape(len(self.ids), -1, 2)

    def one_label(self) -> int | None:
        return int(self.labels[0]) if (self.labels == self.labels[0]).all() else None

    def scores(self, other: _Tile):
        import numpy as np

        width = max(self.vectors.shape[1], other.vectors.shape[1])
        if width * self.most * other.most >= 1 << 62:
            raise ValueError("a score would not fit a long: the components are too large")
        wide = lambda t: np.pad(t.vectors, ((0, 0), (0, width - t.vectors.shape[1])))
        return strassen(wide(self), wide(other).T)


def _pack(df: DataFrame, tile: int, sort: bool) -> DataFrame:
    """Tiles of ``a, i, label, vector[, key, windows]``, one ``a`` in each; sorted ones are cut where ``a`` changes alone."""
    spark = df.sparkSession
    bound_batches(spark)
    target = spark.createDataFrame([], _TILE).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, open_tiles, n, now = to_arrow_schema(target), {}, 0, None

        def closed(a: int) -> pa.RecordBatch:
            nonlocal n
            n += 1
            return pa.RecordBatch.from_pylist([{"a": a, "deal": 0, "part": n} | _packed(open_tiles.pop(a))], schema=schema)

        for batch in batches:
            for a, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sort and a != now:
                    if now is not None:
                        yield closed(now)
                    now = a
                rows = open_tiles.setdefault(a, [])
                rows.append(tuple(row))
                if not sort and len(rows) == tile:
                    yield closed(a)
        for a in list(open_tiles):
            yield closed(a)

    return df.mapInArrow(run, target)


def _meet(anchors: DataFrame, candidates: DataFrame, kept: int, same: bool) -> DataFrame:
    """Heaps of anchors over candidate tiles, sorted by anchor tile and with it first: rows ``key, slot, score, id``.

    ``same``: one heap for each anchor, of candidates of its label; else one for each of its windows, of other labels.
    """
    spark = anchors.sparkSession
    target = spark.createDataFrame([], "key bigint, slot int, score bigint, id bigint").schema
    met = anchors.unionByName(candidates).repartition("a", "deal").sortWithinPartitions("a", "deal", F.col("keys").isNull())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, tile, heaps, slots = to_arrow_schema(target), None, None, 1

        def finished() -> Iterator[pa.RecordBatch]:
            if tile is not None and len(heaps.entries[0]):
                row, score, null, i = heaps.entries
                slot, at = np.divmod(row, len(tile.ids))
                yield pa.RecordBatch.from_arrays([pa.array(tile.keys[at]), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(i, mask=null)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                other = _Tile(*(row[c] for c in ("width", "size", "ids", "nulls", "labels", "vectors", "keys", "windows")))
                if other.keys is not None:
                    yield from finished()
                    tile, slots = other, 1 if same else other.windows.shape[1]
                    heaps = Heaps(len(tile.ids) * slots, kept)
                    continue
                if not same and tile.one_label() is not None and tile.one_label() == other.one_label():
                    continue  # no candidate has another label
                scores = tile.scores(other)
                allowed = (tile.labels[:, None] == other.labels) == same
                if same:
                    heaps.push_where(0, scores, allowed & ((tile.ids[:, None] != other.ids) | other.nulls), other.nulls, other.ids)
                else:
                    for slot in range(slots):
                        low, high = tile.windows[:, slot, 0, None], tile.windows[:, slot, 1, None]
                        heaps.push_where(slot * len(tile.ids), scores, allowed & (scores >= low) & (scores <= high), other.nulls, other.ids)
        yield from finished()

    return met.mapInArrow(run, target)


def _best(found: DataFrame, kept: int) -> DataFrame:
    """Merge the heaps of all tasks: the first ``kept`` entries of each, with their ``rank``."""
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, tile: int = TILE
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive.

    Negatives score from ``low`` to ``high`` per cent of the positive. ``label_col`` holds integers.
    """
    x = F.col(vector_col)
    usable = F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.where(usable).select(
        F.col(id_col).cast("bigint").alias("i"), F.col(label_col).cast("bigint").alias("label"), F.transform(x, lambda v: F.floor(scale * v.cast("double"))).alias("vector"), is_anchor.alias("is_anchor")
    )
    rows = rows.withColumn("cell", F.pmod(F.hash("label"), F.lit(CELLS)).cast("bigint"))
    # All that later passes read again is written: tiles and numbers stay what they are, whoever is lost.
    candidates = stored(_pack(rows.select(F.col("cell").alias("a"), "i", "label", "vector"), tile, False), "candidates")
    anchors = rows.where("is_anchor").select("i", "label", "vector", "cell").distinct().withColumn("key", F.monotonically_increasing_id())
    anchors = stored(anchors, "anchors")
    counts = {r["cell"]: r["n"] for r in anchors.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    tiles, first, total = {}, {}, 0
    for cell in range(CELLS):
        tiles[cell], first[cell] = -(-counts.get(cell, 0) // tile), total
        total += tiles[cell]
    of = lambda numbers: F.element_at(F.array(*(F.lit(numbers[c]).cast("bigint") for c in range(CELLS))), (F.col("cell") + 1).cast("int"))
    anchors = anchors.withColumn("a", of(first) + F.pmod(F.xxhash64("key"), F.greatest(of(tiles), F.lit(1))))

    n = candidates.count()
    spread = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(tiles_met: int) -> int:
        """Deals of the candidates of an anchor tile: few enough tiles for a task, and work for all."""
        return max(1, -(-n // DEAL), min(n, -(-spread // max(1, tiles_met))))

    def anchor_tiles(rows: DataFrame, deals: int) -> DataFrame:
        return _pack(rows.repartition("a").sortWithinPartitions("a"), tile, True).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))

    def candidate_tiles(deals: int, begin: Column, end: Column) -> DataFrame:
        own = candidates.withColumn("deal", F.pmod(F.xxhash64("ids", "part"), F.lit(deals)).cast("int")).withColumn("cell", F.col("a"))
        return own.where(end > begin).withColumn("a", F.explode(F.sequence(begin, end - 1))).drop("cell")

    deals = dealt(len(counts))
    own = anchor_tiles(anchors.select("a", "i", "label", "vector", "key"), deals)
    found = _best(_meet(own, candidate_tiles(deals, of(first), of(first) + of(tiles)), positives, True), positives)
    chosen = stored(found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("chosen")), "positives")

    # low * score / 100 rounded up and high * score / 100 rounded down, without a product that could pass a long.
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    bottom = lambda v: low * div(v, 100) + div(low * (v % 100) + 99, 100)
    top = lambda v: high * div(v, 100) + div(high * (v % 100), 100)
    score = lambda k: F.get(F.col("chosen"), k)["score"]
    window = [F.when(score(k) >= 0, value(score(k))).otherwise(edge) for k in range(positives) for value, edge in ((bottom, F.lit(1)), (top, F.lit(0)))]
    windows = anchors.join(chosen, "key").select("a", "i", "label", "vector", "key", F.array(*(w.cast("bigint") for w in window)).alias("windows"))
    deals = dealt(total)
    found = _best(_meet(anchor_tiles(windows, deals), candidate_tiles(deals, F.lit(0).cast("bigint"), F.lit(total).cast("bigint")), negatives, False), negatives)
    pairs = anchors.join(chosen, "key").select("key", F.col("i").alias("anchor_id"), F.posexplode("chosen").alias("slot", "positive"))
    return pairs.join(found.withColumnRenamed("score", "negative_score"), ["key", "slot"]).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), "negative_score"
    )


def digest(df: DataFrame) -> DataFrame:
    """Anchors are the rows whose ``vec_id`` is divisible by 100; a ``vec_id`` divisible by 7 first gets the next label of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = df.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
      FROM v a, v c WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
