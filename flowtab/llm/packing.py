"""Packing token streams into sequences by an order-preserving dynamic program.

The documents of a partition form one stream in their order. A window (sequence) ends at a document's end,
at a sentence's end, or, in stretches without either, at fixed steps; of all cuts the program takes those
with the least padding plus truncation penalties. A window of length L costs ``capacity - L`` padding, so
the best start of a window that ends at j is the minimum of cost(i) + position(i) over the starts within
reach: a monotone queue slides over them, and each boundary enters and leaves it once. Windows whose length
is a power of two are not padded; their few starts are looked up.

The stream is worked off in blocks of bounded size, with the result of one block over all of it: at a block's edge, cuts are
settled only up to the last boundary that the best ways to all boundaries in reach of the edge have in common; the tokens after it
go on in the next block. (Ways that have nothing in common over ``MOST`` tokens, as in endless periodic texts, are settled by the
cheapest; so memory is bounded.) A partition closes its last window, so padding there is at most one window in each partition. The
number of a sequence holds its partition's number. A task depends on its partition alone, which a lost executor's
successor reads again; before packing rows that come out of a shuffle, store them.

Ids are those of the vocabulary file's tokens and ranks, by the public byte-level split; they equal the tokenizer library's, which a
test checks. (Its file knows no normaliser and no added tokens but special ones, which are read.)

Edge cases. Null and empty texts are the end token alone. Documents of any length are cut as often as needed. Of cuts of equal
cost (ties) the earliest start counts. Repeated rows are packed each. An empty table gives no pieces. Only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

CAPACITY, END = 1024, 0
#: Penalties, in tokens of padding, for a window that ends inside a document: after a sentence, or within one.
SENTENCE_CUT, HARD_CUT = 8, 64
#: Stretches without a boundary get a place to cut after so many tokens.
HARD_STEP = 64
#: Tokens of one block of the stream, and those over which an edge may stay open.
BLOCK, MOST = 1 << 19, 1 << 22


def cut_points(positions: list[int], penalties: list[int], capacity: int = CAPACITY, more: bool = False, settle: bool = False) -> list[int]:
    """Indexes of the boundaries where windows end.

    ``positions``: increasing, the first where the first window starts; no step exceeds ``capacity``.
    ``penalties``: of a cut there. Costs are compared by value, ties go to the earliest start met.
    With ``more`` the stream goes on: only the cuts are given that hold whatever comes; with ``settle`` also those of the cheapest way.
    """
    n = len(positions)
    cost, start, queue, at = [0] * n, [0] * n, deque([0]), {positions[0]: 0}
    key = [positions[0]] + [0] * (n - 1)  # cost + position
    sizes = [s for k in range(capacity.bit_length()) if (s := 1 << k) <= capacity]
    get = at.get
    for j in range(1, n):
        p = positions[j]
        while positions[queue[0]] < p - capacity:
            queue.popleft()
        best_i = queue[0]
        best = key[best_i] + capacity - p
        if p - positions[best_i] == capacity and not capacity & (capacity - 1):
            best = cost[best_i]
        for s in sizes:
            i = get(p - s)
            if i is not None and cost[i] < best:
                best, best_i = cost[i], i
        best += penalties[j]
        cost[j], start[j] = best, best_i
        k = key[j] = best + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
        at[p] = j
    j = n - 1
    if more:
        ways = {i for i in range(n - 1, -1, -1) if positions[i] >= positions[-1] - capacity}
        if settle:
            ways = {min(ways, key=lambda i: (key[i], i))}
        heap = [-i for i in ways]
        heapify(heap)
        while len(heap) > 1:  # the latest of the ways goes back by one window
            i = start[-heappop(heap)]
            if i not in ways:
                ways.add(i)
                heappush(heap, -i)
        j = -heap[0]
    out = []
    while j:
        out.append(j)
        j = start[j]
    return out[::-1]


class Tokens:
    """Ids of a vocabulary file of byte-level BPE, and which of them end or begin sentences."""

    def __init__(self, spec: bytes) -> None:
        import numpy as np
        import tiktoken

        parsed = json.loads(spec)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others from 256 on
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in parsed["added_tokens"] if t["special"]}
        ranks = {bytes(map(byte.__getitem__, w)): i for w, i in parsed["model"]["vocab"].items() if w not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # the public byte-level split
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        size = 1 + max([*ranks.values(), *special.values()])
        self.ends, self.begins, self.lines = (np.zeros(size, bool) for _ in range(3))
        for token, i in ranks.items():
            self.ends[i] = token[-1:] in (b".", b"!", b"?")
            self.begins[i] = token[:1] in (b" ", b"\n")
            self.lines[i] = b"\n" in token

    def ids(self, text: str):
        if any(s in text for s in self.special):
            import numpy as np

            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4")
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


_tokens: dict[str, Tokens] = {}


class _Packer:
    """Packs one partition's stream."""

    def __init__(self, tokens: Tokens, first: int, capacity: int, with_ids: bool) -> None:
        import numpy as np

        self.np, self.tokens, self.next, self.capacity, self.with_ids = np, tokens, first, capacity, with_ids
        self.parts: list[tuple] = []  # (id, offset of this part in its document, ids, document's length)
        self.size, self.limit = 0, BLOCK

    def add(self, doc_id, text: str | None) -> Iterator[tuple]:
        np = self.np
        ids = np.append(self.tokens.ids(text or "").astype("<u4"), np.array([END], "<u4"))
        for at in range(0, len(ids), BLOCK):
            part = ids[at : at + BLOCK]
            if at and self.parts:  # what is left of the same document: a window's piece of it stays one
                _, since, before, _ = self.parts.pop()
                self.parts.append((doc_id, since, np.concatenate([before, part]), len(ids)))
            else:
                self.parts.append((doc_id, at, part, len(ids)))
            self.size += len(part)
            if self.size >= self.limit:
                yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        np = self.np
        if not self.parts:
            return
        stream = np.concatenate([p[2] for p in self.parts])
        lengths = np.array([len(p[2]) for p in self.parts], np.int64)
        stops = np.cumsum(lengths)
        inside = np.zeros(len(stream) + 1, np.int16)
        inside[1:-1] = np.where(self.tokens.lines[stream[:-1]] | (self.tokens.ends[stream[:-1]] & self.tokens.begins[stream[1:]]), 2, 0)
        done = np.array([p[1] + len(p[2]) == p[3] for p in self.parts])
        inside[stops[done]] = 1
        inside[0] = 1
        marks = np.flatnonzero(inside)
        wide = np.flatnonzero(np.diff(np.append(marks, len(stream))) > HARD_STEP)
        if len(wide):
            ends = np.append(marks, len(stream))
            inside[np.concatenate([np.arange(ends[w] + HARD_STEP, ends[w + 1], HARD_STEP) for w in wide])] |= 4
        if last and not inside[-1]:
            inside[-1] = 4
        marks = np.flatnonzero(inside)
        price = np.array([0, 0, SENTENCE_CUT, 0, HARD_CUT, 0, SENTENCE_CUT, 0], np.int64)
        positions = marks.tolist()
        cuts = [positions[i] for i in cut_points(positions, price[inside[marks]].tolist(), self.capacity, not last, len(stream) >= MOST)]
        part, begin, start = 0, 0, 0  # begin: where the part at hand starts in the stream
        for cut in cuts:
            offset = 0
            while start < cut:
                doc_id, at, ids, total = self.parts[part]
                stop = min(cut, begin + len(ids))
                piece = ids[start - begin : stop - begin]
                yield doc_id, at + start - begin, len(piece), zlib.crc32(piece.tobytes()), total, self.next, offset, *([piece.tolist()] if self.with_ids else [])
                offset += len(piece)
                start = stop
                if stop == begin + len(ids):
                    part, begin = part + 1, stop
            self.next += 1
        rest = self.parts[part:]
        if rest and start > begin:
            doc_id, at, ids, total = rest[0]
            rest[0] = (doc_id, at + start - begin, ids[start - begin :], total)
        self.parts, self.size = rest, sum(len(p[2]) for p in rest)
        self.limit = self.size + BLOCK


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``, if asked for)."""
    spark = df.sparkSession
    bound_batches(spark)
    with open(vocabulary, "rb") as f:
        spec = f.read()
    key, shipped = hashlib.sha256(spec).hexdigest(), spark.sparkContext.broadcast(spec)  # a file of fixed size
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    fields = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids
    target = spark.createDataFrame([], fields).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        if key not in _tokens:
            _tokens[key] = Tokens(shipped.value)
        out = to_arrow_schema(target)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        packer = _Packer(_tokens[key], TaskContext.get().partitionId() << 33, capacity, with_ids)
        for b in batches:
            rows = [row for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in packer.add(i, t)]
            if rows:
                yield batch(rows)
        if rows := list(packer.flush(True)):
            yield batch(rows)

    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, target)
