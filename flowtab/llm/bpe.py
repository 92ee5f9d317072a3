"""Byte-level BPE by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary finds a whole pre-token that is itself a token; the
stored token is compared, so a stranger never passes. Tier two: a pre-token that is not in the vocabulary
starts as single bytes in a doubly linked list, and a heap of (rank, place) gives the pair to merge next.
Pre-tokens met again are answered from a memo of bounded size in each Python worker.

Edge cases. Null and empty texts have no ids. Texts of any length are encoded whole, one at a time. Pairs of equal rank (ties) merge
from the left. Repeated rows give equal rows; an empty table gives an empty result; only the named columns are read, so others may have
any name.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row

#: Entries of a worker's memo of pre-tokens, which starts anew when full, and the longest pre-token that it keeps: a bound in bytes.
MEMO, MEMO_LENGTH = 400_000, 64
#: Displacements tried for a bucket before all is hashed anew by another seed.
TRIES = 1 << 16

# The public split pattern, by the largest code point of a text: explicit classes are searched faster. White
# space is Unicode's White_Space, which has no U+001C to U+001F.
_SPACE = "\\t-\\r \\x85\\xa0"
_WIDE_SPACE = _SPACE + "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CLASSES = {
    0x7F: ("A-Za-z", "0-9", "\\t-\\r "),
    0xFF: ("A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", _SPACE),
    0x10FFFF: (r"\p{L}", r"\p{N}", _WIDE_SPACE),
}


def split_pattern(letters: str, numbers: str, space: str) -> str:
    """Contractions; letters, numbers or other signs after at most one space; white space."""
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


class Splitter:
    """Pre-tokens of a text."""

    def __init__(self) -> None:
        import re

        import regex

        narrow, latin, wide = (split_pattern(*_CLASSES[k]) for k in sorted(_CLASSES))
        self.narrow, self.latin, self.wide = re.compile(narrow), re.compile(latin), regex.compile(wide)

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.narrow.findall(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide.findall(text)
        return self.latin.findall(text)


class PerfectHash:
    """Minimal perfect hash of byte strings: hash to a bucket, displace each bucket into free slots.

    Largest buckets go first; of each bucket the smallest displacement that sends all its keys to free slots
    is kept. ``find`` gives a key's slot, or any slot for a stranger.
    """

    def __init__(self, keys: list[bytes], load: int = 2) -> None:
        self.n = max(1, len(keys))
        self.buckets, self.seed = max(1, self.n // load), 0
        if len(set(keys)) < len(keys):
            raise ValueError("keys must differ")
        while not self._placed(keys):
            self.seed += 1

    def _placed(self, keys: list[bytes]) -> bool:
        from xxhash import xxh3_64_intdigest

        n = self.n
        groups: dict[int, list[tuple[int, int]]] = {}
        for at, key in enumerate(keys):
            h = xxh3_64_intdigest(key, self.seed)
            groups.setdefault((h & 0xFFFFFFFF) % self.buckets, []).append((h >> 32, at))
        self.shift, self.slots = [0] * self.buckets, [-1] * n
        free, lowest = self.slots, 0
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:  # a single key takes the next free slot by its number
                while free[lowest] >= 0:
                    lowest += 1
                free[lowest] = members[0][1]
                self.shift[bucket] = -1 - lowest
                continue
            for d in range(1, TRIES):
                places = [(h + d * (h >> 16 | 1)) % n for h, _ in members]
                if len(set(places)) == len(places) and all(free[p] < 0 for p in places):
                    break
            else:
                return False
            for p, (_, at) in zip(places, members, strict=True):
                free[p] = at
            self.shift[bucket] = d
        return True

    def find(self, key: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        h = xxh3_64_intdigest(key, self.seed)
        d = self.shift[(h & 0xFFFFFFFF) % self.buckets]
        if d < 0:
            return self.slots[-1 - d]
        h >>= 32
        return self.slots[(h + d * (h >> 16 | 1)) % self.n]


class TwoTierBPE:
    """Encoder and decoder over a rank file's tokens."""

    def __init__(self, tokens: list[bytes], ids: list[int]) -> None:
        self._fill(tokens, ids, PerfectHash(tokens))

    def _fill(self, tokens: list[bytes], ids: list[int], found: PerfectHash) -> None:
        self.tokens, self.ids, self.hash = tokens, ids, found
        self.by_id = dict(zip(ids, tokens, strict=True))
        self.ranks = dict(zip(tokens, ids, strict=True))  # of the pairs that merges ask for
        self.split = Splitter()
        self.memo: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_ranks(cls, lines: bytes) -> TwoTierBPE:
        pairs = [line.split() for line in lines.splitlines() if line.strip()]
        return cls([base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs])

    def __getstate__(self) -> tuple[list[bytes], list[int], PerfectHash]:
        return self.tokens, self.ids, self.hash

    def __setstate__(self, state: tuple[list[bytes], list[int], PerfectHash]) -> None:
        self._fill(*state)

    def rank(self, piece: bytes) -> int:
        """The id of a token, or -1: the first tier."""
        at = self.hash.find(piece)
        return self.ids[at] if at >= 0 and self.tokens[at] == piece else -1

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, leftmost first, until none is left: the second tier."""
        n, rank = len(piece), self.ranks.get
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # ends: where a node stops and the next begins
        found, heap = [-1] * (n + 1), []  # found: where the pair that starts at a node would end, -1 without one
        for i in range(n - 1):
            if (r := rank(piece[i : i + 2])) is not None:
                found[i] = i + 2
                heap.append((r, i, i + 2))
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            if found[i] != end:
                continue  # one of the two has been merged since
            found[ends[i]] = -1
            ends[i] = end
            if end < n:
                before[end] = i
            for k in (i, before[i]):
                if k >= 0:
                    j = ends[k]
                    if j < n and (r := rank(piece[k : ends[j]])) is not None:
                        found[k] = ends[j]
                        heappush(heap, (r, k, ends[j]))
                    else:
                        found[k] = -1
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def word(self, pre_token: str) -> tuple[int, ...]:
        raw = pre_token.encode("utf-8", "surrogatepass")
        known = self.rank(raw)
        got = (known,) if known >= 0 else self.merge(raw)
        if len(pre_token) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[pre_token] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        memo, word = self.memo.get, self.word
        return list(chain.from_iterable([memo(w) or word(w) for w in self.split(text)])) if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


_models: dict[str, TwoTierBPE] = {}


def _model(key: str, shipped) -> TwoTierBPE:
    """One model, with its memo, per vocabulary and Python worker."""
    if key not in _models:
        _models[key] = shipped.value
    return _models[key]


def _per_text(df: DataFrame, vocabulary: str, id_col: str, text_col: str, fields: str, make) -> DataFrame:
    """The tables of the vocabulary (a fixed size, read once on the driver) go to the workers as a broadcast."""
    with open(vocabulary, "rb") as f:
        lines = f.read()
    key = hashlib.sha256(lines).hexdigest()
    shipped = df.sparkSession.sparkContext.broadcast(_models.setdefault(key, TwoTierBPE.from_ranks(lines)))
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return per_row(df, [id_col, text_col], lambda: make(_model(key, shipped)), f"doc_id {kind}, {fields}")


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row."""
    return _per_text(df, vocabulary, id_col, text_col, "ids array<int>", lambda m: lambda i, t: (i, m.encode(t)))


def decode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, data binary``: the bytes of every row's ids; a null list has none."""
    return _per_text(df, vocabulary, id_col, ids_col, "data binary", lambda m: lambda i, ids: (i, m.decode(ids or [])))


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def make(model: TwoTierBPE):
        names = {i: str(i) for i in model.ids}

        def one(i, text):
            ids = model.encode(text)
            spelt = ",".join(map(names.__getitem__, ids))
            return i, len(ids), hashlib.sha256(spelt.encode()).hexdigest(), hashlib.sha256(model.decode(ids)).hexdigest()

        return one

    return _per_text(df, vocabulary, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
