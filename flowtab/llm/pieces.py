"""SentencePiece encoding and decoding of BPE models by a table of each prefix's last token.

The ids of a text that merges give (best score first, leftmost of equal ones) have a property: every run of neighbours among them is
what its own text gives, and a row of tokens of which all neighbours hold together in this sense is what the merges give. So each prefix
of a text has exactly one last token: the one that ends there and is compatible with the last token of the prefix before it. An automaton
over the vocabulary meets all tokens that end at a place, the compatibility test (the two tokens' text, merged by itself, would give
just the two) picks the one, and the table is filled from left to right. The ids are then read backwards from the end: linear
time for a text of any length, whatever merges cross it. Tokens that their own text does not give can never be last; they are left out.

No token goes on after white space or has a line end (both are read off the model, else a text is worked on as one), so texts are
encoded word by word, and a worker keeps the ids of words that it met, up to a bound. Characters
outside the vocabulary become byte tokens.

Models with a normalisation table, user-defined or unused tokens, or without byte tokens are refused.

Edge cases. Null and empty texts have no ids. Texts of any length are encoded whole, one at a time. Ties of score go to the left.
Repeated rows give equal rows; an empty table gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import re
from collections import Counter
from heapq import heapify, heappop, heappush
from itertools import chain, groupby, pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row

#: Words in each of the two halves of a worker's memo, the longest word that it keeps, and entries of its memo of neighbours.
MEMO, MEMO_LENGTH, NEIGHBOURS = 300_000, 64, 400_000
SPACE = "▁"
# Kinds of tokens in a model's file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class PrefixTable:
    """Encoder and decoder of one model: ``pieces`` are ``(text, score, kind)`` by id."""

    def __init__(self, pieces: list[tuple[str, float, int]], prefix_space: bool = True, unknown: str = " ⁇ ") -> None:
        self.pieces, self.prefix_space, self.unknown = pieces, prefix_space, unknown
        kinds = {kind for _, _, kind in pieces}
        if not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or sum(kind == _BYTE for _, _, kind in pieces) != 256:
            raise ValueError("a model of plain tokens and 256 byte tokens is needed")
        self.score = {text: score for text, score, kind in pieces if kind == _NORMAL}
        self.ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == _NORMAL}
        self.byte_ids = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == _BYTE}
        shared = Counter(self.score.values())
        self.edges: dict[int, tuple[list, list] | None] = {}
        for text, i in self.ids.items():
            steps: list[tuple[float, int, int]] = []
            if self.merge(text, steps) == [text]:
                plain = all(a[0] <= b[0] for a, b in pairwise(steps)) and not any(shared[-rank] > 1 for rank, _, _ in steps)
                self.edges[i] = (self._edge(text, steps, True), self._edge(text, steps, False)) if plain else None
        self._start()

    @classmethod
    def from_model(cls, data: bytes) -> PrefixTable:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(data)
        how, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != trained.BPE or how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("a BPE model without normalisation is needed")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], how.add_dummy_prefix, trained.unk_surface)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("pieces", "prefix_space", "unknown", "score", "ids", "byte_ids", "edges")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        """What a worker builds for itself: the automaton and empty memos."""
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i in self.edges:
            text = self.pieces[i][0]
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        # A word: white space and what follows it. Control characters that are in no token stand alone.
        met = set(chain.from_iterable(self.ids))
        alone = "".join(f"\\x{i:02x}" for i in range(32) if chr(i) not in met)
        spans = any(SPACE in text.lstrip(SPACE) for text in self.ids)
        self.words = re.compile("(?s).+" if spans else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + f"|[{alone}]+" * bool(alone))
        # A full half becomes the older one, out of which words that are met again come back: common words stay.
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.neighbours: dict[tuple[int, int], bool] = {}
        surfaces = {_UNKNOWN: lambda text: self.unknown, _CONTROL: lambda text: "", _NORMAL: lambda text: text.replace(SPACE, " ")}
        self.controls = {i for i, (_, _, kind) in enumerate(self.pieces) if kind == _CONTROL}
        self.raw = [bytes([int(text[3:5], 16)]) if kind == _BYTE else surfaces[kind](text).encode() for text, _, kind in self.pieces]

    @staticmethod
    def _edge(text: str, steps: list[tuple[float, int, int]], left: bool) -> list[tuple[str, float]]:
        """The parts that stand at one end of a token while it is merged, each with the rank of the step that takes it up."""
        mine = [step for step in steps if (step[1] == 0 if left else step[2] == len(text))]
        parts = [text[0] if left else text[-1], *(text[at:end] for _, at, end in mine)]
        return list(zip(parts, [*(rank for rank, _, _ in mine), math.inf], strict=True))

    def merge(self, text: str, steps: list[tuple[float, int, int]] | None = None) -> list[str]:
        """Merge neighbours, best score first, then leftmost, until no two give a token. ``steps`` gets each merge's rank, begin and end."""
        n, score = len(text), self.score.get
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, i + 2) for i in range(n - 1) if (s := score(text[i : i + 2])) is not None]
        heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, end = heappop(heap)
            if not alive[i] or ends[i] >= end or ends[ends[i]] != end or not alive[ends[i]]:
                continue  # one of the two has been merged since
            if steps is not None:
                steps.append((rank, i, end))
            alive[ends[i]] = False
            ends[i] = end
            if end < n:
                before[end] = i
            for k in (i, before[i]):
                if k >= 0 and ends[k] < n and (s := score(text[k : ends[ends[k]]])) is not None:
                    heappush(heap, (-s, k, ends[ends[k]]))
        out, i = [], 0
        while i < n:
            out.append(text[i : ends[i]])
            i = ends[i]
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' text, merged by itself, gives just the two.

        It does unless a merge over the border comes before the steps that take up the parts on both its sides. Where a token's steps are
        not in order of rank, or ranks are shared, the text is merged.
        """
        found = self.neighbours.get((left, right))
        if found is None:
            if len(self.neighbours) >= NEIGHBOURS:
                self.neighbours.clear()
            a, b = self.edges[left], self.edges[right]
            if a and b:
                found = self._holds(a[1], b[0])
            else:
                x, y = self.pieces[left][0], self.pieces[right][0]
                found = self.merge(x + y) == [x, y]
            self.neighbours[left, right] = found
        return found

    def _holds(self, ends: list[tuple[str, float]], begins: list[tuple[str, float]]) -> bool:
        score, i, j = self.score.get, 0, 0
        while True:
            (x, x_taken), (y, y_taken) = ends[i], begins[j]
            over = score(x + y)
            # Of equal ranks the leftmost comes first: inside the left token, over the border, inside the right token.
            if over is not None and -over < x_taken and -over <= y_taken:
                return False
            if x_taken == y_taken == math.inf:
                return True
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1

    def last_tokens(self, text: str) -> list[tuple[int, int] | None]:
        """For each prefix its last token and that token's length; None where the last character is in no token."""
        last: list[tuple[int, int] | None] = [None] * len(text)
        known, test = self.neighbours.get, self.compatible
        for end, token in self.automaton.iter(text):
            if last[end] is None:
                at = end - token[1]
                if at < 0 or (prior := last[at]) is None or known(pair := (prior[0], token[0])) or (pair not in self.neighbours and test(*pair)):
                    last[end] = token
        return last

    def word(self, text: str) -> tuple[int, ...]:
        got = self.older.get(text) or self.backwards(text)
        if len(text) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[text] = got
        return got

    def backwards(self, text: str) -> tuple[int, ...]:
        """Ids by the table, from the end to the begin."""
        last, end, back = self.last_tokens(text), len(text) - 1, []
        while end >= 0:
            token = last[end]
            if token is None:
                back.extend(self.byte_ids[b] for b in reversed(text[end].encode("utf-8", "surrogatepass")))
                end -= 1
            else:
                back.append(token[0])
                end -= token[1]
        return tuple(reversed(back))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = SPACE * self.prefix_space + text.replace(" ", SPACE)
        memo, word = self.memo, self.word  # an older memo of the same words, where it is turned over meanwhile
        return list(chain.from_iterable([memo.get(w) or word(w) for w in self.words.findall(text)]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        first = next((at for at, i in enumerate(ids) if self.pieces[i][2] != _CONTROL), len(ids))
        ids = ids[first:]
        parts = list(map(self.raw.__getitem__, ids))
        if ids and self.prefix_space and self.pieces[ids[0]][2] == _NORMAL and self.pieces[ids[0]][0].startswith(SPACE):
            parts[0] = parts[0][1:]
        if self.controls.isdisjoint(ids):
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        # Bytes that other tokens part are no character together.
        runs = groupby(zip(ids, parts, strict=True), lambda pair: self.pieces[pair[0]][2])
        return "".join(b"".join(part for _, part in run).decode("utf-8", _EACH) for _, run in runs)


_EACH = "flowtab_each_byte"
codecs.register_error(_EACH, lambda e: ("\ufffd", e.start + 1))


_models: dict[str, PrefixTable] = {}


def _model(key: str, shipped) -> PrefixTable:
    """One model, with its memos, per file and Python worker."""
    if key not in _models:
        _models[key] = shipped.value
    return _models[key]


def _per_text(df: DataFrame, model: str, id_col: str, text_col: str, fields: str, make) -> DataFrame:
    """The model (a fixed size, read once on the driver) goes to the workers as a broadcast."""
    with open(model, "rb") as f:
        data = f.read()
    key = hashlib.sha256(data).hexdigest()
    shipped = df.sparkSession.sparkContext.broadcast(_models.get(key) or _models.setdefault(key, PrefixTable.from_model(data)))
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return per_row(df, [id_col, text_col], lambda: make(_model(key, shipped)), f"doc_id {kind}, {fields}")


def encode_documents(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row."""
    return _per_text(df, model, id_col, text_col, "ids array<int>", lambda m: lambda i, t: (i, m.encode(t)))


def decode_documents(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text string``: the text of every row's ids; a null list has none."""
    return _per_text(df, model, id_col, ids_col, "text string", lambda m: lambda i, ids: (i, m.decode(ids or [])))


def round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def make(table: PrefixTable):
        names = [str(i) for i in range(len(table.pieces))]

        def one(i, text):
            ids = table.encode(text)
            spelt = ",".join(map(names.__getitem__, ids))
            return i, len(ids), hashlib.sha256(spelt.encode()).hexdigest(), hashlib.sha256(table.decode(ids).encode()).hexdigest()

        return one

    return _per_text(df, model, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
