"""The prefix table against the library, against plain merges, and on edge cases."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from flowtab.llm import pieces, queries
from tests_llm_common import DATA, edge, table  # noqa: F401

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "   ", " " * 19, "▁", "\n", "\r", "\t", "a", "b", "th", "the", "in", "er", "é", "世", "🙂", "\x00", "\x1c", "0", "12", "&", "ing", " ", ");", "<s>", "<0x41>"]


@pytest.fixture(scope="module")
def own():
    with open(MODEL, "rb") as f:
        return pieces.PrefixTable.from_model(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_as_the_library(own, library):
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        ids = own.encode(text)
        assert ids == library.encode(text)
        assert own.decode(ids) == library.decode(ids)
    for point in [*range(0, 0xD800, 53), *range(0xE000, 0x20000, 97)]:
        assert own.encode(f"a{chr(point)}b") == library.encode(f"a{chr(point)}b")


def test_any_ids_decode(own, library):
    rng = random.Random(4)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999), 259, 28705]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)


def test_each_prefix_has_one_last_token(own):
    """The table holds, for every prefix, the last token that plain merges give."""
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice([p for p in PARTS if "\n" not in p and "\x00" not in p and "\t" not in p]) for _ in range(rng.randint(1, 12))).replace(" ", "▁")
        last = own.last_tokens(text)
        for end in range(1, len(text) + 1):
            want = own.merge(text[:end])[-1]
            got = last[end - 1]
            assert (own.pieces[got[0]][0] if got else text[end - 1]) == want


def test_compatibility_is_what_merges_say(own):
    rng = random.Random(7)
    ids = list(own.edges)
    for _ in range(20000):
        a, b = rng.choice(ids), rng.choice(ids)
        x, y = own.pieces[a][0], own.pieces[b][0]
        assert own.compatible(a, b) == (own.merge(x + y) == [x, y])


def test_tokens_over_white_space():
    """A model with tokens that go on after white space, with a token that its own text does not give, and with equal scores."""
    texts = ["▁", "a", "b", "c", "a▁b", "▁b", "ab", "abc", "bc", "ca", "bcbcbc"]
    scores = [0, 0, 0, 0, -3.0, -2.0, -5.0, -6.0, -1.0, -2.0, -7.0]
    model = pieces.PrefixTable([("<unk>", 0, 2), *((f"<0x{i:02X}>", 0, 6) for i in range(256)), *((t, s, 1) for t, s in zip(texts, scores))], prefix_space=False)
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 30)))
        assert [model.pieces[i][0] for i in model.encode(text)] == model.merge(text.replace(" ", "▁"))
    assert model.ids["ab"] in model.edges and model.ids["bcbcbc"] not in model.edges


def test_a_long_text_and_turned_over_memos(own, library, monkeypatch):
    text = "ab" * 60000 + " " * 3001 + "z"
    assert own.encode(text) == library.encode(text)
    monkeypatch.setattr(pieces, "MEMO", 3)
    monkeypatch.setattr(pieces, "NEIGHBOURS", 5)
    text = "one two three four five one two seven one two"
    assert [own.encode(text) for _ in range(3)] == [library.encode(text)] * 3


def test_refused_models(own):
    with pytest.raises(ValueError):
        pieces.PrefixTable([("<unk>", 0, 2), ("a", 0, 1)])


def test_query(spark, library):
    docs = table(spark, "sf0.001")
    got = {r.doc_id: r for r in queries.op11_sentencepiece(spark, f"{DATA}/sf0.001").collect()}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(rows) > 0
    for r in rows:
        ids = library.encode(r.text)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edges(spark, edge, library):  # noqa: F811
    ids = pieces.encode_documents(edge, MODEL)
    assert ids.columns == ["doc_id", "ids"]
    rows = edge.select("doc_id", "text").collect()
    assert sorted(map(str, ids.collect())) == sorted(str(type(r)(doc_id=r.doc_id, ids=library.encode(r.text or ""))) for r in rows)
    back = pieces.decode_documents(ids, MODEL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r.doc_id or 0, library.decode(library.encode(r.text or ""))) for r in rows)
    assert pieces.round_trip(edge, MODEL).count() == len(rows)
    assert pieces.round_trip(edge.limit(0), MODEL).count() == 0
    assert pieces.decode_documents(spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>"), MODEL).collect() == [(1, ""), (2, "")]
