"""Near copies against brute force."""

import functools
import itertools
import random

from flowtab.llm import near_copies, simhash


def prose(rng, n):
    return [rng.choice("the of and to in river stone cloud paper lamp green seven walk table north".split()) + str(rng.randrange(40)) for _ in range(n)]


@functools.cache
def grams(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    same = len(grams(a) & grams(b))
    return same / (len(grams(a)) + len(grams(b)) - same)


def by_force(rows):
    kept = []
    for i, t in sorted(rows):
        if not any(jaccard(t, u) >= 0.8 for _, u in kept):
            kept.append((i, t))
    return set(kept)


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    texts = []
    for _ in range(25):
        words = prose(rng, rng.randrange(60, 400))
        texts += [" ".join(words), *(edited(rng, words, max(1, round(len(words) * share))) for share in (0.004, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05))]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_recall_by_brute_force(spark):
    rows = corpus(random.Random(21))
    prints = {i: simhash.fingerprint(t) & (1 << 64) - 1 for i, t in rows}
    pairs = [(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if jaccard(a, b) >= 0.8]
    assert sum((prints[i] ^ prints[j]).bit_count() > 3 for i, j in pairs) > 10  # those that three bits miss
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.text) for r in got.collect()} == by_force(rows)


def test_crowded_buckets(spark, monkeypatch):
    """Rounds by firsts give the same as all pairs, and a group of near copies leaves one."""
    rng = random.Random(22)
    words = prose(rng, 200)
    rows = corpus(rng) + [(1000 + k, edited(rng, words, 1)) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_copies, "PAIRS", 0)
    monkeypatch.setattr(near_copies, "SHARE", 8)
    got = {(r.doc_id, r.text) for r in near_copies.keep_one(df).collect()}
    assert got == by_force(rows) and sum(i >= 1000 for i, _ in got) == 1


def test_shared_passages(spark, monkeypatch):
    """Texts that share most of their words without being alike fill a bucket; the rarest shingles tell those that are alike."""
    rng = random.Random(25)
    passage = prose(rng, 70)
    texts = [" ".join(prose(rng, 8) + passage + prose(rng, 10)) for _ in range(60)]
    texts += [t + " more" for t in texts[:7]] + ["few " + " ".join(t.split()[1:]) for t in texts[5:9]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    monkeypatch.setattr(near_copies, "HOLDERS", 8)
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.text) for r in got.collect()} == by_force(rows)
    held = [(i, i, near_copies.shingles(t)) for i, t in rows]
    sets = spark.createDataFrame(held, "node bigint, rank bigint, set array<bigint>")
    met = near_copies._by_rarest(sets.selectExpr("node", "rank", "size(set) AS n"), sets.select("node", "set"))
    alike = {(j, i) for (i, a), (j, b) in itertools.combinations(rows, 2) if jaccard(a, b) >= 0.8}
    found = {(r.x, r.m) for r in met.collect()}
    assert alike and alike <= found and len(found) < 200  # of 2,485 pairs


def test_edges(spark):
    one = " ".join(prose(random.Random(23), 50))
    rows = [(1, one), (1, one), (2, one.upper()), (None, one + " x"), (3, None), (4, ""), (5, " \n"), (6, "a b"), (7, "a  B"), (8, "a c"), (None, "b a")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, `a.b` int")
    got = near_copies.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, "b a"), (1, one), (3, ""), (6, "a b"), (8, "a c")]
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_pipeline_stage(spark):
    import corpus_pipeline

    words = prose(random.Random(24), 300)
    rows = [(k, edited(random.Random(k), words, 4)) for k in range(6)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert {(r.doc_id, r.text) for r in left.collect()} == by_force(rows)


def test_texts_of_one_hash_are_kept(spark, monkeypatch):
    """Where different texts share a node they are told apart by the second hash: none is lost, and their copies still go."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(8)]
    near = texts[6].split()
    near[30] = "other"
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], " ".join(near)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    signed = near_copies._signed(df, "doc_id", "text").collect()
    # The first three texts are given one node.
    node = signed[0].node
    forged = spark.createDataFrame([(r.doc_id, bytes(r.row_key), node if r.doc_id in (0, 1, 2, 8) else r.node, r.check, r.n, r.bands) for r in signed], near_copies._signed(df, "doc_id", "text").schema)
    monkeypatch.setattr(near_copies, "_signed", lambda *_: forged)
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == list(range(8))


def test_pipeline_goes_by_simhash_first_and_by_shingles_then(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(61)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(n))
    phrase, base = words(13), words(300).split()
    # Shingles that are repeated weigh in SimHash and not in sets; some words changed tell fingerprints apart and leave the sets alike.
    linked = [" ".join([phrase] * 60 + [words(30)]) for _ in range(2)]
    changed = base[:20] + words(6).split() + base[26:]
    texts = [*linked, " ".join(base), " ".join(changed), words(40)]
    bits = [simhash.fingerprint(t) for t in texts]
    apart = lambda i, j: ((bits[i] ^ bits[j]) & (1 << 64) - 1).bit_count()
    alike = lambda i, j: len(set(near_copies.shingles(texts[i])) & set(near_copies.shingles(texts[j]))) / len(set(near_copies.shingles(texts[i])) | set(near_copies.shingles(texts[j])))
    assert apart(0, 1) <= simhash.MAX_BITS and alike(0, 1) < near_copies.ALIKE
    assert apart(2, 3) > simhash.MAX_BITS and alike(2, 3) >= near_copies.ALIKE
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2, 4]
