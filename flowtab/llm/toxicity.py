"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words (letters, lower case), of their beginnings, and of the beginnings that are frequent in
it, as 64-bit hashes. The machine has a weight and a vector for each term:
``score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j> - cut)``; the pairs are had as half of the squared
sum of the vectors less the sum of their squares.

Terms come in by two ways, neither with a limit to their number, which is that of the sample's. Spark counts the terms
of the labelled sample by label, and all that tell alone (chi-square) are taken. Then pairs are looked at: a machine of these terms,
fitted on one half of the sample, leaves residuals on the other. Of all pairs of terms that have support in documents of label 1, Spark
sums the residuals of the documents with both, block by block, as matrix products; where a sum is beyond chance (Bernstein's bound), both
terms are taken. So an insult and the mention of a group that tell nothing alone come in together.

The machine is fitted by mini-batches on three folds; the cut that makes 0.5 the threshold is chosen on a fourth, from which its
weights have not been learned (largest F2: a missed document counts more than one wrongly marked). It is
broadcast (its size is bounded by the sample) and applied to every document where it lies.

Bounds, all parameters: ``SAMPLE`` labelled documents with ``NUMBERS`` terms altogether.

Edge cases. Null and empty texts get the bias alone as score. Very long texts are scored whole, by their set of terms. Null ids are
scored and not held out. A score of exactly 0.5 (tie) counts as toxic. Repeated rows get equal scores. Without labels all scores are a
low prior. An empty table gives an empty result. Of ``documents`` only id and text are read, ``drop_toxic`` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, per_row
from .learn import Rows, beginnings, fold, hashed, is_frequent, labelled_ids, sample_features, supported_terms, telling_terms, text_terms, within, word_counts, word_terms

#: Bounds: labelled documents to learn from and terms in them altogether; words in a worker's memo, and the longest one there.
SAMPLE, NUMBERS, MEMO, MEMO_WORD = 16_000, 24_000_000, 100_000, 64
#: Length of a term's vector.
RANK = 8
#: Support of a term in pairs: documents of label 1, and their share. Evidence of a pair (of e^-20 by chance).
PAIR_DOCUMENTS, PAIR_SHARE, EVIDENCE = 8, 0.02, 20.0
#: Terms of one block of the pair sums, and rows that are scored at a time while learning.
_SIDE, _ROWS = 512, 256


def _terms(text: str | None) -> list[int]:
    return sorted(map(hashed, text_terms(text)))


class FactorizationMachine:
    """Binary features given as term numbers."""

    def __init__(self, terms: list[int], rank: int = RANK) -> None:
        import numpy as np

        self.index = {t: i for i, t in enumerate(terms)}
        self.w0, self.w, self.v, self.cut = 0.0, np.zeros(len(terms)), np.zeros((len(terms), rank)), 0.0
        self._memo: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memo": {}}

    def fit(self, rows: Rows, y, updates: int = 1_000, batch: int = 256, step: float = 0.02, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
        """Adam on the logistic loss; weights and vectors decay. As many updates on a small sample as on a large one."""
        import numpy as np

        rng, labels = np.random.default_rng(seed), np.array(y, float)
        prior = (labels.sum() + 0.5) / (len(labels) + 2)
        self.w0 = float(np.log(prior / (1 - prior)))
        n, k = self.v.shape
        if not n or not len(labels):
            return self
        self.v = rng.normal(0, 0.01, (n, k))
        theta = np.concatenate([[self.w0], self.w, self.v.ravel()])
        m, s, t = np.zeros_like(theta), np.zeros_like(theta), 0
        for _ in range(max(1, round(updates * batch / len(labels)))):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                rows_now = order[at : at + batch]
                places, seg = rows.places(rows_now)
                idx = rows.flat[places]
                w, v = theta[1 : n + 1], theta[n + 1 :].reshape(n, k)
                sums = np.stack([np.bincount(seg, v[idx, f], len(rows_now)) for f in range(k)], 1)
                squares = np.bincount(seg, (v[idx] ** 2).sum(1), len(rows_now))
                z = theta[0] + np.bincount(seg, w[idx], len(rows_now)) + 0.5 * ((sums**2).sum(1) - squares)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows_now]) / len(rows_now)
                gv = np.stack([np.bincount(idx, g[seg] * (sums[seg, f] - v[idx, f]), n) for f in range(k)], 1)
                grad = np.concatenate([[g.sum()], np.bincount(idx, g[seg], n), gv.ravel()])
                grad[1:] += decay * theta[1:]
                t += 1
                m = 0.9 * m + 0.1 * grad
                s = 0.999 * s + 0.001 * grad**2
                theta = theta - step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.w0, self.w, self.v = float(theta[0]), theta[1 : n + 1], theta[n + 1 :].reshape(n, k)
        return self

    def logits(self, rows: Rows):
        import numpy as np

        out = np.empty(len(rows))
        for at in range(0, len(rows), _ROWS):  # the vectors of all terms of all rows would be many times the rows
            which = np.arange(at, min(at + _ROWS, len(rows)))
            (places, seg), n = rows.places(which), len(which)
            idx = rows.flat[places]
            v = self.v[idx]
            sums = np.stack([np.bincount(seg, v[:, f], n) for f in range(v.shape[1])], 1)
            out[which] = self.w0 + np.bincount(seg, self.w[idx], n) + 0.5 * ((sums**2).sum(1) - np.bincount(seg, (v**2).sum(1), n))
        return out

    def logit(self, numbers: list[int]) -> float:
        if not numbers:
            return self.w0
        v = self.v[numbers]
        return float(self.w0 + self.w[numbers].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))

    def score(self, text: str | None) -> float:
        """Probability of label 1."""
        from math import exp

        words, get = word_counts(text), self.index.get
        total, found, often = sum(words.values()), set(), {}
        for word, n in words.items():
            got = self._memo.get(word)
            if got is None:
                if len(self._memo) >= MEMO:
                    self._memo.clear()
                terms = [get(hashed(t)) for t in word_terms(word)], [get(hashed(f"{t}+")) for t in beginnings(word)]
                got = tuple(tuple(i for i in numbers if i is not None) for numbers in terms)
                if len(word) <= MEMO_WORD:
                    self._memo[word] = got
            found.update(got[0])
            for i in got[1]:
                often[i] = often.get(i, 0) + n
        found.update(i for i, n in often.items() if is_frequent(n, total))
        return 1 / (1 + exp(-min(30.0, max(-30.0, self.logit(sorted(found)) - self.cut))))


def telling_pairs(spark: SparkSession, rows: Rows, size: int, residual, variance) -> list[int]:
    """Numbers (below ``size``) of all terms in pairs whose documents' residuals do not sum up to chance.

    A sum A with variance V is beyond chance where A^2 / (2 (V + |A| / 3)) is ``EVIDENCE`` or more. Each task takes some pairs of
    blocks of terms; the rows, bounded by the sample, are broadcast.
    """
    import numpy as np

    blocks = -(-size // _SIDE)
    if not blocks or not len(rows):
        return []
    shipped = spark.sparkContext.broadcast((rows.flat.astype(np.int32), rows.row.astype(np.int32), len(rows), residual.astype(np.float32), variance.astype(np.float32)))

    def run(batches):
        import pandas as pd

        flat, row, n, r, p = shipped.value

        def dense(block: int):
            own = flat // _SIDE == block
            out = np.zeros((n, _SIDE), np.float32)
            out[row[own], flat[own] % _SIDE] = 1
            return out

        for pdf in batches:
            found, last, left = set(), None, None
            for k in pdf["id"]:
                i, j = divmod(int(k), blocks)
                if i != last:
                    last, left = i, dense(i)
                right = left if i == j else dense(j)
                sums = np.abs((left * r[:, None]).T @ right)
                if i == j:
                    np.fill_diagonal(sums, 0)
                if sums.max() * 1.5 >= EVIDENCE:  # none is below that
                    spread = (left * p[:, None]).T @ right
                    a, b = np.nonzero((sums * 1.5 >= EVIDENCE) & (sums**2 >= 2 * EVIDENCE * (spread + sums / 3)))
                    found.update((a + i * _SIDE).tolist(), (b + j * _SIDE).tolist())
            yield pd.DataFrame({"id": sorted(found)}, dtype="int64")

    work = spark.range(0, blocks * blocks, 1, min(blocks, 64)).where(F.floor(F.col("id") / blocks) <= F.col("id") % blocks)
    return sorted(work.mapInPandas(run, "id bigint").distinct().toArrow()["id"].to_pylist())


def best_cut(logits, y) -> float:
    """The logit between two documents that gives the largest F2; of several the one nearest to 0."""
    import numpy as np

    order = np.argsort(-logits, kind="stable")
    z, hit = logits[order], np.asarray(y)[order] > 0
    if not hit.any():
        return 0.0
    caught, marked = np.cumsum(hit), np.arange(1, len(z) + 1)
    f2 = 5 * caught / (4 * hit.sum() + marked)
    f2[:-1][z[:-1] == z[1:]] = -1  # no cut between equals
    below = np.append(z[1:], z[-1] - 2)
    best = f2 >= f2.max() - 1e-12
    cuts = np.where((below < 0) & (z > 0), 0.0, (z + below) / 2)[best]
    return float(min(cuts, key=abs))


def fit(df: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE, numbers: int = NUMBERS) -> FactorizationMachine:
    """Learn from at most ``bound`` labelled documents of ``numbers`` terms altogether, none of them held out."""
    import numpy as np

    spark = df.sparkSession
    sample = sample_features(df.select("doc_id", "text"), labelled_ids(labels, label, bound), lambda: lambda i, y, f, k, t: (i, y, f, k, _terms(t)), ["text"], "terms array<bigint>")
    sample = within(sample, "terms", numbers)
    alone, paired = telling_terms(sample), supported_terms(sample, PAIR_DOCUMENTS, PAIR_SHARE)
    terms = sorted({*alone, *paired})
    index = {t: i for i, t in enumerate(terms)}
    numbered = per_row(sample, ["doc_id", "y", "fold", "terms"], lambda: lambda i, y, f, ts: (i, y, f, [index[t] for t in ts if t in index]), f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, fold int, numbers array<int>")
    got = numbered.orderBy("doc_id").toArrow()  # bounded by both parameters; the same order in each run
    lists, y, part = got["numbers"].combine_chunks(), got["y"].to_numpy(), got["fold"].to_numpy()
    rows = Rows(lists.flatten().to_numpy(), lists.value_lengths().to_numpy())
    del got, lists

    number = lambda ts: np.array(sorted(index[t] for t in ts), np.int64)
    known, probability = number(alone), np.zeros(len(y))
    of_known = rows.only(known, len(terms))
    for learn in (part <= 2, part > 2):  # each half's residuals from the other
        model = FactorizationMachine([terms[i] for i in known]).fit(of_known.take(np.flatnonzero(learn)), y[learn])
        probability[~learn] = 1 / (1 + np.exp(-np.clip(model.logits(of_known.take(np.flatnonzero(~learn))), -30, 30)))
    chosen = number(paired)
    found = telling_pairs(spark, rows.only(chosen, len(terms)), len(chosen), y - probability, probability * (1 - probability))
    known = np.union1d(known, chosen[found])
    of_known = rows.only(known, len(terms))
    learn, choose = np.flatnonzero(part != 1), np.flatnonzero(part == 1)
    model = FactorizationMachine([terms[i] for i in known]).fit(of_known.take(learn), y[learn])
    model.cut = best_cut(model.logits(of_known.take(choose)), y[choose])  # of this machine: a cut does not carry over to another
    return model


def score(df: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    source = df.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = per_row(
        source,
        ["doc_id", "text"],
        lambda: lambda i, t: (i, shipped.value.score(t)),
        f"doc_id {kind}, score double",
    )
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, model: FactorizationMachine) -> DataFrame:
    """The rows of ``df`` that the model does not predict as toxic; all columns stay. No row moves.

    Columns ride along in the Arrow batches, so nothing has to be joined back.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts):
        return texts.map(lambda t: shipped.value.score(t) < 0.5)

    bound_batches(df.sparkSession)
    return df.where(clean(F.col("text")))
