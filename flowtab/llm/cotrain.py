"""Quality classifier by co-training of two views.

The content view sees the text: its words and runs of signs, hashed, and measures of its lines and letter cases. The page view sees
metadata alone: source, language and length as the table states them. Each is a logistic regression. In every round both views
score all unlabelled documents, by Spark, and each labels those of which it is surest and hands them to the other, which learns from
them in the next round. How sure a view is, its calibrated (Platt) log-odds say, on a fold that neither has learned from. A
logistic regression over both calibrated log-odds, on the same fold, combines them into the score of all documents.

Features are made once for each document and stored (``features``); rounds and scoring are sums over their arrays.

Bounds, all parameters: ``LABELLED`` labelled documents, ``GROW`` pseudo-labels for each view and round, out of all documents, and
``NUMBERS`` features in what is learned from; ``BUCKETS`` hashed features, so the models (broadcast) have a fixed size.

Edge cases. Null and empty texts are scored by the features of an empty text; null source, language and length are values of their own.
Very long texts are seen whole. Ties in a round's order go by id; a score of exactly 0.5 is kept. Without labels of both kinds the score
is a prior, above one half. Repeated rows get equal scores. An empty table gives an empty result. Only the columns named in
``COLUMNS`` are read; of them all but doc_id and text may be missing, and others may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, per_row, stored, use_checkpoints
from .learn import Rows, fold, labelled_ids, within

LABELLED, GROW, ROUNDS, NUMBERS, BUCKETS = 5_000, 300, 4, 8_000_000, 1 << 15
#: Log-odds, beyond those of the labels' share, from which on a view is sure.
SURE = 1.0
COLUMNS = ["text", "source", "lang", "n_chars"]
_TERM = re.compile(r"[^\W\d_]+|[^\w\s]+|\d+")
_UPPER, _DIGIT, _SIGN = re.compile("[A-Z]"), re.compile("[0-9]"), re.compile(r"[^\w\s]")
_MEASURES, _SOURCES, _LANGS, _SIZES = 8, 1024, 64, 40
_PAGE = _SOURCES + _LANGS + _SIZES


def content_features(text: str | None) -> tuple[list[int], list[float]]:
    """Places and values: buckets of the distinct terms by their log counts, of length 1 together, then measures of the text."""
    from collections import Counter
    from math import log1p
    from zlib import crc32

    text = text or ""
    found: Counter[int] = Counter()
    for term, n in Counter(_TERM.findall(text)).items():
        if term.isalpha():
            keys = [term.lower()] + (["<upper>"] if len(term) > 1 and term.isupper() else [])
        else:
            keys = ["<digits>"] if term.isdigit() else [term]
        for key in keys:
            found[crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS] += n
    values = {k: log1p(n) for k, n in found.items()}
    norm = sum(v * v for v in values.values()) ** 0.5 or 1.0
    keys = sorted(values)
    size, lines = max(1, len(text)), [x for x in text.split("\n") if x.strip()]
    measures = [
        log1p(len(text)) / 10,
        log1p(len(lines)) / 5,
        log1p(size / max(1, len(lines))) / 10,
        len(set(lines)) / max(1, len(lines)),
        len(_UPPER.findall(text)) / size * 5,
        len(_DIGIT.findall(text)) / size * 5,
        len(_SIGN.findall(text)) / size * 5,
        len(text.split()) / size * 5,
    ]
    return [*keys, *range(BUCKETS, BUCKETS + _MEASURES)], [*(values[k] / norm for k in keys), *measures]


def page_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Places, of value 1 each: source and language hashed, and the length's power of the square root of two."""
    from math import log2
    from zlib import crc32

    size = 0 if n_chars is None else 1 + min(_SIZES - 2, int(2 * log2(1 + max(0, n_chars))))
    return [crc32(f"s:{source}".encode("utf-8", "surrogatepass")) % _SOURCES, _SOURCES + crc32(f"l:{lang}".encode("utf-8", "surrogatepass")) % _LANGS, _SOURCES + _LANGS + size]


class Logistic:
    """Sparse rows with values; fitted by Adam, then calibrated."""

    def __init__(self, size: int) -> None:
        import numpy as np

        self.w, self.bias, self.scale, self.shift = np.zeros(size), 0.0, 1.0, 0.0

    def fit(self, rows: Rows, values, y, updates: int = 600, batch: int = 128, step: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Logistic:
        """As many updates on a small sample as on a large one."""
        import numpy as np

        rng, labels = np.random.default_rng(seed), np.asarray(y, float)
        theta = np.zeros(len(self.w) + 1)
        m, s, t = np.zeros_like(theta), np.zeros_like(theta), 0
        for _ in range(max(1, round(updates * batch / len(labels)))):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                now = order[at : at + batch]
                places, seg = rows.places(now)
                idx, val = rows.flat[places] + 1, values[places]
                z = theta[0] + np.bincount(seg, theta[idx] * val, len(now))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[now]) / len(now)
                grad = np.bincount(idx, g[seg] * val, len(theta)) + decay * theta
                grad[0] = g.sum()
                t += 1
                m = 0.9 * m + 0.1 * grad
                s = 0.999 * s + 0.001 * grad**2
                theta = theta - step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.bias, self.w = float(theta[0]), theta[1:]
        return self

    def raw(self, rows: Rows, values):
        import numpy as np

        return self.bias + np.bincount(rows.row, self.w[rows.flat] * values, len(rows))

    def calibrate(self, z, y) -> None:
        """Scale (not below 0) and shift of the log-odds on documents that have not been learned from."""
        if (found := newton([z], y, [1.0, 0.0])) is not None:
            self.scale, self.shift = (float(found[0]), float(found[1])) if found[0] > 0 else (0.0, float(newton([], y, [0.0])[0]))

    def odds(self, z):
        import numpy as np

        return np.clip(self.scale * z + self.shift, -30, 30)


def newton(columns: list, y, start: list[float]):
    """Weights and bias of a small logistic regression, held to ``start`` by a unit ridge; None without labels of both kinds."""
    import numpy as np

    labels = np.asarray(y, float)
    if not 0 < labels.sum() < len(labels):
        return None
    x, b0 = np.stack([*columns, np.ones(len(labels))], 1), np.array(start)
    loss = lambda b: (np.logaddexp(0, x @ b) - labels * (x @ b)).sum() + 0.5 * ((b - b0) ** 2).sum()
    b = b0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(b)), x.T @ (p - labels) + b - b0)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
    return b


class Batch:
    """Features of some documents as both views take them, from Arrow columns ``places, shares, page``."""

    def __init__(self, batch) -> None:
        import numpy as np

        def flat(name):
            c = batch.column(name)
            return c.combine_chunks() if hasattr(c, "combine_chunks") else c

        places, page = flat("places"), flat("page")
        self.content, self.values = Rows(places.flatten().to_numpy(), places.value_lengths().to_numpy()), flat("shares").flatten().to_numpy().astype(float)
        self.page = Rows(page.flatten().to_numpy(), page.value_lengths().to_numpy())
        self.ones = np.ones(len(self.page.flat))

    def views(self) -> list[tuple[Rows, object]]:
        return [(self.content, self.values), (self.page, self.ones)]

    def take(self, which) -> Batch:
        out = object.__new__(Batch)
        at, _ = self.content.places(which)
        out.content, out.values, out.page = self.content.take(which), self.values[at], self.page.take(which)
        out.ones = self.ones[: len(out.page.flat)]
        return out

    def joined(self, view: int, others: list[Batch]) -> tuple[Rows, object]:
        """One view of these documents and those of other batches."""
        import numpy as np

        parts = [b.views()[view] for b in [self, *others]]
        return Rows(np.concatenate([r.flat for r, _ in parts]), np.concatenate([r.sizes for r, _ in parts])), np.concatenate([v for _, v in parts])


class CoTrained:
    """Both views and their combination."""

    def __init__(self) -> None:
        self.models = [Logistic(BUCKETS + _MEASURES), Logistic(_PAGE)]
        self.weights = (0.5, 0.5, 0.0)
        self.trained, self.exchanged, self.prior = False, 0, 1.0

    def raw(self, batch: Batch) -> list:
        return [m.raw(*v) for m, v in zip(self.models, batch.views(), strict=True)]

    def calibrate(self, batch: Batch, y) -> None:
        for m, z in zip(self.models, self.raw(batch), strict=True):
            m.calibrate(z, y)

    def odds(self, batch: Batch) -> list:
        return [m.odds(z) for m, z in zip(self.models, self.raw(batch), strict=True)]

    def combine(self, batch: Batch, y) -> None:
        """Weigh the calibrated views on documents that they have not learned from; no weight is below 0."""
        a, b = self.odds(batch)
        for columns, start, of in (([a, b], [0.5, 0.5, 0.0], lambda f: f), ([a], [1.0, 0.0], lambda f: (f[0], 0.0, f[1])), ([b], [1.0, 0.0], lambda f: (0.0, *f))):
            found = newton(columns, y, start)
            if found is not None and min(found[:-1]) >= 0:
                self.weights = tuple(float(w) for w in of(found))
                return

    def scores(self, batch: Batch) -> list:
        """Of each document: content score, page score and both combined."""
        import numpy as np

        if not self.trained:
            return [np.full(len(batch.page), 1 / (1 + np.exp(-self.prior)))] * 3
        a, b = self.odds(batch)
        u, v, c = self.weights
        return [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, u * a + v * b + c)]


def features(df: DataFrame) -> DataFrame:
    """``doc_id, places, shares, page`` of every row, stored in the shared folder."""
    use_checkpoints(df.sparkSession)
    types = {"text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    docs = df.select("doc_id", *((F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = per_row(docs, ["doc_id", *COLUMNS], lambda: lambda i, t, *page: (i, *content_features(t), page_features(*page)), f"doc_id {kind}, places array<int>, shares array<float>, page array<int>")
    return stored(made, "quality-features")


def _per_batch(found: DataFrame, fn, fields: str) -> DataFrame:
    """``doc_id`` and what ``fn(batch)`` gives, in columns of doubles."""
    spark = found.sparkSession
    bound_batches(spark)
    target = spark.createDataFrame([], f"doc_id {found.schema['doc_id'].dataType.simpleString()}, {fields}").schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in fn(Batch(batch)))], schema=out)

    return found.select("doc_id", "places", "shares", "page").mapInArrow(run, target)


def _chosen(found: DataFrame, ids: DataFrame, numbers: int):
    """The documents of ``ids`` (bounded by its caller) as an Arrow table in the order of ids, one for each, bounded in features."""
    rows = found.join(F.broadcast(ids), "doc_id")
    names = [c for c in rows.columns if c != "doc_id"]
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.xxhash64("places", "shares", "page")).alias("r")).select("doc_id", "r.*").checkpoint()
    return within(one, "places", numbers).orderBy("doc_id").toArrow()


def fit(found: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, grow: int = GROW, numbers: int = NUMBERS) -> CoTrained:
    """Learn from ``features``: from a bounded sample of labelled documents that are not held out, and from all unlabelled ones."""
    import numpy as np

    spark, model = found.sparkSession, CoTrained()
    half = numbers // 2
    got = _chosen(found, labelled_ids(labels, label, labelled), half)
    y, part, known = got["y"].to_numpy(), got["fold"].to_numpy(), Batch(got)
    learn, held = np.flatnonzero(part != 1), np.flatnonzero(part == 1)
    if len(set(y[learn].tolist())) < 2:
        return model
    share, sample, kept_back = float(y[learn].mean()), known.take(learn), known.take(held)
    base = np.log(share / (1 - share))
    low, high = max(1, round(grow * (1 - share))), max(1, round(grow * share))
    settled = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id")
    kind = found.schema["doc_id"].dataType.simpleString()
    given: list[list[tuple]] = [[], []]  # to each view: (ids, labels, documents) of each round
    for done in range(rounds + 1):
        for v, m in enumerate(model.models):
            labels_now = np.concatenate([y[learn], *(g[1] for g in given[v])])
            m.fit(*sample.joined(v, [g[2] for g in given[v]]), labels_now)
        model.calibrate(kept_back, y[held])  # so that a view which tells little is sure of little
        if done == rounds:
            break
        shipped = spark.sparkContext.broadcast(model)
        scored = _per_batch(found, lambda b, shipped=shipped: shipped.value.odds(b), "content double, page double")
        open_ = scored.where("doc_id is not null").join(settled, "doc_id", "left_anti").checkpoint()
        for v, column in enumerate(("content", "page")):
            taken = [(i,) for g in given[1 - v] for i in g[0]]  # bounded by rounds and grow
            rest = open_.join(F.broadcast(spark.createDataFrame(taken, f"doc_id {kind}")), "doc_id", "left_anti") if taken else open_
            sure = rest.where(F.col(column) < float(min(0.0, base) - SURE)).orderBy(column, "doc_id").limit(low).select("doc_id", F.lit(0).alias("y"))
            sure = sure.union(rest.where(F.col(column) > float(max(0.0, base) + SURE)).orderBy(F.desc(column), "doc_id").limit(high).select("doc_id", F.lit(1).alias("y")))
            new = _chosen(found, sure.groupBy("doc_id").agg(F.min("y").alias("y")), half // max(1, 2 * rounds))
            if new.num_rows:
                given[1 - v].append((new["doc_id"].to_pylist(), new["y"].to_numpy().astype(float), Batch(new)))
    model.combine(kept_back, y[held])
    model.trained, model.exchanged = True, sum(len(g[0]) for gs in given for g in gs)
    return model


def score(found: DataFrame, model: CoTrained) -> DataFrame:
    """``doc_id, held_out, content_score, page_score, score, kept`` for every row of ``features``."""
    shipped = found.sparkSession.sparkContext.broadcast(model)
    scored = _per_batch(found, lambda b: shipped.value.scores(b), "content_score double, page_score double, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "content_score", "page_score", "score", (F.col("score") >= 0.5).alias("kept"))
