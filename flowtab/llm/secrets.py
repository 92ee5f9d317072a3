"""Secret scans with multipart credential linking.

A scan of each text finds parts. Certain parts (assignments, access identifiers, long hex runs) are reported
as they are. Weak parts say nothing alone: an address or a host (endpoint), a run of 20 or more mixed
base64 characters (opaque), a user, client or account name (account), a value of 8 or more characters after the name of a key or pass phrase that the
base pattern does not know (named). A weak part is reported only where a
complementary part lies within the same scope: at most ``scope`` code points between the end of one and the start of the other,
or overlapping. That is an interval join of ``[start - scope, end + scope]`` with ``[start, end]``. It is done on places binned by
the scope's width: a part enters each bin that its span covers, and a bin's first start and last end of each kind, aggregated
before the shuffle, tell whether a partner is in reach. So each weak part meets one row for each kind and bin, however many parts
a document has.

Only documents with a weak part take part in the joins; rows of one id and text are dealt to several tasks. ``redact`` replaces spans in the
batches that scan them; texts with a weak part, which wait for the join's answer, are split off, and no other text moves. Both branches scan, so
``redact`` scans each text twice.

Edge cases. Null and empty texts have no spans. Very long texts are scanned whole, in time linear in their length and
their spans. Overlapping kinds are all reported; ties (spans of one start) go by kind as listed, then by end. Repeated rows of one
id and text are one scope and give equal rows; rows of one id with different texts are kept apart. An empty table gives an
empty result. Only the named columns are read, ``redact`` keeps all, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, columns_of, per_row, row_key, salted_left, stored, use_checkpoints

SCOPE = 200
#: Base kinds, in the order in which spans of one start are listed; weak kinds come after them.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "endpoint", "opaque", "account", "named")
#: For each weak kind: the kinds of which one has to be in its scope.
COMPLEMENT = {
    "endpoint": ("assign", "access", "opaque", "named"),
    "opaque": ("access", "endpoint", "account"),
    "account": ("assign", "opaque", "hex", "named"),
    "named": ("access", "endpoint", "account"),
}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer is dropped anyway
_ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", re.I | re.A)
_ADDRESS = re.compile(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}\b", re.A)
_HOST = re.compile(r"""(?<![A-Za-z])(?:host(?:name)?|server|endpoint)["']?\x20*[:=]\x20*["']?[a-z0-9][a-z0-9-]*(?:\.[a-z0-9][a-z0-9-]*)+(?::[0-9]{2,5})?""", re.I | re.A)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}={0,2}")
_MIX = [re.compile(c) for c in ("[0-9]", "[A-Z]", "[a-z]")]
_ACCOUNT = re.compile(r"""(?<![A-Za-z])(?:user(?:name|_?id)?|login|e?mail|account_?(?:id|name)|client_?id|tenant_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
_NAMED = re.compile(
    r"""(?<![A-Za-z])(?:secret_?access_?key|access_?key(?:_?secret)?|private_?key|(?:auth|account|shared|secret)_?key|pass(?:phrase|code)?|pwd|credentials?)["']?\x20*[:=]\x20*["']?([^\s"'<>,;&]{8,})""",
    re.I | re.A,
)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all parts, by start, then kind as listed, then end."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:  # what all of these need
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        found += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
        found += [("named", *m.span()) for m in _NAMED.finditer(text)]
        found += [("endpoint", *m.span()) for m in _HOST.finditer(text)]
        if "://" in text:
            found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
        found += [("endpoint", *m.span()) for m in _ADDRESS.finditer(text)]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    # What stands in a certain span is no part of its own.
    starts, ends = [], []
    for a, b in sorted((a, b) for k, a, b in found if k in BASE):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for m in _OPAQUE.finditer(text):
        if all(c.search(m[0]) for c in _MIX):
            before = bisect_right(starts, m.end() - 1) - 1  # the last certain stretch that begins within or before the run
            if before < 0 or ends[before] <= m.start():
                found.append(("opaque", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with ``[kind]`` for each span, spans ordered by start; overlapping ones are replaced as one, by the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind string, start bigint, end bigint>>"


def _weak(spans: Column) -> Column:
    """Whether there is a weak part that may have a partner."""
    return F.exists(spans, lambda s: ~s["kind"].isin(*BASE)) & (F.size(spans) > 1)


def parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, row_key, spans array<struct<kind, start, end>>``, weak ones included."""
    source = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return per_row(
        source.withColumn("k", row_key(F.col("t"))),
        ["i", "k", "t"],
        lambda: lambda i, k, t: (i, k, [dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t)]),
        f"doc_id {source.schema['i'].dataType.simpleString()}, row_key binary, spans {_SPANS}",
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of ``parts`` that have a complement in their scope: ``doc_id, row_key, kind, start, end``."""
    flat = found.where(_weak(F.col("spans"))).select("doc_id", "row_key", F.explode("spans").alias("s")).select("doc_id", "row_key", "s.*").distinct()
    bin_of = lambda place: F.floor(place / scope)
    covered = F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end")))).alias("bin")
    bins = flat.select("doc_id", "row_key", "kind", "start", "end", covered).groupBy("doc_id", "row_key", "bin", "kind").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    wanted = F.create_map(*(x for k, v in COMPLEMENT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    weak = flat.where(~F.col("kind").isin(*BASE)).select(
        F.col("doc_id").alias("d"), F.col("row_key").alias("r"), "kind", "start", "end", (F.col("start") - scope).alias("from"), (F.col("end") + scope).alias("to"), F.explode(wanted[F.col("kind")]).alias("partner")
    )
    probes = weak.withColumn("at", F.explode(F.sequence(bin_of(F.col("from")), bin_of(F.col("to")))))
    met = probes.alias("p").join(
        bins.alias("q"),
        F.col("p.d").eqNullSafe(F.col("q.doc_id"))
        & (F.col("p.r") == F.col("q.row_key"))
        & (F.col("p.at") == F.col("q.bin"))
        & (F.col("p.partner") == F.col("q.kind"))
        # In a bin amid the reach any partner is in it; the first and the last bin, never one and the same, are covered in part.
        & F.when(F.col("p.at") == bin_of(F.col("p.from")), F.col("q.last") >= F.col("p.from"))
        .when(F.col("p.at") == bin_of(F.col("p.to")), F.col("q.first") <= F.col("p.to"))
        .otherwise(True),
        "left_semi",
    )
    return met.select(F.col("d").alias("doc_id"), F.col("r").alias("row_key"), "kind", "start", "end").distinct()


def credentials(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row: ``doc_id, row_key, spans``: base spans and linked weak ones, ordered."""
    use_checkpoints(df.sparkSession)
    return _reported(parts(df, id_col, text_col).checkpoint(), scope)  # one scan of the texts for both uses


def _asked(rows: DataFrame, answer: DataFrame) -> DataFrame:
    """Left join of rows ``__ft_pair`` with their answer: repeated rows are dealt to several tasks."""
    return salted_left(rows, answer, "__ft_pair", "__ft_answer", F.xxhash64(F.monotonically_increasing_id()))


def _reported(found: DataFrame, scope: int) -> DataFrame:
    """``parts`` with the spans to report, in order."""
    pair = F.struct(F.col("doc_id").alias("i"), F.col("row_key").alias("k"))
    extra = linked(found, scope).groupBy(pair.alias("__ft_answer")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    base = found.withColumns({"__ft_pair": pair, "weak": _weak(F.col("spans")), "spans": F.filter("spans", lambda s: s["kind"].isin(*BASE))})
    none = F.lit(None).cast(extra.schema["more"].dataType).alias("more")
    kept = ["doc_id", "row_key", "spans", "more"]
    joined = _asked(base.where("weak"), extra).select(*kept).union(base.where("not weak").select("doc_id", "row_key", "spans", none))
    order = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        F.array_sort(
            F.transform(
                F.concat("spans", F.coalesce("more", F.filter("spans", lambda s: F.lit(False)))),
                lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
            )
        ),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return joined.select("doc_id", "row_key", spans.alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``df`` with each reported span replaced by ``[kind]``; overlapping spans are replaced as one, by the first.

    All rows and columns stay. Texts without weak parts are redacted where they are scanned; the few with some are stored with their
    parts, and redacted after the join.
    """
    spark = df.sparkSession
    bound_batches(spark)
    use_checkpoints(spark)
    text = columns_of(df)[df.columns.index(text_col)]

    @F.pandas_udf(f"parts {_SPANS}, plain string")
    def scanned(texts):
        """The parts, and the text without its certain spans: what stays of a text that waits for no answer."""
        import pandas as pd

        found = [scan(t) for t in texts]
        parts = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in found]
        plain = [replaced(t, [s for s in spans if s[0] in BASE]) if spans else t for t, spans in zip(texts, found, strict=True)]
        return pd.DataFrame({"parts": parts, "plain": plain})

    @F.pandas_udf("string")
    def cleaned(texts, spans):
        import pandas as pd

        return pd.Series([replaced(t, [(x["kind"], x["start"], x["end"]) for x in s]) if t is not None and s is not None and len(s) else t for t, s in zip(texts, spans, strict=True)])

    # A filter on what a scan gives must not scan a second time. One worker for each task: the plain text comes with the parts.
    found = df.withColumn("__ft_scan", scanned.asNondeterministic()(text)).withColumns({"__ft_parts": F.col("__ft_scan.parts"), "__ft_plain": F.col("__ft_scan.plain")}).drop("__ft_scan")
    # A weak part alone has no partner either.
    plain = found.where(~_weak(F.col("__ft_parts"))).withColumn(text_col, F.col("__ft_plain"))
    waiting = stored(found.where(_weak(F.col("__ft_parts"))).drop("__ft_plain").withColumn("__ft_row", row_key(text)), "weak-parts")
    ids = columns_of(df)[df.columns.index(id_col)]
    answer = _reported(waiting.select(ids.alias("doc_id"), F.col("__ft_row").alias("row_key"), F.col("__ft_parts").alias("spans")).dropDuplicates(["doc_id", "row_key"]), scope)
    answer = answer.select(F.struct(F.col("doc_id").alias("i"), F.col("row_key").alias("k")).alias("__ft_answer"), F.col("spans").alias("__ft_spans"))
    met = _asked(waiting.withColumn("__ft_pair", F.struct(ids.alias("i"), F.col("__ft_row").alias("k"))), answer)
    linked_too = met.withColumn(text_col, cleaned(text, F.col("__ft_spans")))
    return plain.select(*columns_of(df)).union(linked_too.select(*columns_of(df)))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row."""
    spelt = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return credentials(df, id_col, text_col, scope).select("doc_id", *map(count, BASE), F.sha2(spelt(base), 256).alias("base_sha256"), spelt(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of base spans, spelt as above; for tests and callers outside Spark."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE).encode()).hexdigest()
