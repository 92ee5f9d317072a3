"""Quality rules, lines first: failing lines go, then documents that lose too much.

Base counts are taken over the whole text. Then each line with a word is held against the rules, in this
order: navigation (two or more bars, or an arrow between words), boilerplate (a phrase of ``BOILERPLATE``), signs (more than
one of ``#*$%&|<>`` for four words), shouting (more capitals than small letters, at least 10 letters), punctuation (a line of
``LONG`` or more words that neither ends in a closing sign nor has a sentence's end in it, as a cut-off paragraph has). A document is rejected where the base rule fails or more
than ``LOST`` percent of its words stand in failing lines.

Edge cases. Null and empty texts have no words, and so fail the base rule. Very long texts are seen whole, in time and memory linear
in their words. A line that fails several rules goes by the first; a document that loses exactly ``LOST`` percent (tie) is kept.
Repeated rows get equal rows. An empty table gives an empty result. Only doc_id and text are read, so others may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import per_row

BOILERPLATE = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions", "click here",
    "read more", "learn more", "continue reading", "back to top", "skip to content", "skip to main content", "skip navigation",
    "enable javascript", "javascript is disabled", "uses cookies", "use cookies", "accept cookies", "accept all cookies", "cookie settings",
    "lorem ipsum", "sign up for our newsletter", "subscribe to our newsletter", "subscribe now", "sign in to", "log in to", "create an account",
    "forgot your password", "follow us on", "share this", "share on facebook", "share on twitter", "add to cart", "add to basket", "leave a comment",
    "leave a reply", "post a comment", "related posts", "related articles", "powered by wordpress", "page not found", "previous post", "next post",
    "posted in", "filed under", "tagged with", "print this page", "email this", "advertisement",
]
LOST, LONG = 50, 4
RULES = ("navigation", "boilerplate", "signs", "shouting", "punctuation")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[#*$%&|<>]")
_ARROW = re.compile(r" (?:>|»|→|::) ")
_PHRASE = re.compile("|".join(BOILERPLATE), re.I | re.A)
_CLOSED = re.compile(r"[.!?:;…\"'”’»)\]][ \t\r]*\Z")
_SENTENCE = re.compile(r"[.!?][ \t]")
_CAPITAL, _SMALL = re.compile("[A-Z]"), re.compile("[a-z]")


def failing_rule(line: str, n_words: int, phrases: bool = True) -> str | None:
    """The first rule that a line with ``n_words`` words fails. ``phrases`` is false where its text is known to have none of ``BOILERPLATE``."""
    if line.count("|") >= 2 or _ARROW.search(line):
        return "navigation"
    if phrases and _PHRASE.search(line):
        return "boilerplate"
    if 4 * len(_SIGN.findall(line)) > n_words:
        return "signs"
    if not line.islower():
        capitals = len(_CAPITAL.findall(line))
        if capitals >= 5 and capitals > (small := len(_SMALL.findall(line))) and capitals + small >= 10:
            return "shouting"
    if n_words >= LONG and not _CLOSED.search(line) and not _SENTENCE.search(line):
        return "punctuation"
    return None


def repeated_words(words: list[str]) -> int:
    """Words within 3-word windows that occur twice or more."""
    import numpy as np

    if len(words) < 4:
        return 0
    codes: dict[str, int] = {}
    at = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    pairs = at[:-1] * len(codes) + at[1:]
    if len(codes) < 1 << 20:
        keys = pairs[:-1] * len(codes) + at[2:]
    else:
        keys = np.unique(pairs, return_inverse=True)[1][:-1].astype(np.int64) * len(codes) + at[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def clean(text: str | None) -> tuple[dict, list[str]]:
    """All measures of a text, and the lines that stay."""
    text = text or ""
    words = _WORD.findall(text)
    seen, kept, dup, lost, failed = set(), [], 0, 0, 0
    low = text.lower()  # also makes some other letters ASCII ones, so that it may have a phrase that no line has, but never the other way
    phrases = any(p in low for p in BOILERPLATE)
    for line in text.split("\n"):
        n = len(_WORD.findall(line))
        if not n:
            kept.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if failing_rule(line, n, phrases):
            lost, failed = lost + n, failed + 1
        else:
            kept.append(line)
    repeat = repeated_words(words)
    base_failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(_SIGN.findall(text)), "n_dup_lines": dup, "n_repeat_words": repeat,
        "base_failed": base_failed, "kept": not base_failed and 100 * lost <= LOST * len(words), "n_failed_lines": failed, "n_lost_words": lost,
    }, kept


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_failed_lines bigint, n_lost_words bigint"


def measures(df: DataFrame) -> DataFrame:
    """One row per row of ``df``: ``doc_id`` and ``FIELDS``."""
    kind = df.select("doc_id").schema[0].dataType.simpleString()
    return per_row(df, ["doc_id", "text"], lambda: lambda i, t: (i, *clean(t)[0].values()), f"doc_id {kind}, {FIELDS}")


def cleaned(df: DataFrame) -> DataFrame:
    """``doc_id, text, kept``: the lines that stay, and the verdict on the document."""

    def one(i, text):
        found, lines = clean(text)
        return i, "\n".join(lines), found["kept"]

    kind = df.select("doc_id").schema[0].dataType.simpleString()
    return per_row(df, ["doc_id", "text"], lambda: one, f"doc_id {kind}, text string, kept boolean")


_W = r"[^\x20\x09-\x0D]+"
SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM t, UNNEST(range(1, greatest(1, len(w) - 1))) AS u(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, UNNEST([0, 1, 2]) AS u(k) GROUP BY doc_id),
l AS (SELECT doc_id, place, line, len(regexp_extract_all(line, '{_W}')) AS n FROM (
        SELECT doc_id, i AS place, string_split(text, chr(10))[i + 1] AS line FROM t, UNNEST(range(len(string_split(text, chr(10))))) AS u(i))),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) > 1 AS dup,
        len(regexp_replace(line, '[^|]', '', 'g')) >= 2 OR regexp_matches(line, ' (?:>|»|→|::) ')
        OR regexp_matches(line, '(?i){"|".join(BOILERPLATE)}')
        OR 4 * len(regexp_extract_all(line, '[#*$%&|<>]')) > n
        OR (len(regexp_extract_all(line, '[A-Z]')) >= 5 AND len(regexp_extract_all(line, '[A-Z]')) > len(regexp_extract_all(line, '[a-z]'))
            AND len(regexp_extract_all(line, '[A-Za-z]')) >= 10)
        OR (n >= {LONG} AND NOT regexp_matches(line, '[.!?:;…"''”’»)\\]][ \\t\\r]*$') AND NOT regexp_matches(line, '[.!?][ \\t]')) AS failed
      FROM l WHERE n > 0),
g AS (SELECT doc_id, count(*) FILTER (dup) AS dups, count(*) FILTER (failed) AS failed, coalesce(sum(n) FILTER (failed), 0) AS lost FROM m GROUP BY doc_id),
c AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(failed, 0)::BIGINT AS n_failed_lines, coalesce(lost, 0)::BIGINT AS n_lost_words
      FROM t LEFT JOIN cov USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= {LOST} * n_words AS kept,
       n_failed_lines, n_lost_words
FROM c
"""
