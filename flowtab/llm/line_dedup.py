"""Line dedup by a log-template tree of fixed depth.

A line is parsed by its token count, then by its ``LEAD`` leading tokens; tokens with a digit are variable
fields there and everywhere. Below that leaf, the rest of the line is cut into ``PARTS`` parts, and lines that
agree in all but one part share the template in which that part is a variable field. (Lines of fewer than
``2 * LEAD`` tokens have one template, their masked tokens.) A template recurs if it stands in ``least`` or more
different texts, or in two and has ``long`` or more tokens, which is no chance. Its lines are dropped from all texts but the
first, by smallest id, that holds it; a text of such lines alone is empty thereafter.

Equal texts are treated as one, so exact copies stay exact copies, for near-dedup to decide on. Texts are told apart by a 64-bit
hash; where different texts have one (a second hash, of another seed, tells), these keep all their lines.

Edge cases. A null text is one empty line and stays null. Blank lines, and lines of variable fields alone (rows of numbers), never
recur. Texts of any length are worked on as arrays of lines, in time linear in them. Null ids come last when the first text is
sought; ties between texts of one id go by the texts' hash. Repeated rows get equal results. An empty table gives an empty result.
``df`` may have further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, columns_of, key_filter, may_hold, salted_left, stored, use_checkpoints

LEAD, PARTS = 4, 4
#: Texts from which on a template recurs, and tokens from which on it does so from two.
LEAST_TEXTS, LONG = 3, 20
FIELD = "<*>"


def tokens(line: Column) -> Column:
    """Tokens between spaces; those with a digit are ``<*>``."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(line)
    return F.array_remove(F.split(masked, " "), "")


def signatures(words: Column) -> Column:
    """The hashes of a line's templates: one for each part that may vary."""
    n, tail = F.size(words), F.size(words) - LEAD

    def without(k: int) -> Column:
        begin, end = F.floor(tail * k / PARTS).cast("int"), F.floor(tail * (k + 1) / PARTS).cast("int")
        return F.xxhash64(F.lit(k), n, F.slice(words, 1, begin + LEAD), F.slice(words, end + LEAD + 1, n))

    whole = F.array(F.xxhash64(F.lit(-1), n, words))
    return F.when(F.size(F.array_remove(words, FIELD)) == 0, F.array().cast("array<bigint>")).when(n < 2 * LEAD, whole).otherwise(F.array(*map(without, range(PARTS))))


def _keys(text: Column) -> list[Column]:
    """Two hashes of a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def recurring(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_TEXTS, long: int = LONG) -> DataFrame:
    """Per text with lines to drop: ``row_key`` (its hash) and ``places`` (of the lines, from 0)."""
    use_checkpoints(df.sparkSession)
    texts = df.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    key, check = _keys(F.col("t"))
    lines = (
        texts.select("i", key.alias("row_key"), check.alias("check"), F.posexplode(F.split("t", "\n")).alias("place", "line"))
        .select("i", "row_key", "check", "place", tokens(F.col("line")).alias("w"))
        .select("i", "row_key", "check", "place", F.size("w").alias("n"), signatures(F.col("w")).alias("s"))
    )
    # Hashes and counts only: the texts are parsed once. (A filter on "s" here would be pushed down with all it is made of.)
    lines = stored(lines, "lines")
    each = lines.select("i", "row_key", "n", F.explode("s").alias("s")).groupBy("s", "row_key").agg(F.min("i").alias("i"), F.max("n").alias("tokens"))
    first = F.struct(F.col("i").isNull().alias("n"), F.col("i").alias("i"), F.col("row_key").alias("k"))
    # A template's lines have one token count, which is part of its hash.
    often = (F.col("texts") >= least) | ((F.col("texts") >= 2) & (F.col("tokens") >= long))
    templates = each.groupBy("s").agg(F.count("*").alias("texts"), F.min(first).alias("first"), F.max("tokens").alias("tokens")).where(often).select(F.col("s").alias("t"), F.col("first.k").alias("owner"))
    flat = lines.select("row_key", "place", F.explode("s").alias("s"))
    met = salted_left(flat, templates, "s", "t", F.xxhash64("row_key", "place")).where("owner != row_key")
    found = met.groupBy("row_key").agg(F.collect_set("place").alias("places"))
    # Every text has a first line, so these are all.
    two = lines.where("place = 0").groupBy(F.col("row_key").alias("k")).agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a < b")
    return found.join(two, F.col("row_key") == F.col("k"), "left_anti")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_TEXTS, long: int = LONG, counts: bool = False, most_bits: int = FILTER_BITS, keep_whole: bool = False) -> DataFrame:
    """``df`` without recurring lines in the text column; all rows and columns stay.

    With ``counts`` two columns are added, ``n_lines`` and ``n_dropped``; columns of ``df`` with these names are replaced.
    ``most_bits`` bounds the filter that tells which texts lose lines; with 0 all go by the join, with the same result.
    With ``keep_whole`` a text that would lose all its words stays as it is: a copy as a whole, for near-dedup to decide on.
    """
    text = columns_of(df)[df.columns.index(text_col)]
    found = recurring(df, id_col, text_col, least, long).toDF("__ft_key", "__ft_places").checkpoint()
    key, _ = _keys(F.coalesce(text, F.lit("")))
    keyed = df.withColumn("__ft_row", key)
    known = key_filter(found, "__ft_key", most_bits)
    # Texts that lose nothing need not move to the places; where the texts that do are too many for a filter, all move.
    hit = F.lit(True) if known is None else may_hold(known, F.col("__ft_row"))
    met = salted_left(keyed.where(hit), found, "__ft_row", "__ft_key", F.xxhash64(columns_of(df)[df.columns.index(id_col)]))
    whole = keyed.where(~hit).withColumn("__ft_places", F.lit(None).cast("array<int>"))
    lines, places = F.split(text, "\n"), F.col("__ft_places")
    # A set difference of places, so that the time is linear in the lines, however many are dropped.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    kept = F.transform(F.array(F.struct(lines.alias("l"), left.alias("k"))), lambda s: F.array_join(F.transform(s["k"], lambda k: s["l"][k]), "\n"))[0]
    names = ["n_lines", "n_dropped"] if counts else []

    def finished(rows: DataFrame) -> DataFrame:
        if keep_whole:
            rows = rows.withColumn("__ft_places", F.when(kept.rlike("[^ \n]"), places))
        if counts:
            rows = rows.withColumns({"n_lines": F.when(text.isNull(), 1).otherwise(F.size(lines)).cast("bigint"), "n_dropped": F.coalesce(F.size(places), F.lit(0)).cast("bigint")})
        rows = rows.withColumn(text_col, F.when(places.isNull() | text.isNull(), text).otherwise(kept))
        return rows.select(*(c for c, n in zip(columns_of(df), df.columns, strict=True) if n not in names), *names)

    return finished(met) if known is None else finished(met).union(finished(whole))


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, i AS place, string_split(text, chr(10))[i + 1] AS line
      FROM t, UNNEST(range(len(string_split(text, chr(10))))) AS u(i)),
w AS (SELECT doc_id, text, place,
             list_filter(string_split(regexp_replace(line, '[^ ]*[0-9][^ ]*', '{FIELD}', 'g'), ' '), lambda x: x <> '') AS w FROM l),
s AS (SELECT doc_id, text, place, len(w) AS n, k,
             CASE WHEN k < 0 THEN w ELSE list_concat(w[1 : {LEAD} + ((len(w) - {LEAD}) * k) // {PARTS}],
                                                     w[{LEAD} + ((len(w) - {LEAD}) * (k + 1)) // {PARTS} + 1 : len(w)]) END AS s
      FROM w, UNNEST(CASE WHEN len(list_filter(w, lambda x: x <> '{FIELD}')) = 0 THEN [] WHEN len(w) < {2 * LEAD} THEN [-1] ELSE range({PARTS}) END) AS u(k)),
r AS (SELECT n, k, s, arg_min(text, doc_id) AS owner FROM s GROUP BY n, k, s
      HAVING count(DISTINCT text) >= {LEAST_TEXTS} OR (count(DISTINCT text) >= 2 AND n >= {LONG})),
g AS (SELECT s.text, list(DISTINCT s.place) AS places
      FROM s JOIN r ON s.n = r.n AND s.k = r.k AND s.s = r.s WHERE r.owner <> s.text GROUP BY s.text),
d AS (SELECT t.doc_id, string_split(t.text, chr(10)) AS lines, g.places FROM t LEFT JOIN g ON t.text = g.text)
SELECT doc_id, len(lines) AS n_lines, coalesce(len(places), 0)::BIGINT AS n_dropped,
       md5(array_to_string([lines[i + 1] FOR i IN range(len(lines)) IF NOT coalesce(list_contains(places, i), false)], chr(10))) AS text_md5
FROM d
"""


def digests(df: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text_md5`` of the deduplicated texts (null: empty)."""
    return dedup_lines(df.select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
