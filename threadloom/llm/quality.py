"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``signals`` gives the measured columns of each text, ``RULES`` the table of bounds, ``verdict`` compiles the table into one
boolean expression. Everything stays in one projection over the scan: no shuffle, no Python.

Repeated windows are found by 64-bit hashes of three words within one document; only documents with a repeated hash sort
their windows by hash and position.

Defined cases: null and blank texts have no words and fail the base rule; windows need three words; lines are compared
whole, with their blanks; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, word_array

# Frequent function words of the languages in use.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "with", "be", "for", "on", "it", "as", "was", "are"],
    "de": ["der", "die", "und", "das", "den", "ist", "von", "mit", "zu", "auf", "für", "ein", "des", "im", "sich"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "que", "est", "pour", "dans", "en", "du", "au"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "del", "se", "para"],
}
#: measure, smallest and largest value that is let through (None: no bound)
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("mean_word_chars", 2, 14),
    ("symbol_ratio", None, 0.1),
    ("alpha_word_ratio", 0.7, None),
    ("n_stop_words", 2, None),
    ("dup_line_ratio", None, 0.3),
    ("repeat_word_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
]


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def repeat_words(words: Column, n: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the array, the first occurrence included."""
    windows = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.element_at(words, i + 2), F.element_at(words, i + 3)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        last = F.size(placed)

        def places(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            hit = F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        def length(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

        return F.when(last > 0, _let(placed, lambda s: _let(places(s), length))).otherwise(0)

    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signals(docs: DataFrame) -> DataFrame:
    """``doc_id`` and all measures, for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stop = F.array(*(F.lit(w) for w in sorted({w for x in STOP_WORDS.values() for w in x})))
    base = docs.select(F.col("doc_id"), text.alias("text")).select(
        "doc_id", "text",
        word_array(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("text", WORD_BREAK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    counted = base.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), F.size("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*\p{L}")).cast("long").alias("n_alpha_words"),
        F.size(F.array_intersect(F.transform("words", lambda w: F.lower(w)), stop)).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(…|\.\.\.)\s*$"))).cast("long").alias("n_ellipsis_lines"),
    )
    return counted.select(
        "*",
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        _ratio(F.col("n_alpha_words"), F.col("n_words")).alias("alpha_word_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_word_ratio"),
        _ratio(F.col("n_bullet_lines"), F.col("n_lines")).alias("bullet_line_ratio"),
        _ratio(F.col("n_ellipsis_lines"), F.col("n_lines")).alias("ellipsis_line_ratio"),
    )


def verdict(rules=RULES) -> Column:
    """The table as one expression: true if no measure is out of bounds."""
    kept = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            kept = kept & (F.col(name) >= least)
        if most is not None:
            kept = kept & (F.col(name) <= most)
    return kept


def quality_rows(docs: DataFrame, rules=RULES) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = signals(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, row_number() OVER () AS rid
  FROM documents
), g AS (
  SELECT rid, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1
  ) GROUP BY rid
), b AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(ls) AS n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_alpha,
         len(list_filter(list_distinct(list_transform(ws, lambda x: lower(x))), lambda x: list_contains({STOP}, x))) AS n_stop,
         len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet, len(list_filter(ls, lambda x: regexp_matches(x, '(…|\.\.\.)\s*$'))) AS n_dots
  FROM w LEFT JOIN r USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars BETWEEN 2 * n_words AND 14 * n_words AND n_symbols <= 0.1 * n_words
       AND n_alpha >= 0.7 * n_words AND n_stop >= 2 AND n_dup_lines <= 0.3 * n_lines AND n_repeat_words <= 0.3 * n_words
       AND n_bullet <= 0.9 * n_lines AND n_dots <= 0.3 * n_lines AS kept
FROM b
""".replace("{STOP}", str(sorted({w for x in STOP_WORDS.values() for w in x})))
