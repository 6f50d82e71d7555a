"""Line-first cleaning, in column expressions only.

Each line with a word is judged by itself: punctuation (does a clause or sentence end in it, without shouting),
navigation (separators between menu entries) and boilerplate (fixed phrases, symbol runs). Failing lines are
removed; a document that loses more than MOST_LOST of its characters is rejected, as is one that fails the base
rule on its words. Null and empty texts have no words and fail the base rule. Repeated rows get equal verdicts.
An empty table gives an empty result. A very long text is judged whole, as arrays of its words and lines in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import SPACE, let, unused

#: Phrases of page furniture (fixed values of the rule).
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for",
    "skip to content",
    "subscribe to",
    "terms of use",
)
SYMBOLS = "[#*$%&|<>]"
#: Share of the characters that failing lines may take.
MOST_LOST = 0.4
LEAST_WORDS = 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, in one pass over the sorted windows of a row."""

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def runs(p: Column) -> Column:
            found = F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        def total(starts: Column) -> Column:
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
            step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).cast("long").alias("n"), x.alias("last"))
            return F.aggregate(starts, zero, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(total(let(pairs, runs)))

    return let(let(words, windows), covered)


def line_fails(line: Column) -> Column:
    """Whether a line that has a word is to go."""
    n_words = F.greatest(F.regexp_count(line, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(1))
    unpunctuated = ~line.rlike("[.!?…:;,。！？]['\"”’»)\\]]*(" + SPACE + "|$)")
    shouting = 4 * F.regexp_count(line, F.lit("!")) > n_words
    navigation = 5 * F.regexp_count(line, F.lit("[|»›•·]")) > n_words
    symbols = 10 * F.regexp_count(line, F.lit(SYMBOLS)) > n_words
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE))
    return unpunctuated | shouting | navigation | symbols | boilerplate


def judged(docs: DataFrame, text: str = "text", into: str = "_rules") -> DataFrame:
    """`docs` with a struct column `into` (which replaces one of that name): counts, the cleaned text and the verdict."""
    on_word, on_line = unused(docs, "_words", "_lines")
    whole = F.coalesce(F.col(text), F.lit(""))

    def on_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def on_lines(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        kept = F.filter(lines, lambda x: ~(x.rlike("[^\\x20\\x09-\\x0D]") & line_fails(x)))
        return F.struct(
            let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            F.array_join(kept, "\n").alias("clean_text"),
        )

    found = docs.withColumn(on_word, let(words_of(whole), on_words)).withColumn(on_line, let(F.split(whole, "\n"), on_lines))
    removed = F.length(whole) - F.length(f"{on_line}.clean_text")
    n_words, n_repeated = F.col(f"{on_word}.n_words"), F.col(f"{on_word}.n_repeat_words")
    base_failed = (n_words < LEAST_WORDS) | (100 * n_repeated > 50 * n_words)
    rules = F.struct(
        n_words.alias("n_words"),
        F.length(F.regexp_replace(whole, SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.col(f"{on_line}.n_dup_lines"),
        n_repeated.alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & (removed <= MOST_LOST * F.length(whole))).alias("kept"),
        F.col(f"{on_line}.clean_text"),
    )
    return found.withColumn(into, rules).drop(on_word, on_line)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What query op4 returns."""
    found = judged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *(F.col(f"_rules.{n}").alias(n) for n in names))


_CLASS = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
),
w AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(text, '{_CLASS}') AS ws FROM d)
),
wins AS (
  SELECT r, i, word AS a, lead(word, 1) OVER (PARTITION BY r ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM w
),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM wins WHERE c IS NOT NULL) WHERE n > 1
),
reps AS (
  SELECT r, sum(least(3, i - coalesce(last_i, i - 3))) AS n
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS last_i FROM again) GROUP BY r
),
counts AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
judged AS (
  SELECT r, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded,
    greatest(len(regexp_extract_all(line, '{_CLASS}')), 1) AS n,
    len(regexp_extract_all(line, '!')) AS bangs,
    len(regexp_extract_all(line, '[|»›•·]')) AS seps,
    len(regexp_extract_all(line, '{SYMBOLS}')) AS syms,
    regexp_matches(line, '[.!?…:;,。！？][''"”’»)\]]*([\x20\x09-\x0D]|$)') AS ends,
    regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') AS furniture
  FROM lines
),
kept_lines AS (
  SELECT r, sum(length(line)) + count(*) - 1 AS chars FROM judged
  WHERE NOT (worded AND (NOT ends OR 4 * bangs > n OR 5 * seps > n OR 10 * syms > n OR furniture)) GROUP BY r
),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM judged WHERE worded GROUP BY r),
rules AS (
  SELECT d.doc_id, d.text,
    coalesce(c.n_words, 0)::BIGINT AS n_words, coalesce(c.word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(d.text, '{SYMBOLS}'))::BIGINT AS n_symbols,
    coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(k.chars, 0) AS chars
  FROM d LEFT JOIN counts c USING (r) LEFT JOIN dups u USING (r) LEFT JOIN reps p USING (r) LEFT JOIN kept_lines k USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words)
    AND length(text) - chars <= {MOST_LOST}::DOUBLE * length(text) AS kept
FROM rules
"""
