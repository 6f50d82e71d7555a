"""Sentences: boundaries are found by one pattern whose look-arounds are the vetoes, so a text is split in one pass.

`sentences` is the "blocktext" dialect (a line end is a boundary), `sentences_offsets` the "offsets" dialect (a line
end is white space; each sentence keeps its place). Nulls give null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomtext.functions import rules
from loomtext.functions.normalize import quoted

LONGEST, FIRST_LONGEST = 320, 110
_CLOSERS = "[\"'”’)\\]]"


def _abbreviated(words: list[str]) -> str:
    """Look-behind: a whole abbreviation ends here, any full stops and spaces after it aside."""
    known = "|".join(quoted(w) for w in sorted(words, key=lambda w: (-len(w), w)) if " " not in w)
    return rf"(?<!(?<![A-Za-z])(?<![A-Za-z]\.)(?i:{known})[. ]{{0,3}})"


def boundary(abbreviations: list[str] | None = None) -> str:
    """What ends a sentence within a line: marks, closing quotes, white space; none after an initial, a list marker, an
    abbreviation or inside a number, nor after an ellipsis before a small letter. Vetoes are looked at where a mark is."""
    vetoes = (
        r"(?=[.!?…])(?<![.!?…])"  # marks are taken as one run
        r"(?<!(?:^|\s)[A-Za-z])"  # an initial, or a letter that marks a list
        r"(?<!^\s{0,9}\p{Nd}{1,9})"  # digits that mark a list
        + _abbreviated(abbreviations or rules.abbreviations())
        + r"(?!(?<=\p{Nd})\.\s\p{Nd})"  # a number that a space broke
    )
    return rf"{vetoes}[.!?…]++{_CLOSERS}*+(?!(?<=…{_CLOSERS}{{0,4}})\s+\p{{Ll}})(?!(?<=…[.!?…]{{1,4}}{_CLOSERS}{{0,4}})\s+\p{{Ll}})\s+"


def split_sentences(line: Column) -> Column:
    """The sentences of one line."""
    return F.filter(F.transform(pieces(line, boundary()), lambda s: F.btrim(s, F.lit(" \t\n\r\f\x0b"))), lambda s: s != "")


def pieces(text: Column, ends: str) -> Column:
    """A text cut behind each match of `ends`; the pieces add up to the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?sm).*?(?:{ends})|.+"), 0)


def capped(sentence: Column, limit: int = LONGEST) -> Column:
    """An array: the sentence, or clauses packed up to the limit and cut at the last space before it."""
    clauses = F.filter(F.split(sentence, r"(?<=[,;:—])\s+"), lambda c: c != "")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def pack(acc: Column, c: Column) -> Column:
        over = (acc["held"] != "") & (F.length(acc["held"]) + F.length(c) + 1 > limit)
        joined = F.when(acc["held"] == "", c).otherwise(F.concat(acc["held"], F.lit(" "), c))
        return F.struct(F.when(over, F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]).alias("out"), F.when(over, c).otherwise(joined).alias("held"))

    packed = F.aggregate(clauses, empty, pack, lambda a: F.when(a["held"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["held"]))))

    def cuts(piece: Column) -> Column:
        parts = F.regexp_extract_all(piece, F.lit(rf"(?s)\s*((?:.{{1,{limit}}}\z)|(?:.{{0,{limit - 1}}}(?= ))|(?:.{{1,{limit}}}))"), 1)
        return F.when(F.length(piece) <= limit, F.array(piece)).otherwise(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))

    return F.when(F.length(sentence) <= limit, F.array(sentence)).otherwise(F.flatten(F.transform(packed, cuts)))


def sentences(text: Column, longest: int = LONGEST, first_longest: int = FIRST_LONGEST) -> Column:
    """All segments of a text in order: sentences of each line, capped; those without a letter or digit go; the first is shorter."""
    trim = lambda s: F.btrim(s, F.lit(" \t\n\r\f\x0b"))
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")
    found = F.flatten(F.transform(lines, lambda x: F.flatten(F.transform(split_sentences(x), lambda s: capped(s, longest)))))
    kept = F.filter(found, lambda s: s.rlike(r"[\p{L}\p{N}]"))
    if not first_longest:
        return kept

    def shorten(all_: Column) -> Column:
        head = F.get(all_, F.lit(0))
        return F.when(F.length(head) > first_longest, F.concat(capped(head, first_longest), F.slice(all_, 2, 1 << 30))).otherwise(all_)

    return F.element_at(F.transform(F.array(kept), shorten), 1)


def _titles() -> list[str]:
    return sorted({a.lower() for k in ("titles", "military") for a in rules.ABBREVIATIONS[k]})


def _others() -> list[str]:
    return sorted(set(rules.abbreviations()) - set(_titles()))


def boundary_offsets() -> str:
    """The "offsets" dialect: titles never end a sentence, other abbreviations do before a capital or digit, so does an
    ellipsis; full-width marks count, and a single initial is a capital."""
    opens = "(?=\\s+[\"'“‘(\\[]?[A-ZÀ-Þ0-9])"
    maybe = _abbreviated(_others())
    return (
        r"(?=[.!?…。！？])(?<![.!?…。！？])(?<!(?:^|[^\p{L}\p{N}])[A-Z])(?<!^\s{0,9}\p{Nd}{1,9})"
        + _abbreviated(_titles())
        + rf"(?:{maybe}[.!?]++|(?!{maybe})[.!?]++(?=\s*{_CLOSERS}*){opens}|…++{opens}|[。！？]++)"
        + rf"{_CLOSERS}*+"
    )


@F.pandas_udf(ArrayType(IntegerType()))
def _running(sizes: pd.Series) -> pd.Series:
    """Sums of what stands before each element."""
    return sizes.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int64) - x)


def placed(parts: Column) -> Column:
    """An array of (piece, at) of pieces that make up a text, `at` counting characters; within the row, so nothing is shuffled."""
    starts = _running(F.transform(parts, lambda p: F.length(p)))
    return F.transform(F.arrays_zip(parts.alias("piece"), starts.alias("at")), lambda x: F.struct(x["piece"].alias("piece"), x["at"].alias("at")))


def split_long(sentence: Column, longest: int) -> Column:
    """A sentence in pieces of about `longest` characters: cut behind the last semicolon or colon that starts within them,
    else the last comma, else the last white space, else at the limit. The pieces add up to the sentence."""
    cuts = "|".join(rf".{{0,{longest - 1}}}{mark}\s" for mark in ("[;:]", ",", ""))
    return F.when(F.length(sentence) <= longest, F.array(sentence)).otherwise(F.regexp_extract_all(sentence, F.lit(rf"(?s)(?:.{{1,{longest}}}\z|{cuts}|.{{{longest}}})\s*"), 0))


def sentences_offsets(docs: DataFrame, by: str = "doc_id", text: str = "text", longest: int | None = None) -> DataFrame:
    """(by, seg_idx, text, start, end) in characters; the spans and the white space between them are the whole text.

    longest: sentences of more characters come in pieces (see `split_long`), which count as segments.
    """
    parts = pieces(F.col(text), rf"{boundary_offsets()}(?:\s+|\z)")
    if longest:
        lead, rest = F.regexp_extract_all(text, F.lit(r"\A\s+"), 0), F.regexp_replace(text, r"\A\s+", "")
        inner = lambda p: split_long(F.regexp_replace(p, r"\s+\z", ""), longest)
        tail = lambda p: F.regexp_extract_all(p, F.lit(r"\s+\z"), 0)
        parts = F.concat(lead, F.flatten(F.transform(pieces(rest, rf"{boundary_offsets()}(?:\s+|\z)"), lambda p: F.concat(inner(p), tail(p)))))
    rows = docs.select(F.col(by), parts.alias("_parts"))

    def span(x: Column) -> Column:
        body = F.regexp_replace(x["piece"], r"^\s+|\s+\z", "")
        return F.struct(body.alias("text"), (x["at"] + F.length(x["piece"]) - F.length(F.regexp_replace(x["piece"], r"^\s+", ""))).alias("start"))

    spans = F.transform(F.filter(placed(F.col("_parts")), lambda x: x["piece"].rlike(r"\S")), span)
    found = rows.select(F.col(by), F.posexplode(spans).alias("seg_idx", "_span"))
    return found.select(by, "seg_idx", "_span.text", "_span.start", (F.col("_span.start") + F.length("_span.text")).alias("end"))


def paragraphs(text: Column) -> Column:
    """Paragraphs: parted by blank lines, trimmed, blanks dropped."""
    parts = F.transform(F.split(text, "\n{2,}"), lambda p: F.btrim(p, F.lit(" \t\n\r\f\x0b")))
    return F.filter(parts, lambda p: p != "")


def word_spans(docs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, word, start, end) of letter runs with marks and apostrophes, in characters."""
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}'’]+|[^\p{L}\p{M}'’]+"), 0)
    rows = docs.select(F.col(by), parts.alias("_parts"))
    spans = F.filter(placed(F.col("_parts")), lambda x: x["piece"].rlike(r"^[\p{L}\p{M}'’]"))
    found = rows.select(F.col(by), F.explode(spans).alias("_span"))
    return found.select(by, F.col("_span.piece").alias("word"), F.col("_span.at").alias("start"), (F.col("_span.at") + F.length("_span.piece")).alias("end"))
