"""Normalising and splitting over `documents`, each text with a line of rule triggers added by its id.

The line is the same in Spark and in SQL, and every query says whether the stage changed the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import normalize, rules, segment
from loomtext.sources.tables import spread

TRIGGERS = [
    "He said “wait” — it’s 5–10 km² [12] away.. really?? yes!!",
    "Intro . . . . . 12\n 42 \nzero​width soft­hyphen hard space ☀ sun",
    "e.g. this, i.e. that, etc. A -> B node->next w/o it w/ me N.B. n/a et al. 3 >= 2",
    "$50 and $1 and £3 then $1.00 or $1,000 or €2.50 and ¥1 now",
    "5% of #3 & ~7 at 90° @ §2, © me Widget™ R&D #tag a + b = c",
    "# A heading\n## Done!\nSee [the docs](http://x.org/a) and ![a cat](c.png) and `code`",
    "A wrapped line\nthat goes on ele-\nment\nResults\nThe end!!!! of ,,,, it  all ,  now",
    "**bold** and _it_ go to https://www.Example.com/a/b or www.example.org/x today",
    "Dr. Smith met J. R. Jones. They left. It cost 3.5 no. 4 units. He asked \"Why?\" Then left.",
    "Before\n| Name | Age |\n|---|---|\n| Ann | 3 |\nTo do\n- wash the car\n- feed the cat\n\nEnd",
]


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    line = F.element_at(F.array(*map(F.lit, TRIGGERS)), (F.pmod(F.col("doc_id"), F.lit(len(TRIGGERS))) + 1).cast("int"))
    return docs.select("doc_id", "lang", F.concat("text", F.lit("\n"), line).alias("text"))


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DECORATED_SQL = (
    "SELECT doc_id, lang, text || chr(10) || list_extract([" + ", ".join(map(literal, TRIGGERS)) + f"], (doc_id % {len(TRIGGERS)} + 1)::INT) AS text FROM documents"
)


def re2(pattern: str) -> str:
    """A Java pattern without look-arounds in RE2's spelling."""
    return pattern.replace("(?md)", "(?m)").replace(r"\x{B9}", r"\x{00B9}")


def sql_replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, by in pairs:
        by = by.replace("$1", r"\1").replace("$2", r"\2")
        x = f"regexp_replace({x}, {literal(re2(pattern))}, {literal(by)}, 'g')"
    return x


def sql_stage(name: str, x: str) -> str:
    if name in normalize.TRANSLATIONS:
        a, b = normalize.TRANSLATIONS[name]
        return f"translate({x}, {literal(a)}, {literal(b)})"
    if name == "soft_wraps":
        twice = [(r"([A-Za-z0-9,;:)\]\"'%])\n[ \t]*([a-z(])", "$1 $2")] * 2
        return sql_replaced(x, twice)
    if name == "mark_runs":  # a pattern for each mark: no back-references there
        return sql_replaced(x, [(rf"{normalize.quoted(m)}{{3,}}", m) for m in "!?.,;:-"])
    if name == "heading_lines":
        return sql_replaced(x, [(r"(?m)^([^\n]{1,70}[A-Za-z0-9\"')\]])\n([A-Z])", "$1.\n$2")] * 2)
    return sql_replaced(x, normalize.PATTERNS[name])


def sql_collapsed(x: str) -> str:
    for name in normalize.COLLAPSE_ORDER:
        x = sql_stage(name, x)
    return x


def sql_expanded(x: str) -> str:
    ordered = sorted(rules.EXPANSIONS, key=lambda e: -len(e[0]))
    pairs = [(rf"(?i)(^|[^\p{{L}}\p{{N}}]){normalize.quoted(a)}($|[^\p{{L}}\p{{N}}])", rf"$1{b}$2") for a, b in ordered]
    return sql_replaced(x, [p for pair in pairs for p in (pair, pair)])


def sql_currencies(x: str) -> str:
    """All amounts take the plural, then whole amounts of one the singular."""
    number = r"\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
    for sign, one, many in rules.CURRENCY:
        x = sql_replaced(x, [(rf"{normalize.quoted(sign)}[ \t]*({number})", f"$1 {many}\x03")])
        x = sql_replaced(x, [(rf"(^|[^\p{{Nd}},.])((?:0[0,]*)?1,*(?:\.0+)?) {many}\x03", f"$1$2 {one}"), ("\x03", "")])
    return x


def sql_symbols(x: str) -> str:
    forms = {"always": ("{}", " {} "), "isolated": (r"(^|\s){}($|\s)", "$1 {} $2"), "digit-before": (r"(\p{{Nd}})[ \t]*{}", "$1 {} "), "digit-after": (r"{}[ \t]*(\p{{Nd}})", " {} $1")}
    for symbol, say, when in rules.SYMBOLS:
        pattern, by = forms[when]
        pairs = [(pattern.format(normalize.quoted(symbol)), by.format(say))]
        x = sql_replaced(x, pairs * (2 if when == "isolated" else 1))
    return sql_tidied(x)


def sql_tidied(x: str) -> str:
    return sql_replaced(x, [(r"[ \t]{2,}", " "), (r"^[ \t]+|[ \t]+$", "")])


def result(frame: DataFrame, column: Column) -> DataFrame:
    return frame.select("doc_id", F.md5(column.cast("binary")).alias("digest"), (column != F.col("text")).alias("changed"))


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return result(decorated(spark, sf_dir).withColumn("done", fn(F.col("text"))), F.col("done"))

    return run


def _oracle(expression: str) -> str:
    return f"WITH t AS ({DECORATED_SQL}), r AS (SELECT doc_id, text, {expression} AS done FROM t) SELECT doc_id, md5(done) AS digest, done <> text AS changed FROM r"


_TEXT = [
    ("h01", "line_ends"), ("h02", "contents_lines"), ("h03", "number_lines"), ("h04", "zero_width"),
    ("h05", "soft_hyphens"), ("h06", "smart_quotes"), ("h07", "hard_spaces"), ("h08", "dashes"),
    ("h09", "em_dashes"), ("h10", "footnotes"), ("h11", "dot_leaders"), ("h12", "repeated_marks"),
    ("h13", "emoji"), ("h18", "inline_code"), ("h20", "table_rules"), ("h21", "images"), ("h22", "links"),
    ("h23", "headings"), ("h31", "mark_runs"), ("h32", "spaces"), ("h33", "blank_lines"),
    ("h34", "hyphen_wraps"), ("h35", "soft_wraps"), ("h36", "heading_lines"),
]

QUERIES = {f"{i}_{name}": _query(normalize.stage(name)) for i, name in _TEXT}
ORACLE_SQL = {f"{i}_{name}": _oracle(sql_stage(name, "text")) for i, name in _TEXT}

QUERIES |= {
    "h00_normalized": _query(normalize.normalized),
    "h14_collapsed": _query(normalize.collapsed),
    "h15_compatibility": _query(normalize.compatibility),
    "h16_fenced_code": _query(normalize.fenced),
    "h19_tables": _query(normalize.tables),
    "h24_lists": _query(normalize.lists),
    "h25_emphasis": _query(normalize.stage("emphasis")),
    "h26_urls": _query(normalize.urls),
    "h26_urls_skipped": _query(lambda t: normalize.urls(t, "skip")),
    "h27_expanded": _query(normalize.expanded),
    "h28_currencies": _query(normalize.currencies),
    "h29_symbols": _query(normalize.symbols),
    "h30_tidy": _query(normalize.tidied),
    "h37_normalized_offsets": _query(normalize.normalized_offsets),
}
ORACLE_SQL |= {
    "h14_collapsed": _oracle(sql_collapsed("text")),
    "h26_urls_skipped": _oracle(sql_replaced("text", [(normalize.URL, " link ")])),
    "h27_expanded": _oracle(sql_expanded("text")),
    "h28_currencies": _oracle(sql_currencies("text")),
    "h29_symbols": _oracle(sql_symbols("text")),
    "h30_tidy": _oracle(sql_tidied("text")),
    "h37_normalized_offsets": _oracle(sql_symbols(sql_currencies(sql_expanded(sql_collapsed("text"))))),
}


def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each segment of each document: (doc_id, seg_idx, text)."""
    found = decorated(spark, sf_dir).select("doc_id", F.posexplode(segment.sentences(F.col("text"))).alias("seg_idx", "segment"))
    return found


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decorated(spark, sf_dir)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", F.posexplode(segment.split_sentences(F.btrim("t", F.lit(" \t\r\f")))).alias("k", "sentence"))


#: The same sentences as token algebra: candidates and vetoes on white-space tokens, a running count as the sentence.
_ABBREVIATIONS_SQL = ", ".join(literal(a) for a in rules.abbreviations() if " " not in a)
SENTENCES_SQL = f"""
WITH t AS ({DECORATED_SQL}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM t),
trimmed AS (SELECT doc_id, line, trim(t, E' \\t\\r\\f') AS t FROM lines),
toks AS (
  SELECT doc_id, line, unnest(ws) AS tok, generate_subscripts(ws, 1) AS pos, len(ws) AS n
  FROM (SELECT doc_id, line, regexp_extract_all(t, '[^\\s]+') AS ws FROM trimmed)
),
parts AS (
  SELECT *, regexp_extract(tok, '([.!?…]+)["''”’)\\]]*$', 1) AS run,
    regexp_replace(tok, '[.!?…]+["''”’)\\]]*$', '') AS core,
    lead(tok) OVER (PARTITION BY doc_id, line ORDER BY pos) AS nxt
  FROM toks
),
ends AS (
  SELECT *, run <> '' AND nxt IS NOT NULL
    AND NOT regexp_matches(core, '^[A-Za-z]$')
    AND NOT (pos = 1 AND regexp_matches(core, '^\\d+$'))
    AND NOT (lower(regexp_extract(core, '([A-Za-z][A-Za-z.]*)\\.*$', 1)) IN ({_ABBREVIATIONS_SQL}))
    AND NOT (regexp_matches(core, '\\d$') AND run = '.' AND regexp_matches(tok, '\\.$') AND regexp_matches(nxt, '^\\d'))
    AND NOT (contains(run, '…') AND regexp_matches(nxt, '^\\p{{Ll}}')) AS stop
  FROM parts
)
"""


def i02_sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document, by the boundary pattern."""
    n = F.aggregate(F.split("text", "\n"), F.lit(0).cast("long"), lambda acc, x: acc + F.size(segment.split_sentences(F.btrim(x, F.lit(" \t\r\f")))))
    return decorated(spark, sf_dir).select("doc_id", n.alias("n_sentences"))


_COUNTS_SQL = SENTENCES_SQL + (
    "SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_sentences FROM t LEFT JOIN "
    "(SELECT doc_id, sum(CASE WHEN stop OR nxt IS NULL THEN 1 ELSE 0 END) AS n FROM ends GROUP BY doc_id) s USING (doc_id)"
)

QUERIES |= {
    "i01_segments": lambda s, d: segment_rows(s, d),
    "i02_sentence_counts": i02_sentence_counts,
    "i07_sentences_offsets": lambda s, d: segment.sentences_offsets(decorated(s, d)),
    "i11_paragraphs": lambda s, d: decorated(s, d).select("doc_id", F.posexplode(segment.paragraphs(F.regexp_replace("text", "\n", "\n\n"))).alias("par_idx", "paragraph")),
    "i14_word_spans": lambda s, d: segment.word_spans(decorated(s, d)),
}
ORACLE_SQL |= {
    "i02_sentence_counts": _COUNTS_SQL,
    "i11_paragraphs": f"""WITH t AS ({DECORATED_SQL}),
      p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n{{2,}}'), lambda x: trim(x, E' \\t\\n\\r\\f\\v')), lambda x: x <> '') AS ps FROM t)
      SELECT doc_id, unnest(ps) AS paragraph, (generate_subscripts(ps, 1) - 1)::INT AS par_idx FROM p""",
    "i14_word_spans": f"""WITH t AS ({DECORATED_SQL}),
      w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}''’]+') AS ws, regexp_split_to_array(text, '[\\p{{L}}\\p{{M}}''’]+') AS gaps FROM t),
      u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, gaps FROM w),
      s AS (SELECT doc_id, word, (sum(length(gaps[k])) OVER (PARTITION BY doc_id ORDER BY k) + coalesce(sum(length(word)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start FROM u)
      SELECT doc_id, word, start, (start + length(word))::INT AS "end" FROM s""",
}
