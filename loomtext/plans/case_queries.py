"""Queries whose SQL states what is expected, case by case, instead of computing it the same way again.

Each document carries a case, chosen by its id and put behind its source's name, so that every case stands at many rows.
Pronunciation rules and page layout are here as well: their expected results follow from how their inputs are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import normalize, pronounce, segment
from loomtext.operators import layout
from loomtext.plans.text_queries import literal
from loomtext.sources.tables import spread

QUERIES = {}
ORACLE_SQL = {}


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _case(values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod("doc_id", F.lit(len(values))).cast("int"))


def _add_cases(name: str, change: Callable[[Column], Column], cases: list[tuple[str, str]]) -> None:
    """A stage on `source: case`; the SQL has the expected texts."""
    texts, expected = zip(*cases)
    QUERIES[name] = lambda s, d: _docs(s, d).select("doc_id", change(F.concat("source", F.lit(": "), _case(texts))).alias("done"))
    ORACLE_SQL[name] = f"SELECT doc_id, source || ': ' || [{', '.join(map(literal, expected))}][(doc_id % {len(cases)} + 1)::INT] AS done FROM documents"


same = lambda *texts: [(t, t) for t in texts]

COLLAPSED = [
    ("don’t stop", "don't stop"), ("it’s “fine” here", "it's \"fine\" here"), ("won­derful", "wonderful"), ("won​derful", "wonderful"),
    ("1914–1918", "1914-1918"), ("He left — quickly.", "He left, quickly."), ("the cat", "the cat"), ("claimed¹ that", "claimed that"),
    ("Wait... what?", "Wait… what?"), ("Chapter 1......5", "Chapter 1 5"), ("Wait.. what?", "Wait. what?"), ("Really??", "Really?"), ("Stop!!!", "Stop!"),
    *same("«bonjour»", "R&D", "C++", "a/b/c", "no marks here at all"),
]
_add_cases("h14_collapse_cases", normalize.collapsed, COLLAPSED)

SAID = [
    ("Ben & Jerry", "Ben and Jerry"), ("a = b", "a equals b"), ("20%", "20 percent"), ("#42", "number 42"), ("~5", "about 5"), ("20°", "20 degrees"), ("§7", "section 7"),
    ("©2026 Acme", "copyright 2026 Acme"), ("Widget™ and Thing®", "Widget trademark and Thing registered"), ("$50", "50 dollars"), ("$1", "1 dollar"), ("$1.00", "1.00 dollar"),
    ("£20", "20 pounds"), ("€1,200", "1,200 euros"), ("¥500", "500 yen"), ("It cost $50.", "It cost 50 dollars."), ("$50 and $1 and £3", "50 dollars and 1 dollar and 3 pounds"),
    ("100% and 50%", "100 percent and 50 percent"), ("A & B & C", "A and B and C"), ("5% + 3%", "5 percent plus 3 percent"), ("20 %", "20 percent"), ("# 42", "number 42"), ("$ 50", "50 dollars"),
    ("Files xw/y and w/o sugar", "Files xw/y and without sugar"), ("Compare a<=b and x <= y.", "Compare a<=b and x less than or equal to y."), ("w/ milk", "with milk"), ("I.E. THIS", "that is THIS"),
    ("cats, dogs, etc.", "cats, dogs, et cetera"), ("Smith et al. found", "Smith and others found"), ("x >= 5", "x greater than or equal to 5"), ("p=>q and r => s", "p=>q and r to s"),
    ("50% -> 60%", "50 percent to 60 percent"), ("a –> b", "a to b"), ("et al. showed it", "and others showed it"), ("“w/o” it", "\"without\" it"), ("claimed [1] so", "claimed so"),
    *same("R&D", "C++", "x && y", "key=value", "C#", "#hashtag", "me@example.com", "~/home/user", "%s and %d", "node->next", "https://example.com/a?b=c", "the $ sign", "lower->case"),
]
_add_cases("h37_said_cases", normalize.normalized_offsets, SAID)

BLOCKS = [
    ("**bold** and _it_", "bold and it"), ("see [the docs](http://x.org/a) now", "see the docs now"), ("`code` here", "code here"), ("go to https://www.Example.com/a/b or on", "go to link to example.com or on"),
    ("a\n| Name | Age |\n|---|---|\n| Ann | 3 |", "a.\nTable: Name, Age.\nAnn, 3."),
    ("the LG\n  is scaled", "the LG is scaled"), ("an ele-\nment", "an element"), ("a\n- wash the car\n- feed the cat", "a.\n\nwash the car.\nfeed the cat."), ("a\n 12 \nb.", "a\n\nb."), ("all is  well !", "all is well!"),
]
_add_cases("h00_block_cases", normalize.normalized, BLOCKS)



def _add_before(name: str, change: Callable[[Column], Column], cases: list[tuple[str, str]], ends: str = "text") -> None:
    """A stage on the case, a blank line, and the whole text; the SQL has what is expected of the case, and the text as `ends` has it."""
    texts, expected = zip(*cases)
    QUERIES[name] = lambda s, d: _docs(s, d).select("doc_id", change(F.concat(_case(texts), F.lit("\n\n"), "text")).alias("done"))
    ORACLE_SQL[name] = f"SELECT doc_id, [{', '.join(map(literal, expected))}][(doc_id % {len(cases)} + 1)::INT] || chr(10) || chr(10) || {ends} AS done FROM documents"


LISTS = [
    ("- wash the car", "wash the car."), ("- a\n- b", "a.\nb."), ("* x\n* y!\n* z;", "x.\ny!\nz;"), ("To do\n- one\n- two", "To do.\n\none.\ntwo."), ("\n- after a blank", "\nafter a blank."),
    ("- one\n\n- two", "one.\n\ntwo."), ("- one\ngoes on\n- two", "one\ngoes on.\ntwo."), ("• dot\n+ plus", "dot.\nplus."), ("  - inner\n    - deeper", "inner.\ndeeper."), ("- a,\n- b:", "a,\nb:"), *same("-no list", "a - b", "*emphasis*"),
]
_add_before("h24_list_cases", normalize.lists, LISTS, "regexp_replace(text, '\\n$', '')")
TABLES = [
    ("| Name | Age |\n|---|---|\n| Ann | 3 |\n| Bo | 4 |", "Table: Name, Age.\nAnn, 3.\nBo, 4."), ("a | b\n--|--\nc! | d!", "Table: a, b.\nc!, d!"), ("x\n| a | b |\n|:--|--:|\ny", "x\nTable: a, b.\ny"),
    ("| a |  |\n|---|---|\n|  |  |\n| b | |", "Table: a.\nb."), ("| p |\n| a | b |\n| --- | --- |\n| c | d? |", "| p |\nTable: a, b.\nc, d?"), ("| a | b |\n|---|---|", "Table: a, b."), *same("a | b", "|---|---|", "no bars"),
]
_add_before("h19_table_cases", normalize.tables, TABLES)
FENCES = [
    ("```python\nx = 1\ny = 2\n```", " \n\n Python code block, 2 lines. \n\n "), ("```\none line\n```", " \n\n Code block, 1 line. \n\n "), ("a ```\n``` b", "a  \n\n Code block. \n\n  b"), *same("``` never closed", "one `tick`", "no code"),
]
_add_before("h16_fence_cases", normalize.fenced, FENCES)

SENTENCES = [
    (["One two.", "Three four."], " "), (["Really?!", "I had no idea."], " "), (["Wait… what happened?"], " "), (["That was the end…", "The next began."], " "), (["She said \"Stop.\"", "Then she left."], " "),
    (["He left (finally).", "We all cheered."], " "), (["Dr. Smith arrived.", "He was late."], " "), (["The U.S. economy grew.", "Analysts were surprised."], " "), (["J. R. R. Tolkien wrote it.", "Everyone knows."], " "),
    (["The cost is 3.5 million.", "Nobody blinked."], " "), (["It happened in 1999.", "The next year was worse."], " "), (["Visit https://example.com/a.b for more.", "Then leave."], " "), (["Open report.pdf now.", "It is ready."], " "),
    (["No terminator at all"], " "), (["A\x01b.", "C\x02 d."], " "), (["Para one.", "Para two."], "\n\n"), (["Line one.", "Line two."], "\n"),
]
_TEXTS, _LISTS = [gap.join(s) for s, gap in SENTENCES], ["['" + "', '".join(x.replace("'", "''") for x in s) + "']" for s, _ in SENTENCES]
_LISTED = f"SELECT doc_id, source, [{', '.join(_LISTS)}][(doc_id % {len(SENTENCES)} + 1)::INT] AS s FROM documents"
_numbered = lambda s, d: _docs(s, d).select("doc_id", F.concat("source", F.lit(": "), _case(_TEXTS)).alias("text"))
QUERIES["i01_segment_cases"] = lambda s, d: _numbered(s, d).select("doc_id", F.posexplode(segment.sentences(F.col("text"))).alias("seg_idx", "segment"))
ORACLE_SQL["i01_segment_cases"] = f"SELECT doc_id, (i - 1)::INT AS seg_idx, CASE WHEN i = 1 THEN source || ': ' ELSE '' END || s[i] AS segment FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM ({_LISTED}))"
QUERIES["i07_offset_cases"] = lambda s, d: segment.sentences_offsets(_numbered(s, d)).select("doc_id", "seg_idx", "text", "start", "end")
ORACLE_SQL["i07_offset_cases"] = f"""WITH r AS (SELECT doc_id, (i - 1)::INT AS seg_idx, CASE WHEN i = 1 THEN source || ': ' ELSE '' END || s[i] AS text,
  CASE WHEN doc_id % {len(SENTENCES)} = {len(SENTENCES) - 2} THEN 2 ELSE 1 END AS gap FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM ({_LISTED}))),
  e AS (SELECT *, (sum(length(text) + gap) OVER (PARTITION BY doc_id ORDER BY seg_idx) - gap)::INT AS "end" FROM r)
  SELECT doc_id, seg_idx, text, ("end" - length(text))::INT AS start, "end" FROM e"""
#: Sentences cut at 20 characters.
LONG = [["one two three; ", "four five six seven ", "eight"], ["a, b c d e f g h, ", "i j k l m n"], ["abcdefghijklmnopqrst", "uvwxyz"], ["short one"]]
_LONG_SQL = "[" + ", ".join("['" + "', '".join(x) + "']" for x in LONG) + "]"
QUERIES["i10_long_cases"] = lambda s, d: _docs(s, d).select("doc_id", F.posexplode(segment.split_long(_case(["".join(x) for x in LONG]), 20)).alias("k", "piece"))
ORACLE_SQL["i10_long_cases"] = f"SELECT doc_id, (i - 1)::INT AS k, s[i] AS piece FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_LONG_SQL}[(doc_id % {len(LONG)} + 1)::INT] AS s FROM documents))"

USER = [pronounce.Rule("GIF", "gif"), pronounce.Rule("Acme", "ack me"), pronounce.Rule("Acme Corporation", "ack me corp"), pronounce.Rule("cat", "cat cat"), pronounce.Rule(r"\bDr\.", "Doctor", regex=True), pronounce.Rule("([unclosed", "x", regex=True), pronounce.Rule("us", "U S", match_case=False, enabled=False), pronounce.Rule("cost$", "price $1")]
SPOKEN = [
    ("The GIF loaded.", "The gif loaded."), ("Run nginx now.", "Run engine ex now."), ("The GUI appeared.", "The gooey appeared."), ("environmental", "environmental"), ("one cat", "one cat cat"),
    ("Acme Corporation ships.", "ack me corp ships."), ("Dr. Chen", "Doctor Chen"), ("with us", "with us"), ("psql, PostgreSQL and SQL", "postgres, postgres and sequel"), ("no cost$ here", "no price $1 here"),
]


def rules_table(s: SparkSession) -> DataFrame:
    return pronounce.overridden(pronounce.table(s, pronounce.SHIPPED), pronounce.table(s, USER))


def k01_pronounced(s: SparkSession, d: str) -> DataFrame:
    """The user's rules over the shipped ones, on whole texts behind a case."""
    rules = pronounce.read_rules(rules_table(s))
    said = pronounce.pronounced(F.concat(_case([t for t, _ in SPOKEN]), F.lit("\n"), "text"), rules, "offsets")
    return _docs(s, d).select("doc_id", F.substring_index(said, "\n", 1).alias("said"), F.md5(said.cast("binary")).alias("digest"))


def _spoken_sql(x: str) -> str:
    """The shipped rules that no document's text is free of by its making, one after the other, each twice for neighbours."""
    live = sorted((r for r in [*pronounce.SHIPPED, USER[3]] if r.match != "GIF"), key=lambda r: (r not in USER, -len(r.match)))
    for r in live:
        pair = f"'(?i)(^|[^\\p{{L}}\\p{{N}}]){r.match}($|[^\\p{{L}}\\p{{N}}])', '\\1{r.say}\\2', 'g'"
        x = f"regexp_replace(regexp_replace({x}, {pair}), {pair})" if r.match != "cat" else x
    return x


QUERIES["k01_pronounced"] = k01_pronounced
ORACLE_SQL["k01_pronounced"] = f"""SELECT doc_id, said, md5(said || chr(10) || {_spoken_sql("text")}) AS digest
  FROM (SELECT doc_id, text, [{', '.join(literal(e) for _, e in SPOKEN)}][(doc_id % {len(SPOKEN)} + 1)::INT] AS said FROM documents)"""
QUERIES["c08_rules"] = lambda s, d: rules_table(s).select("match", "say", "from_user")
ORACLE_SQL["c08_rules"] = "SELECT * FROM (VALUES " + ", ".join(f"({literal(r.match)}, {literal(r.say)}, true)" for r in USER) + ", " + ", ".join(f"({literal(r.match)}, {literal(r.say)}, false)" for r in pronounce.SHIPPED if r.match != "GIF") + ") AS r(match, say, from_user)"


def placed_lines(s: SparkSession, d: str) -> DataFrame:
    """Documents as pages of two columns: lines of their words, twelve characters of each, dealt left and right by turns; each
    line is two runs, a space apart, and the third row of each column stands lower, as the start of a paragraph does."""
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: F.length(w) > 2)
    taken = normalize.once(F.slice(words, 1, 24), lambda w: F.when(F.size(w) == 24, w))  # a filter would split the text again, so would the one that a plain explode implies
    docs = spread(_docs(s, d).select(F.col("doc_id").alias("page"), "text")).select("page", taken.alias("words"))
    rows = docs.select("page", F.posexplode_outer("words").alias("k", "w")).where("w is not null").withColumn("line", F.floor(F.col("k") / 2)).withColumn("row", F.floor(F.col("line") / 2))
    y = 700 - 20 * F.col("row") - F.when(F.col("row") >= 2, 30).otherwise(0)
    x = F.when(F.col("line") % 2 == 0, 50).otherwise(320) + F.when(F.col("k") % 2 == 0, 0).otherwise(80)
    return rows.select("page", F.substring("w", 1, 12).alias("str"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(70.0).alias("width"), F.lit(10.0).alias("height"))


_PLACED = """p AS (SELECT doc_id AS page, list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda w: length(w) > 2)[1:24] AS w FROM documents),
  l AS (SELECT page, i // 2 AS row, i % 2 AS col, left(w[2 * i + 1], 12) || ' ' || left(w[2 * i + 2], 12) AS line FROM (SELECT page, w, unnest(range(0, 12)) AS i FROM p WHERE len(w) = 24))"""
QUERIES["k14_layout_lines"] = lambda s, d: layout.lines(layout.columns(placed_lines(s, d), 600.0)).select("page", "col", "row", "text")
ORACLE_SQL["k14_layout_lines"] = f"WITH {_PLACED} SELECT page, col::INT AS col, row::INT AS row, line AS text FROM l"
QUERIES["e12_page_texts"] = lambda s, d: layout.texts(layout.lines(layout.columns(placed_lines(s, d), 600.0)))
ORACLE_SQL["e12_page_texts"] = f"WITH {_PLACED} SELECT page, string_agg(CASE WHEN row = 2 THEN chr(10) || chr(10) WHEN col > 0 OR row > 0 THEN ' ' ELSE '' END || line, '' ORDER BY col, row) AS text FROM l GROUP BY page"
