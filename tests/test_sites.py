"""Site rules: selectors against a plain matcher, order, what is left out, fallback."""

import pytest
from pyspark.sql import functions as F

from loomtext.operators import sites
from loomtext.sources import html

PAGE = """<html><body id=top><div class="a b"><h2 class="hP x" data-k="v-1">Subject <b>line</b></h2>
<div class=a3s role=document><p>Body text here.</p><blockquote>quoted words</blockquote><div class=inner><p class=deep lang=en-GB>Deep text here.</p></div>
<nav>Menu words</nav><p hidden>not shown</p></div></div><div class="a3s old" style="display:none"><p>Hidden part.</p></div><p id=last>After all.</p></body></html>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return html.nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, "<body><p>other page</p></body>")], "page_id long, html string")).cache()


@pytest.mark.parametrize(
    "selector, expected",
    [
        ("h2.hP", ["h2"]), ("div.a3s", ["div", "div"]), ("*.hP.x", ["h2"]), ("#top > div", ["div", "div"]), (".a p", ["p", "p", "p"]), (".a3s > p", ["p", "p", "p"]), ("div div p.deep", ["p"]),
        ("[role=document]", ["div"]), ("[role='document'] > blockquote", ["blockquote"]), ('[data-k^="v-"]', ["h2"]), ("[data-k$=\"1\"]", ["h2"]), ("[data-k*='-']", ["h2"]), ("[class~=old]", ["div"]), ("[lang|=en]", ["p"]),
        ("[hidden]", ["p"]), ("h2, #last", ["h2", "p"]), ("body>div>div>div", ["div"]), (".none p", []), ("[data-k^='']", []), ("P.DEEP", []), ("P.deep", ["p"]),
    ],
)
def test_selectors(nodes, selector, expected):
    found = sites.matches(nodes.where("page_id = 1"), selector).join(nodes, ["page_id", "node"])
    assert sorted(r.tag for r in found.collect()) == expected


@pytest.mark.parametrize("selector", ["", " ", "a:hover", "a + b", "> p", "p >", "a,,b", "a, ", "[x", "p..c", "a ~ b"])
def test_what_isnt_understood_is_refused(selector):
    with pytest.raises(ValueError):
        sites.parsed(selector)


def rules(spark, *rows):
    return sites.rules_table(spark, rows)


def test_hosts(spark):
    pages = spark.createDataFrame([(1, "deep.sub.outlook.office.com"), (2, "MAIL.google.com"), (3, "example.com"), (4, ""), (5, None), (6, "com"), (7, "a.com"), (8, "xmail.google.com")], "page_id long, host string")
    got = {r.page_id: r.host for r in sites.rule_of(pages, sites.rules_table(spark), F.col("host")).collect()}
    assert got == {1: "outlook.office.com", 2: "mail.google.com"}
    assert sites.rule_of(pages, rules(spark, ("com", "article", (".x",), ())), F.col("host")).count() == 0


def test_blocks(spark, nodes):
    rule = rules(spark, ("x.com", "mail", ("h2.hP", "div.a3s, .inner", ".inner"), ("blockquote", ".none")))
    ruled = sites.rule_of(spark.createDataFrame([(1, "x.com"), (2, "x.com"), (3, "x.com")], "page_id long, host string"), rule, F.col("host"))
    got = [(r.place, r.role, r.text) for r in sites.site_blocks(nodes, ruled).orderBy("page_id", "place", "root", "block").collect()]
    assert got == [(0, "heading", "Subject line"), (1, "paragraph", "Body text here."), (1, "paragraph", "Deep text here."), (1, "paragraph", "Deep text here.")]
    both = sites.read_blocks(nodes, ruled).collect()
    assert {(r.page_id, r.by_rule) for r in both} == {(1, True), (3, False)} and any(r.text == "other page" for r in both)


def test_parts_inside_what_is_left_out(spark, nodes):
    rule = rules(spark, ("x.com", "mail", (".inner", "#last"), (".a3s",)))
    ruled = sites.rule_of(spark.createDataFrame([(1, "x.com")], "page_id long, host string"), rule, F.col("host"))
    assert [r.text for r in sites.site_blocks(nodes, ruled).collect()] == ["After all."]
    assert sites.site_blocks(nodes.limit(0), ruled).count() == 0
