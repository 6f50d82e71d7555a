"""Main-text extraction: held-out lessons, hand-made pages, the tree decoding against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import html_text, lesson_pages


@pytest.fixture(scope="module")
def trees():
    return html_text.trained()


def one(html, trees):
    return html_text.extracted([html], trees)[0]


def test_held_out_lessons(trees):
    exact = f1 = 0
    for k in range(150):
        page = lesson_pages.lesson(50_000_000 + k)
        read = html_text.read_page(page)
        expected = html_text.joined(html_text.without_marks(read), html_text.labels_of(read) > 0)
        got = one(page.replace(lesson_pages.MARK, ""), trees)
        exact += got == expected
        a, b = set(expected.split("\n\n")), set(got.split("\n\n"))
        f1 += 2 * len(a & b) / (len(a) + len(b))
    assert exact >= 130 and f1 / 150 >= 0.95


PROSE = [f"Sentence {w} stands here, and it says what {w} means to those who read on." for w in ("one", "two", "three", "four")]
MAIN = "".join(f"<p>{p}</p>" for p in PROSE)


@pytest.mark.parametrize(
    "page",
    [
        f'<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><article>{MAIN}</article><footer>&copy; x.com</footer></body></html>',
        f'<body><header><h1><a href=/>Site</a></h1></header><main>{MAIN}</main><aside><h3>Related</h3><ul><li><a href=/q>One more</a></li></ul></aside><footer><p>All rights reserved.</p></footer></body>',
        f'<body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Ok</button></div><div class="nav-links"><a href=1>One</a> | <a href=2>Two</a></div><div class="post-content">{MAIN}</div><div id="comments"><div class="comment"><b>Jo</b><p>What a fine text this is, I read it twice.</p></div></div></body>',
        f'<body><nav><a href=/>Home</a></nav><!-- ad --><div class="ad">Buy the thing now.</div><article><p>{PROSE[0]}<p>{PROSE[1]}<br><p><b>{PROSE[2]}<br><p>{PROSE[3]}</article><form><label>Name</label><input><button>Go</button></form><div class="sponsored"><p>An offer for you.</p></div></body>',
        f'<body><article>{MAIN}<section class="comments"><h3>Comments</h3><ol><li class="comment"><p>I never knew that at all, thanks.</p></li></ol></section></article></body>',
    ],
)
def test_pages_by_hand(page, trees):
    assert one(page, trees) == "\n\n".join(PROSE)


def test_text_of_blocks(trees):
    html = f"<article><h1>What one  <h1>What one  &amp;\n two have to say</h1>amp;\n two have to say</h1>{MAIN}<p>x&nbsp;&#65;<i>b</i>c&hellip; &am &copy and<br>more words stand in this line.</p><script>no()</script><pre>one\n\n two words here.</pre></article>"
    assert one(html, trees) == "\n\n".join(["What one & two have to say", *PROSE, "x Abc… &am © and more words stand in this line.", "one two words here."])
    assert [one(h, trees) for h in ("", " ", "<", "<!--", "<p", "</p></div>", "<html></html>", "&")] [:2] == ["", ""]


def test_deep_and_long_pages(trees):
    deep = "<div>" * 20_000 + "<article>" + MAIN + "</article>"
    assert isinstance(one(deep, trees), str)
    long = f"<body><nav><a href=/>Home</a></nav><article>{MAIN * 5_000}</article><footer>&copy; x</footer></body>"
    assert one(long, trees) == "\n\n".join(PROSE * 5_000)


def brute(parent, is_text, odds):
    """The likeliest consistent choice, by trying all."""
    n = len(parent)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best = None
    for choice in itertools.product([False, True], repeat=n):
        if any(c and parent[v] >= 0 and not choice[parent[v]] for v, c in enumerate(choice)):
            continue
        if any(c and not is_text[v] and not any(choice[u] for u in range(n) if parent[u] == v) for v, c in enumerate(choice)):
            continue
        value = sum(yes[v] if c else no[v] for v, c in enumerate(choice))
        if best is None or value > best[0]:
            best = value, choice
    return list(best[1])


def test_decoding_is_the_likeliest_consistent_choice():
    rnd = random.Random(5)
    for _ in range(150):
        n = rnd.randint(1, 9)
        parent = [-1] + [rnd.randrange(k) for k in range(1, n)]
        inner = set(parent)
        is_text = [v not in inner and (v == 0 or rnd.random() < 0.8) for v in range(n)]
        depth = [0] * n
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        odds = np.array([rnd.gauss(0, 3) for _ in range(n)])
        numbers = np.zeros((n, len(html_text.NUMBERS)), np.float32)
        numbers[:, html_text.NUMBERS.index("is_text")] = is_text
        table = html_text.Table(np.array(parent), np.array(depth), numbers, np.zeros((n, 0), bool))
        assert html_text.decoded(table, odds).tolist() == brute(parent, is_text, odds)


def test_query(spark, trees):
    page = f"<body><article>{MAIN}</article></body>"
    rows = [(1, "u1", None), (2, "u2", ""), (3, None, page), (3, None, page), (None, "u4", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    text = "\n\n".join(PROSE)
    got = [tuple(r) for r in html_text.digest(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, "u1", "", 0), (2, "u2", "", 0), (3, None, text, len(text)), (3, None, text, len(text)), (None, "u4", text, len(text))], key=str)
    kept = html_text.main_text(pages, into="article", trees=trees).first()
    assert kept["text"] == "clash" and kept["article"] == ""
    assert html_text.digest(pages.limit(0)).count() == 0


def test_the_given_pages(spark, trees):
    """Their article stands in one element, so that what should come out is known."""
    import html as references
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    right = 0
    for r in rows:
        blocks = re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", r.html, re.S).group(1))
        blocks = [" ".join(references.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        right += one(r.html, trees) == "\n\n".join(b for b in blocks if b)
    assert right >= 0.99 * len(rows)
