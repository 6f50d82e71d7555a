"""Web pages as tables: the parser only lists nodes and texts; finding the article is joins and sums over them.

A page's nodes are numbered in document order and carry their path of ancestors. Malformed pages are read as browsers
do where it matters here: void elements take no end tag, a new block closes an open paragraph, scripts are not text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.identity import next_page_url, resolved

#: Tags, roles and fragments that mark furniture or content (fixed values of the scoring).
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SKIPPED_TAGS = set("script style noscript template svg canvas iframe object embed audio video map area select option textarea input button label progress meter dialog nav footer aside".split())
SKIPPED_ROLES = set("navigation banner complementary contentinfo search menu menubar toolbar tablist alert status".split())
BLOCKS = set("address article aside blockquote body caption dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table td th tr ul".split())
ROLES = {
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "li": "listitem",
    "dd": "listitem", "dt": "heading", "blockquote": "quote", "pre": "code", "code": "code", "figcaption": "caption", "caption": "caption",
    "td": "cell", "th": "cell", "summary": "heading",
}
JUNK = r"(?i)(^|[\s_-])(nav|menu|sidebar|side-bar|footer|header|masthead|banner|advert|ads?|sponsor|promo|social|share|comment|disqus|related|recommend|newsletter|subscribe|signup|popup|modal|overlay|cookie|consent|gdpr|breadcrumb|pagination|paginate|toolbar|widget|skip-link|screen-reader|sr-only|visually-hidden)([\s_-]|$)"
GOOD = r"(?i)(^|[\s_-])(article|articlebody|post|postbody|entry|entry-content|content|main|story|storybody|blog|markdown|prose|text|body-copy|rich-text)([\s_-]|$)"

NODES = "page_id long, node int, path array<int>, block int, tag string, ident string, role string, skipped boolean, in_link boolean, text string, href string, rel string, label string, classes array<string>, element_id string, unavailable boolean, hidden boolean, attrs map<string, string>"


class _Lister(HTMLParser):
    """Lists (node, path, block, tag, ident, role, skipped, in_link, text): a row for each element, and for each text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[tuple[int, str, bool, bool, int, bool]] = []  # node, tag, skipped, in a link, nearest block, hidden

    def _row(self, node: int, tag: str, ident: str, role: str, skipped: bool, link: bool, block: int, text: str | None, more: tuple = (None,) * 8) -> None:
        self.rows.append((node, [o[0] for o in self.open], block, tag, ident, role, skipped, link, text, *more))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and any(o[1] == "p" for o in self.open):
            self.handle_endtag("p")
        a = {k: v or "" for k, v in attrs}
        above = self.open[-1] if self.open else (-1, "", False, False, 0, False)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or any(x in a.get("style", "").replace(" ", "") for x in ("display:none", "visibility:hidden", "opacity:0;")) or a.get("style", "").replace(" ", "").endswith("opacity:0")
        skipped = above[2] or hidden or tag in SKIPPED_TAGS or a.get("role", "") in SKIPPED_ROLES
        node, link = len(self.rows), above[3] or tag == "a"
        block = node if tag in BLOCKS else above[4]
        unseen = above[5] or hidden
        unavailable = unseen or "disabled" in a or a.get("aria-disabled") == "true"
        more = (a.get("href"), a.get("rel"), a.get("aria-label"), a.get("class", "").split(), a.get("id"), unavailable, unseen, list(a.items()))
        self._row(node, tag, f"{a.get('class', '')} {a.get('id', '')}", a.get("role", ""), skipped, link, block, None, more)
        if tag not in VOID:
            self.open.append((node, tag, skipped, link, block, unseen))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and data:
            _, tag, skipped, link, block, _ = self.open[-1]
            self._row(len(self.rows), "#text", "", "", skipped, link, block, data)


def nodes(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each element and text of each page; null pages have none."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "node", "path", "block", "tag", "ident", "role", "skipped", "in_link", "text", "href", "rel", "label", "classes", "element_id", "unavailable", "hidden", "attrs"]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lister = _Lister()
                lister.feed(text or "")
                lister.close()
                if lister.rows:
                    columns = [[key] * len(lister.rows), *zip(*lister.rows)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return pages.select(F.col(page_id).cast("long"), F.col(html)).mapInArrow(parse, NODES)


def lengths(found: DataFrame) -> DataFrame:
    """(page_id, node, chars, link_chars): of each element, the characters of the texts below it, and of those in links."""
    texts = found.where(F.col("tag") == "#text").select("page_id", F.explode("path").alias("node"), F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("n"), "in_link")
    return texts.groupBy("page_id", "node").agg(F.sum("n").alias("chars"), F.sum(F.when(F.col("in_link"), F.col("n")).otherwise(0)).alias("link_chars"))


def density(links: Column, chars: Column) -> Column:
    return F.when(chars > 0, links / chars).otherwise(1.0)


def article_roots(found: DataFrame) -> DataFrame:
    """(page_id, root): the explicit article if its text is enough, else the element with the best score, else the body.

    Paragraphs score by their length and credit their three nearest ancestors; furniture and links weigh down.
    """
    known = lengths(found)
    elements = found.where(F.col("tag") != "#text").join(known, ["page_id", "node"], "left").fillna(0, ["chars", "link_chars"])
    body = elements.where("tag = 'body'").groupBy("page_id").agg(F.min("node").alias("body"), F.max("chars").alias("body_chars"))
    explicit = elements.where("tag in ('article', 'main') or role in ('article', 'main')").groupBy("page_id").agg(F.min(F.struct("node", "chars")).alias("e"))
    trusted = explicit.join(body, "page_id", "left").where("e.chars >= 200 or e.chars / greatest(coalesce(body_chars, e.chars), 1) >= 0.25").select("page_id", F.col("e.node").alias("explicit"))
    score = F.least(F.col("chars") / 100, F.lit(5.0)) + F.least(F.col("chars") / 25, F.lit(3.0))
    score = score * F.when(density(F.col("link_chars"), F.col("chars")) > 0.5, 0.2).otherwise(1.0)
    blocks = elements.where("tag in ('p', 'li', 'blockquote', 'pre') and chars >= 25").select("page_id", score.alias("score"), F.posexplode(F.slice(F.reverse("path"), 1, 3)).alias("d", "node"))
    credit = blocks.groupBy("page_id", "node").agg(F.sum(F.col("score") / (F.col("d") + 1)).alias("raw")).join(elements, ["page_id", "node"])
    weight = F.when(F.col("ident").rlike(JUNK), 0.25).otherwise(1.0) * F.when(F.col("ident").rlike(GOOD), 1.5).otherwise(1.0)
    final = F.col("raw") * weight * (1 - F.least(density(F.col("link_chars"), F.col("chars")), F.lit(0.9)))
    best = credit.where(final > 0).groupBy("page_id").agg(F.max_by("node", F.struct(final.alias("s"), (-F.col("node")).alias("n"))).alias("best"))
    return body.join(trusted, "page_id", "left").join(best, "page_id", "left").select("page_id", F.coalesce("explicit", "best", "body").alias("root"))


def blocks(found: DataFrame, roots: DataFrame, code: str = "read") -> DataFrame:
    """(page_id, block, role, text) under each page's root, in document order; blocks of fewer than two characters go."""
    texts = found.where("tag = '#text' and not skipped").join(roots, "page_id").where(F.array_contains("path", F.col("root")))
    whole = texts.groupBy("page_id", "block").agg(F.sort_array(F.collect_list(F.struct("node", "text"))).alias("all"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("all", lambda x: x["text"]), ""), r"\s+", " "))
    role = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    tags = found.select("page_id", F.col("node").alias("block"), "tag")
    named = whole.select("page_id", "block", text.alias("text")).join(tags, ["page_id", "block"])
    out = named.select("page_id", "block", F.coalesce(F.element_at(role, F.col("tag")), F.lit("paragraph")).alias("role"), "text").where(F.length("text") >= 2)
    return out.where("role <> 'code'") if code == "skip" else out


#: How a page names its next page, in the order in which the ways are tried, and how sure each is (fixed values).
STRATEGIES = (("link-rel-next", "high"), ("aria-next", "medium"), ("class-next", "medium"), ("text-next", "low"), ("url-increment", "low"))
NEXT_WORDS = ("next", "older", "continue", "›", "»", "→")


def next_pages(found: DataFrame, pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, next_url, label, strategy, confidence, confirm): each page's next page, by the first strategy that finds one,
    the first element in document order. Links that are disabled, hidden or lead to the page itself don't count; what is
    less than medium sure is to be confirmed."""
    texts = found.where("tag = '#text'").select("page_id", F.explode("path").alias("node"), F.struct(F.col("node").alias("at"), "text").alias("t"))
    linked = found.where("href is not null and not unavailable").select("page_id", "node", "tag", "href", "rel", "label", "classes", "element_id")
    inner = texts.join(linked.select("page_id", "node"), ["page_id", "node"], "left_semi").groupBy("page_id", "node").agg(F.sort_array(F.collect_list("t")).alias("all"))
    inner = inner.select("page_id", "node", F.trim(F.array_join(F.transform("all", lambda x: x["text"]), "")).alias("inner"))
    word = F.lower(F.col("inner"))
    said = F.exists(F.array(*map(F.lit, NEXT_WORDS)), lambda w: (word == w) | F.startswith(word, F.concat(w, F.lit(" "))) | F.endswith(word, F.concat(F.lit(" "), w)))
    has = lambda name: F.array_contains("classes", name)
    ways = F.array(
        F.when(F.col("tag").isin("a", "link") & (F.col("rel") == "next"), 0),
        F.when(F.col("label").rlike("(?i)next"), 1),
        F.when((has("next") & ~has("disabled")) | has("pagination-next") | has("next-page") | (F.col("element_id") == "next"), 2),
        F.when((F.col("tag") == "a") & (F.length("inner") <= 30) & said, 3),
    )
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    links = linked.join(inner, ["page_id", "node"], "left").withColumn("inner", F.coalesce("inner", F.lit(""))).withColumn("way", F.explode(F.array_compact(ways)))
    links = links.join(own, "page_id").withColumn("next_url", resolved(F.col("href"), F.col("url")))
    label = F.when(F.col("way") == 3, F.lower("inner")).when(F.col("inner") != "", F.col("inner")).otherwise(F.coalesce("label", F.lit("Next")))
    stepped = own.select("page_id", "url", next_page_url(F.col("url")).alias("next_url"), F.lit(4).alias("way"), F.lit(0).alias("node"), F.lit("Next page").alias("name"))
    every = links.select("page_id", "url", "next_url", "way", "node", F.substring(F.trim(label), 1, 60).alias("name")).unionByName(stepped)
    here = lambda c: F.regexp_replace(c, "#.*$", "")
    every = every.where(F.col("next_url").isNotNull() & (here(F.col("next_url")) != here(F.col("url"))))
    first = every.groupBy("page_id").agg(F.min(F.struct("way", "node", "next_url", "name")).alias("f"))
    strategy = F.get(F.array(*(F.lit(s) for s, _ in STRATEGIES)), F.col("f.way"))
    confidence = F.get(F.array(*(F.lit(c) for _, c in STRATEGIES)), F.col("f.way"))
    return first.select("page_id", "f.next_url", F.col("f.name").alias("label"), strategy.alias("strategy"), confidence.alias("confidence"), (confidence == "low").alias("confirm"))


def unvisited(next_: DataFrame, visited: DataFrame) -> DataFrame:
    """Next pages that haven't been read (visited: url), whatever their fragments, so that a circle of pages ends."""
    key = lambda c: F.regexp_replace(c, "#.*$", "")
    seen = visited.select(key(F.col("url")).alias("_key")).distinct()
    return next_.join(seen, key(F.col("next_url")) == F.col("_key"), "left_anti")
