"""Main-text extraction from web pages: gradient-boosted trees over the nodes of a page, decoded as a tree.

A page becomes a table of nodes in page order: block elements, inline elements that carry a name (class, id, role), and runs of text.
Each node has the sums of its subtree (characters, words, marks, links, items, controls), densities, depth, place, what stands
beside it among its siblings, and the tokens of its own tag and names, with what tokens its ancestors have. Boosted trees give the odds that the
node holds text of the article. A node that holds some must be kept with all its ancestors, and nothing inside a dropped node
can be kept: the most likely choice under these rules is found from the leaves up and read off from the root down.

The trees are trained on generated pages (`lesson_pages.lesson`), in which each piece of text is known to be article or not:
many layouts, with and without telling names, unclosed tags, noise. Training takes a fixed number of pages, is done once in the
driver, and gives the same trees each time; the pages that are read play no part in it.

Null and empty pages give an empty text. Rows that repeat get equal results. Ties (equal odds) drop the node. An empty table gives
an empty result. Very long and very deep pages are read whole, in memory in proportion to the page. Columns of the caller stay; `text` and `n_chars` (or the name that `into` gives) replace theirs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import lesson_pages
from loomtext.llm.common import blocks, released, small_batches
from loomtext.sources.tables import spread

# Elements of HTML by what they do to text (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript head title svg math iframe canvas audio video object select datalist textarea button map".split())
CONTROLS = frozenset("form input select textarea button option fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key closes open elements named on the right, up to the nearest of those after the bar (fixed values).
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"), "option": ("option", "select"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Elements inside which a paragraph of an outer one isn't closed (fixed values).
FENCE = frozenset("td th table button object caption".split())

#: Rows that a tree is grown on, of all.
TREES, DEPTH, RATE, BINS, RIDGE, SUBSAMPLE = 100, 4, 0.2, 24, 2.0, 0.3
LESSONS, LEAST_TOKEN = 1_000, 12
TEXT = "#text"


class Page(NamedTuple):
    """Nodes in page order; `parent` is -1 at the root."""

    parent: list[int]
    end: list[int]  # the number behind the last node of the subtree
    tag: list[str]
    tokens: list[tuple[str, ...]]
    block: list[int]  # of a run of text: its block; else -1
    text: list[str]
    linked: list[int]  # characters of a run that stand in links
    links: list[int]
    controls: list[int]


@cache
def parts(name: str) -> tuple[str, ...]:
    """Tokens of a class, id or role: parted at marks, digits and capitals, without a plural s."""
    found = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+", name[:200])
    return tuple(dict.fromkeys(f"c:{x.removesuffix('s') if len(x) > 3 else x}" for x in (y.lower() for y in found)))[:8]


class Reader(HTMLParser):
    """A page's nodes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page([], [], [], [], [], [], [], [], [])
        self.open: list[tuple[str, int]] = []  # tags and their nodes; -1 where the element is none
        self.nodes: list[int] = []  # open nodes
        self.count: Counter[str] = Counter()
        self.unseen = self.in_link = self.blocks = 0
        self.run = -1
        self.node("#root", ())

    def node(self, tag: str, tokens: tuple[str, ...]) -> int:
        p, at = self.page, len(self.page.parent)
        p.parent.append(self.nodes[-1] if self.nodes else -1)
        p.end.append(at + 1)
        p.tag.append(tag)
        p.tokens.append((f"t:{tag}", *tokens))
        p.block.append(self.blocks if tag == TEXT else -1)
        p.text.append("")
        for counted in (p.linked, p.links, p.controls):
            counted.append(0)
        if tag != TEXT:
            self.nodes.append(at)
        return at

    def boundary(self) -> None:
        self.blocks += 1
        self.run = -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CONTROLS and self.nodes:
            self.page.controls[self.nodes[-1]] += 1
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self.boundary()
            return
        inline = tag in INLINE
        if not inline and tag not in UNSEEN and self.count["p"] and not self.count["svg"]:
            self.close_to(frozenset(("p",)), FENCE)
        if tag in CLOSES:
            self.close_to(*CLOSES[tag])
        names = tuple(dict.fromkeys(t for k, v in attrs if k in ("class", "id", "role", "itemprop") and v for t in parts(v)))
        if any(k in ("hidden", "aria-hidden") and v != "false" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs):
            names = (*names, "c:hidden")
        at = -1
        if tag in UNSEEN:
            self.unseen += 1
        elif not inline or names:
            if not inline:
                self.boundary()
            self.run = -1
            at = self.node(tag, names)
        if tag == "a":
            self.in_link += 1
            self.page.links[self.nodes[-1]] += 1
        self.open.append((tag, at))
        self.count[tag] += 1

    def close_to(self, tags: frozenset[str], fence: frozenset[str]) -> None:
        """Close the nearest open element of `tags`, with all inside it, unless one of `fence` stands before it."""
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag in fence:
                return
            if tag in tags:
                self.close_from(k)
                return

    def close_from(self, k: int) -> None:
        while len(self.open) > k:
            tag, at = self.open.pop()
            self.count[tag] -= 1
            if tag in UNSEEN:
                self.unseen -= 1
            if tag == "a":
                self.in_link -= 1
            if at >= 0:
                if tag not in INLINE:
                    self.boundary()
                self.run = -1
                self.nodes.pop()
                self.page.end[at] = len(self.page.parent)

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self.close_from(k)
                    return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML, save on void elements

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        if self.run < 0:
            if data.isspace():
                if self.page.tag[-1] == TEXT and self.page.block[-1] == self.blocks:
                    self.page.text[-1] += " "
                return
            self.run = self.node(TEXT, ())
        self.page.text[self.run] += data
        if self.in_link:
            self.page.linked[self.run] += len(data)


def read_page(html: str) -> Page:
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.close_from(0)
    reader.page.end[0] = len(reader.page.parent)
    return reader.page


#: Numeric features, in order.
NUMBERS = (
    "log_chars", "share", "link_density", "log_chars_a_node", "log_words_a_run", "marks_a_word", "digits_a_char", "depth", "log_nodes", "log_children", "place", "relative_place",
    "log_siblings", "log_like_siblings", "begins", "ends", "links_a_word", "log_paragraphs", "items_a_node", "log_controls", "log_headings", "parent_link_density", "parent_share",
    "log_chars_before", "link_density_before", "log_chars_behind", "link_density_behind", "is_text", "least_token", "most_token", "least_token_above", "most_token_above", "tokens_above",
    "like_siblings_share", "like_siblings_page_share", "parent_like_siblings_page_share", "names",
)


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


class Table(NamedTuple):
    """Nodes of several pages, one after another."""

    parent: np.ndarray
    depth: np.ndarray
    numbers: np.ndarray  # nodes x NUMBERS
    own: np.ndarray  # nodes x vocabulary, whether the node has the token


class Vocabulary(NamedTuple):
    number: dict[str, int]
    odds: np.ndarray  # of each token: log-odds that a node with it holds article text, against all nodes


def table_of(pages: list[Page], vocabulary: Vocabulary) -> Table:
    sizes = np.array([len(p.parent) for p in pages])
    base = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    shift = np.repeat(base, sizes)
    flat = lambda name, kind=np.int64: np.fromiter((x for p in pages for x in getattr(p, name)), dtype=kind, count=int(sizes.sum()))
    parent, end = flat("parent"), flat("end") + shift
    parent = np.where(parent >= 0, parent + shift, -1)
    n, here = len(parent), np.arange(len(parent))
    tags = [t for p in pages for t in p.tag]
    texts = [t for p in pages for t in p.text]
    depth = np.zeros(n, dtype=np.int64)
    stack = parent.tolist()
    deep = depth.tolist()
    for v, p in enumerate(stack):
        if p >= 0:
            deep[v] = deep[p] + 1
    depth = np.array(deep, dtype=np.int64)

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return (total[end] - total[here]).astype(np.float64)

    at = np.flatnonzero([bool(t) for t in texts])
    own_chars, own_words, own_marks, own_digits = (np.zeros(n) for _ in range(4))
    for v in at.tolist():
        t = texts[v]
        own_chars[v], own_words[v] = len(t), t.count(" ") + 1
        own_marks[v] = t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";")
        own_digits[v] = sum(map(t.count, "0123456789"))
    chars, words, marks, digits = map(sums, (own_chars, own_words, own_marks, own_digits))
    linked, links, controls = sums(flat("linked")), sums(flat("links")), sums(flat("controls"))
    is_ = lambda *names: sums(np.fromiter((t in names for t in tags), dtype=np.int64, count=n))
    runs, nodes, paragraphs, items, headings = is_(TEXT), (end - here).astype(np.float64), is_("p"), is_("li", "option", "td"), is_(*HEADINGS)
    page_chars = np.maximum(chars[shift], 1)
    density = linked / np.maximum(chars, 1)
    before_all = np.concatenate(([0], np.cumsum(own_chars)))
    begins, ends = (before_all[here] - before_all[shift]) / page_chars, (before_all[end] - before_all[shift]) / page_chars
    # siblings lie side by side once sorted by parent (roots apart)
    group = np.where(parent >= 0, parent, n + here)
    order = np.argsort(group, kind="stable")
    first = np.concatenate(([True], np.diff(group[order]) != 0)) if n else np.zeros(0, dtype=bool)
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, n))
    place, siblings = np.empty(n), np.empty(n)
    place[order] = np.arange(n) - np.repeat(start, count)
    siblings[order] = np.repeat(count, count)
    kinds: dict[tuple[str, ...], int] = {}  # siblings with the same tag and names are alike
    kind = np.fromiter((kinds.setdefault(names, len(kinds)) for p in pages for names in p.tokens), dtype=np.int64, count=n)
    _, which, often = np.unique(group * (len(kinds) + 1) + kind, return_inverse=True, return_counts=True)
    alike = np.bincount(which, weights=chars)[which] if n else chars
    children = np.bincount(parent[parent >= 0], minlength=n)[:n].astype(np.float64)

    def beside(values: np.ndarray, step: int) -> np.ndarray:
        out, sorted_ = np.full(n, -1.0), values[order]
        if step < 0:
            same = ~first[1:]
            out[order[1:][same]] = sorted_[:-1][same]
        else:
            same = ~first[1:]
            out[order[:-1][same]] = sorted_[1:][same]
        return out

    up_all = up = np.where(parent >= 0, parent, here)
    log = np.log1p
    columns = (
        log(chars), chars / page_chars, density, log(chars / nodes), log(words / np.maximum(runs, 1)), marks / np.maximum(words, 1), digits / np.maximum(chars, 1), np.minimum(depth, 40), log(nodes), log(children),
        np.minimum(place, 50), place / np.maximum(siblings - 1, 1), log(siblings), log(often[which]) if n else siblings, begins, ends, links / np.maximum(words, 1), log(paragraphs), items / nodes, log(controls), log(headings),
        density[up], chars[up] / page_chars, beside(log(chars), -1), beside(density, -1), beside(log(chars), 1), beside(density, 1), np.fromiter((t == TEXT for t in tags), dtype=np.float64, count=n),
    )
    own = np.zeros((n, len(vocabulary.number)), dtype=bool)
    known = [(v, k) for v, names in enumerate(x for p in pages for x in p.tokens) for t in names if (k := vocabulary.number.get(t)) is not None]
    least, most = np.zeros(n), np.zeros(n)
    if known:
        v, k = np.array(known).T
        own[v, k] = True
        np.minimum.at(least, v, vocabulary.odds[k])
        np.maximum.at(most, v, vocabulary.odds[k])
    least_above, most_above, all_above = np.zeros(n), np.zeros(n), np.zeros(n)
    for level in levels(depth)[1:]:
        up = parent[level]
        least_above[level] = np.minimum(least_above[up], least[up])
        most_above[level] = np.maximum(most_above[up], most[up])
        all_above[level] = all_above[up] + least[up] + most[up]
    named = np.fromiter((len(names) - 1 for p in pages for names in p.tokens), dtype=np.float64, count=n)
    shares = alike / np.maximum(chars[up_all], 1), alike / page_chars
    columns = np.stack([*columns, least, most, least_above, most_above, all_above, *shares, shares[1][up_all], named], axis=1).astype(np.float32)
    return Table(parent, depth, columns, own)


class Trees(NamedTuple):
    """Trees of DEPTH levels of questions, each laid out level by level: a node asks whether a feature passes a value."""

    vocabulary: Vocabulary
    base: float
    feature: np.ndarray  # trees x questions
    above: np.ndarray
    value: np.ndarray  # trees x answers


def features(t: Table) -> np.ndarray:
    return np.concatenate([t.numbers, t.own], axis=1, dtype=np.float32)


def log_odds(trees: Trees, x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), trees.base), np.arange(len(x))
    for feature, above, value in zip(trees.feature, trees.above, trees.value):
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, feature[at]] > above[at])
        out += value[at - len(feature)]
    return out


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vocabulary: Vocabulary) -> Trees:
    """Trees fitted one after another to the gradient of the logistic loss, by Newton steps; splits come from histograms."""
    n_numbers = len(NUMBERS)
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(n_numbers)]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # bin b: at most cuts[b]
    n_flags = x.shape[1] - n_numbers
    rate = (weight * y).sum() / weight.sum()
    base = float(np.log(rate / (1 - rate)))
    odds = np.full(len(x), base)
    questions = (1 << DEPTH) - 1
    feature, above, value = np.zeros((TREES, questions), dtype=np.int64), np.full((TREES, questions), np.inf), np.zeros((TREES, 1 << DEPTH))
    rng = np.random.default_rng(11)
    everything = x, y, weight, bins
    for tree in range(TREES):
        part = np.flatnonzero(rng.random(len(odds)) < SUBSAMPLE)
        x, y, weight, bins = (v[part] for v in everything)
        flagged, flag = np.nonzero(x[:, n_numbers:])
        p = 1 / (1 + np.exp(-odds[part]))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(DEPTH):
            k, start = 1 << level, (1 << level) - 1
            local = at - start
            total = [np.bincount(local, weights=v, minlength=k) for v in (g, h)]
            best, choice = np.full(k, 1e-6), [(0, np.inf)] * k
            slot = local[flagged] * n_flags + flag
            right = [np.bincount(slot, weights=v[flagged], minlength=k * n_flags).reshape(k, n_flags) for v in (g, h)]  # sums where a token is there
            whole = total[0] ** 2 / (total[1] + RIDGE)

            def gain(rg: np.ndarray, rh: np.ndarray, total=total, whole=whole) -> np.ndarray:
                lg, lh = total[0][:, None] - rg, total[1][:, None] - rh
                return np.where((rh > 1) & (lh > 1), rg**2 / (rh + RIDGE) + lg**2 / (lh + RIDGE) - whole[:, None], 0)

            found = gain(*right)
            for node in range(k):
                f = int(found[node].argmax())
                if found[node, f] > best[node]:
                    best[node], choice[node] = found[node, f], (n_numbers + f, 0.5)
            for f in range(n_numbers):
                if not len(cuts[f]):
                    continue
                width = len(cuts[f]) + 1
                sums = [np.bincount(local * width + bins[:, f], weights=v, minlength=k * width).reshape(k, width) for v in (g, h)]
                rg, rh = (s[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:] for s in sums)
                found = gain(rg, rh)
                for node in range(k):
                    b = int(found[node].argmax())
                    if found[node, b] > best[node]:
                        best[node], choice[node] = found[node, b], (f, float(cuts[f][b]))
            for node, (f, cut) in enumerate(choice):
                feature[tree, start + node], above[tree, start + node] = f, cut
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[tree, at]] > above[tree, at])
        leaf = at - questions
        value[tree] = RATE * np.bincount(leaf, weights=g, minlength=1 << DEPTH) / (np.bincount(leaf, weights=h, minlength=1 << DEPTH) + RIDGE)
        at = np.zeros(len(odds), dtype=np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (everything[0][np.arange(len(odds)), feature[tree, at]] > above[tree, at])
        odds += value[tree, at - questions]
    return Trees(vocabulary, base, feature, above.astype(np.float32), value)


def labels_of(page: Page) -> np.ndarray:
    """Whether a node of a lesson holds article text."""
    marked = np.array([lesson_pages.MARK in t for t in page.text], dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(marked)))
    return (total[np.array(page.end)] - total[:-1] > 0).astype(np.float64)


def without_marks(page: Page) -> Page:
    return page._replace(text=[t.replace(lesson_pages.MARK, "") for t in page.text])


@cache
def trained(lessons: int = LESSONS, seed: int = 7) -> Trees:
    """Trees of `lessons` generated pages."""
    pages = [read_page(lesson_pages.lesson(seed * 1_000_003 + k)) for k in range(lessons)]
    y = np.concatenate([labels_of(p) for p in pages])
    pages = [without_marks(p) for p in pages]
    counts, held = Counter(), Counter()
    for names, label in zip((x for p in pages for x in p.tokens), y.tolist()):
        counts.update(names)
        if label:
            held.update(names)
    tokens = sorted(t for t, n in counts.items() if n >= LEAST_TOKEN)
    odds = np.array([np.log((held[t] + 1) / (counts[t] - held[t] + 1)) for t in tokens]) - np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    vocabulary = Vocabulary({t: k for k, t in enumerate(tokens)}, odds)
    table = table_of(pages, vocabulary)
    return boosted(features(table), y, 4 + table.numbers[:, 0].astype(np.float64), vocabulary)


def decoded(table: Table, odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest choice in which a kept node's parent is kept, and a kept element holds a kept node.

    keep and drop are the best log-likelihoods of a subtree with its node kept or dropped; a dropped node drops its subtree.
    """
    odds = np.clip(odds, -9, 9)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    n, parent = len(odds), table.parent
    has_children = np.bincount(parent[parent >= 0], minlength=n)[:n] > 0
    is_text = table.numbers[:, NUMBERS.index("is_text")] > 0
    keep, drop = yes.copy(), no.copy()
    short = np.full(n, np.inf)  # what the best child loses by being kept against its better choice
    by_level = levels(table.depth)
    for level in reversed(by_level):
        keep[level] += np.where(has_children[level], short[level], np.where(is_text[level], 0, np.inf)) * -1
        inner = level[parent[level] >= 0]
        best = np.maximum(keep[inner], drop[inner])
        np.add.at(keep, parent[inner], best)
        np.add.at(drop, parent[inner], drop[inner])
        np.minimum.at(short, parent[inner], best - keep[inner])
    kept = np.zeros(n, dtype=bool)
    lose = np.maximum(keep, drop) - keep
    for level in by_level:
        root = parent[level] < 0
        inside = np.where(root, True, kept[parent[level]])
        # a parent that needs a child keeps the one that loses least
        forced = np.where(root, False, inside & (lose[level] == short[parent[level]]))
        kept[level] = inside & ((keep[level] > drop[level]) | forced)
    return kept


def joined(page: Page, kept: np.ndarray) -> str:
    """The kept runs: white space is one space, runs of a block are one line, blocks are parted by two line ends."""
    out: dict[int, list[str]] = {}
    for v in np.flatnonzero(kept).tolist():
        if page.block[v] >= 0:
            out.setdefault(page.block[v], []).append(page.text[v])
    found = (" ".join("".join(x).split()) for x in out.values())
    return "\n\n".join(x for x in found if x)


def extracted(htmls: list[str], trees: Trees) -> list[str]:
    pages = [read_page(h) for h in htmls]
    table = table_of(pages, trees.vocabulary)
    kept = decoded(table, log_odds(trees, features(table)))
    out, at = [], 0
    for p in pages:
        out.append(joined(p, kept[at : at + len(p.parent)]))
        at += len(p.parent)
    return out


def main_text(pages: DataFrame, html: str = "html", into: str = "text", trees: Trees | None = None) -> DataFrame:
    """`pages` with the article's text in `into`; never null."""
    held = small_batches(pages).sparkSession.sparkContext.broadcast(trained() if trees is None else trees)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([x for block in blocks(htmls) for x in extracted(block, held.value)], dtype=object)
        released()

    return pages.withColumn(into, extract.asNondeterministic()(F.col(html)))


def digest(pages: DataFrame) -> DataFrame:
    """What query op13 returns."""
    found = main_text(spread(pages.select("page_id", "url", "html")))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
