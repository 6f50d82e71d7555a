"""Text of pages whose site has a rule: where the readable parts are, as selectors, and what to leave out of them.

A rule holds for a host and all below it. Its selectors are tried in order on the page's nodes; what several of them find is
taken once, at the first. Selectors are compiled to predicates over a node's tag, id, classes and attributes, and to equi-joins
of a node's path of ancestors with the nodes that match the part before. A page without a rule, or whose rule finds nothing
(sites change), is read by the generic scorer.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.sources import html

RULES = "host string, kind string, roots array<string>, skip array<string>"
# Rules for sites that the generic scorer can't read: host, kind, selectors of readable parts, selectors of what is left out of them (fixed values).
_OUTLOOK = ('[role="heading"][aria-level="2"]', 'div[role="document"]'), ("blockquote", "#Signature", '[id^="divRplyFwdMsg"]')
SHIPPED = (
    ("mail.google.com", "mail", ("h2.hP", "div.a3s"), (".gmail_quote", ".gmail_signature", "blockquote", ".adL", ".gmail_extra", "[data-smartmail=gmail_signature]")),
    ("outlook.live.com", "mail", *_OUTLOOK),
    ("outlook.office.com", "mail", *_OUTLOOK),
    ("outlook.office365.com", "mail", *_OUTLOOK),
    ("news.ycombinator.com", "article", (".fatitem .titleline", ".fatitem .toptext", ".comment .commtext"), (".reply", ".navs")),
)


class Part(NamedTuple):
    """One element of a selector: what it asks of a node, and whether the part before must be its parent."""

    tag: str | None
    element_id: str | None
    classes: tuple[str, ...]
    attributes: tuple[tuple[str, str, str], ...]  # name, operator ("" asks that it is there), value
    child: bool


_SIMPLE = re.compile(r"""([\w-]+|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]"']+))\s*)?\]""")


def parsed(selector: str) -> list[list[Part]]:
    """The alternatives of a selector, each a chain of parts. Understands tags, *, #id, .class, [attribute], descendants and
    children; anything else is refused rather than guessed."""
    out, at, chain, child, fresh = [], 0, [], False, True
    parts: list = [None, None, [], []]
    selector = selector.strip() + ","
    while at < len(selector):
        if (m := _SIMPLE.match(selector, at)) and not (m[1] and (parts[0] or not fresh)):
            tag, name, cls, attribute, op, *values = m.groups()
            if tag:
                parts[0] = tag.lower()
            elif name:
                parts[1] = name
            elif cls:
                parts[2].append(cls)
            else:
                parts[3].append((attribute.lower(), op or "", next((v for v in values if v is not None), "")))
            at, fresh = m.end(), False
        elif m := re.compile(r"\s*([>,])\s*|\s+").match(selector, at):
            if fresh:
                raise ValueError(f"selector not understood: {selector[:-1]}")
            chain.append(Part(parts[0], parts[1], tuple(parts[2]), tuple(parts[3]), child))
            parts, fresh, child, at = [None, None, [], []], True, m[1] == ">", m.end()
            if m[1] == ",":
                out.append(chain)
                chain = []
        else:
            raise ValueError(f"selector not understood: {selector[:-1]}")
    if not fresh or chain or not out:
        raise ValueError(f"selector not understood: {selector[:-1]}")
    return out


def _asks(part: Part) -> Column:
    """Whether a node is what the part asks for."""
    asked = [F.col("tag") != "#text"]
    if part.tag and part.tag != "*":
        asked.append(F.col("tag") == part.tag)
    if part.element_id is not None:
        asked.append(F.col("element_id") == part.element_id)
    asked += [F.array_contains("classes", c) for c in part.classes]
    for name, op, wanted in part.attributes:
        value = F.element_at("attrs", F.lit(name))
        tests = {
            "": value.isNotNull(), "=": value == wanted, "^=": value.startswith(wanted) & F.lit(wanted != ""), "$=": value.endswith(wanted) & F.lit(wanted != ""),
            "*=": value.contains(wanted) & F.lit(wanted != ""), "~=": F.array_contains(F.split(value, r"\s+"), wanted), "|=": (value == wanted) | value.startswith(f"{wanted}-"),
        }
        asked.append(tests[op])
    return F.coalesce(reduce(lambda a, b: a & b, asked), F.lit(False))


def matches(nodes: DataFrame, selector: str) -> DataFrame:
    """(page_id, node) of the elements that the selector finds, each once."""
    found = None
    for chain in parsed(selector):
        held = None
        for part in chain:
            own = nodes.where(_asks(part)).select("page_id", "node", "path")
            if held is None:
                held = own
                continue
            above = held.select("page_id", F.col("node").alias("ancestor"))
            by = F.slice("path", -1, 1) if part.child else F.col("path")
            under = own.where(F.size("path") > 0).select("page_id", "node", F.explode(by).alias("ancestor")).join(above, ["page_id", "ancestor"], "left_semi").select("page_id", "node").distinct()
            held = own.join(under, ["page_id", "node"], "left_semi")
        held = held.select("page_id", "node")
        found = held if found is None else found.unionByName(held)
    return found.distinct()


def rules_table(spark: SparkSession, rules=SHIPPED) -> DataFrame:
    return spark.createDataFrame([(h, k, list(r), list(s)) for h, k, r, s in rules], RULES)


def rule_of(pages: DataFrame, rules: DataFrame, host: Column, page_id: str = "page_id") -> DataFrame:
    """(page_id, host, kind, roots, skip): the rule of the longest domain that is the page's host or above it; never one label."""
    labels = F.split(F.lower(host), r"\.")
    known = pages.select(F.col(page_id).alias("page_id"), labels.alias("labels")).where(F.size("labels") > 1)
    domains = known.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels") - 1), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("host"))
    own = rules.withColumn("host", F.lower("host")).where(F.col("host").contains("."))
    return domains.join(own, "host").groupBy("page_id").agg(F.max_by(F.struct("host", "kind", "roots", "skip"), F.length("host")).alias("r")).select("page_id", "r.*")


def selected(nodes: DataFrame, ruled: DataFrame, column: str) -> DataFrame:
    """(page_id, node, place): what the selectors of a column of the pages' rules find, with the place of the first that does."""
    asked = ruled.select("page_id", F.posexplode(column).alias("place", "selector"))
    selectors = [r[0] for r in asked.select("selector").distinct().orderBy("selector").collect()]  # of the rules, not of the pages
    found = nodes.select("page_id", "node").limit(0).withColumn("place", F.lit(0))
    for selector in selectors:
        pages = asked.where(F.col("selector") == selector)
        own = nodes.join(pages.select("page_id"), "page_id", "left_semi")
        found = found.unionByName(matches(own, selector).join(pages.select("page_id", "place"), "page_id").select("page_id", "node", "place"))
    return found.groupBy("page_id", "node").agg(F.min("place").alias("place"))


def site_blocks(nodes: DataFrame, ruled: DataFrame) -> DataFrame:
    """(page_id, place, root, block, role, text): blocks under the readable parts of pages that have a rule, in the order of
    (place, root, block). Hidden parts, parts inside what is left out, and blocks of fewer than two characters go."""
    # kept, since every selector asks it again and the parser need not run for each
    nodes, ruled = nodes.join(ruled.select("page_id"), "page_id", "left_semi").cache(), ruled.cache()
    skip = selected(nodes, ruled, "skip").select("page_id", F.col("node").alias("ancestor"))
    within = nodes.select("page_id", "node", F.explode(F.concat("path", F.array("node"))).alias("ancestor"))
    left_out = within.join(skip, ["page_id", "ancestor"], "left_semi").select("page_id", "node").distinct().cache()
    shown = nodes.where(~F.coalesce("hidden", F.lit(False))).select("page_id", "node")
    roots = selected(nodes, ruled, "roots").join(shown, ["page_id", "node"], "left_semi").join(left_out, ["page_id", "node"], "left_anti").cache()
    texts = nodes.where("tag = '#text'").join(left_out, ["page_id", "node"], "left_anti")
    # furniture inside a readable part is skipped as elsewhere; a part that is itself skipped was asked for by name
    owned = texts.select("page_id", "node", "block", "text", "skipped", F.explode("path").alias("root")).join(roots.withColumnRenamed("node", "root"), ["page_id", "root"])
    asked = nodes.select("page_id", F.col("node").alias("root"), F.col("skipped").alias("root_skipped"))
    owned = owned.join(asked, ["page_id", "root"]).where("not skipped or root_skipped")
    whole = owned.groupBy("page_id", "place", "root", "block").agg(F.sort_array(F.collect_list(F.struct("node", "text"))).alias("all"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("all", lambda x: x["text"]), ""), r"\s+", " "))
    role = F.create_map(*(F.lit(x) for pair in html.ROLES.items() for x in pair))
    tags = nodes.select("page_id", F.col("node").alias("block"), "tag")
    named = whole.select("page_id", "place", "root", "block", text.alias("text")).where(F.length("text") >= 2).join(tags, ["page_id", "block"])
    return named.select("page_id", "place", "root", "block", F.coalesce(F.element_at(role, F.col("tag")), F.lit("paragraph")).alias("role"), "text")


def read_blocks(nodes: DataFrame, ruled: DataFrame) -> DataFrame:
    """(page_id, by_rule, place, root, block, role, text): by the page's rule where it finds text, else by the generic scorer."""
    own = site_blocks(nodes, ruled).cache()
    rest = nodes.join(own.select("page_id").distinct(), "page_id", "left_anti").cache()
    roots = html.article_roots(rest)
    generic = html.blocks(rest, roots).join(roots, "page_id").select("page_id", F.lit(0).alias("place"), "root", "block", "role", "text")
    return own.withColumn("by_rule", F.lit(True)).unionByName(generic.withColumn("by_rule", F.lit(False)))
