"""Page furniture: running heads and page numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A line that is only a page number, by dialect (fixed patterns).
PAGE_NUMBER = {"blocktext": r"(?i)^\s*(?:page\s*)?\p{Nd}{1,4}\s*(?:/\s*\p{Nd}{1,4})?\s*$", "offsets": r"^\s*\d{1,4}\s*$"}


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc, page, pos, line, at, n_lines) of pages (doc, page, text); at and n_lines count the lines that aren't blank."""
    rows = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("full", F.trim("line") != "")
    by_page = Window.partitionBy("doc", "page")
    at = F.when(F.col("full"), F.sum(F.col("full").cast("int")).over(by_page.orderBy("pos")))
    return rows.withColumn("at", at).withColumn("n_lines", F.sum(F.col("full").cast("int")).over(by_page)).drop("full")


def running_heads(pages: DataFrame, dialect: str = "blocktext") -> DataFrame:
    """(doc, key) of lines at page edges that repeat over a document's pages.

    "blocktext": the same line, of 90 characters or fewer, among two lines at an edge, on 60% of three pages or more.
    "offsets": digits stand for each other, 80 characters, one line at an edge on short pages, on half the pages.
    """
    rows, n_pages = page_lines(pages), pages.groupBy("doc").agg(F.countDistinct("page").alias("n_pages"))
    if dialect == "blocktext":
        key, most, edge = F.trim("line"), 90, F.lit(2)
        least = F.greatest(F.lit(2), F.floor(F.col("n_pages") * 0.6))
    else:
        key, most, edge = F.regexp_replace(F.trim("line"), r"\d+", "#"), 80, F.when(F.col("n_lines") > 5, 2).otherwise(1)
        least = F.greatest(F.lit(3), F.ceil(F.col("n_pages") * 0.5))
    edges = rows.where((F.col("at") <= edge) | (F.col("at") > F.col("n_lines") - edge)).withColumn("key", key)
    edges = edges.where(F.length("key") <= most) if dialect == "blocktext" else edges.where((F.length("line") <= most) & (F.length("key") >= 2))
    counts = edges.groupBy("doc", "key").agg(F.countDistinct("page").alias("n"))
    return counts.join(n_pages.where("n_pages >= 3"), "doc").where(F.col("n") >= least).select("doc", "key")


def without_furniture(pages: DataFrame, dialect: str = "blocktext") -> DataFrame:
    """(doc, page, text) less running heads and page numbers; blank lines stay, and so do pages of which nothing is left.

    "offsets" leaves documents of fewer than three pages as they are.
    """
    rows = page_lines(pages)
    key = F.trim("line") if dialect == "blocktext" else F.regexp_replace(F.trim("line"), r"\d+", "#")
    heads = running_heads(pages, dialect).withColumn("head", F.lit(True))
    marked = rows.withColumn("key", key).join(heads, ["doc", "key"], "left")
    number = F.col("line").rlike(PAGE_NUMBER[dialect])
    if dialect == "offsets":
        n_pages = pages.groupBy("doc").agg(F.countDistinct("page").alias("n_pages"))
        marked, number = marked.join(n_pages, "doc"), number & (F.col("n_pages") >= 3)
    kept = F.when(F.col("head").isNull() & ~number, F.struct("pos", "line"))
    lines = marked.groupBy("doc", "page").agg(F.sort_array(F.collect_list(kept)).alias("all"))
    return lines.select("doc", "page", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("text"))
