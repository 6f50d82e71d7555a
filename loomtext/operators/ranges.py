"""Places in a block's text and places in the page's own texts, in both directions.

A block's text has its white space collapsed; the page's text nodes have not. A piece is what one text node adds to its
block's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = ["page_id", "block"]


def collapsed(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def pieces(found: DataFrame, roots: DataFrame) -> DataFrame:
    """(page_id, block, node, raw, start, end): the text nodes of the blocks that `sources.html.blocks` gives for the same
    nodes and roots; start and end count characters of the block's text. Nodes of white space alone have no piece, but part
    their neighbours. Starts are running sums within a block: nodes are sorted, not gathered."""
    texts = found.where("tag = '#text' and not skipped").join(roots, "page_id").where(F.array_contains("path", F.col("root")))
    by = Window.partitionBy(*_BLOCK).orderBy("node")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = texts.select(*_BLOCK, "node", F.col("text").alias("raw"), F.length(collapsed(F.col("text"))).alias("_n"))
    parted = F.col("raw").rlike(r"^\s") | F.coalesce(F.lag(F.col("raw").rlike(r"\s\z")).over(by), F.lit(False))
    rows = rows.withColumns({"_parted": parted, "_some": F.coalesce(F.sum("_n").over(before), F.lit(0)) > 0})
    rows = rows.withColumn("_gap", (F.col("_parted") & F.col("_some") & (F.col("_n") > 0)).cast("int"))
    rows = rows.withColumn("end", F.sum(F.col("_gap") + F.col("_n")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where("_n > 0").select(*_BLOCK, "node", "raw", (F.col("end") - F.col("_n")).alias("start"), "end")


def raw_offset(raw: Column, want: Column) -> Column:
    """Where the character `want` of a node's collapsed text stands in the node; leading white space is passed, behind the
    text is behind its last character that counts (behind all white space, if asked for more)."""
    body = F.regexp_replace(raw, r"^\s+", "")
    units = F.regexp_extract_all(body, F.lit(r"(?s)\s+|\S"), 0)
    inside = F.length(F.array_join(F.slice(units, 1, F.greatest(want, F.lit(0)).cast("int")), ""))
    return (F.length(raw) - F.length(body) + inside).cast("int")


def node_ranges(spans: DataFrame, parts: DataFrame) -> DataFrame:
    """Spans (page_id, block, idx, start, end) of block texts with start_node, start_offset, end_node, end_offset.

    A span begins in the first piece that ends behind its start and ends in the first that reaches its end, else behind the
    last piece; a place between two pieces moves to the beginning of the later one. Spans that begin behind the block's text
    have no row. Each look-up is a running value over the block's places from the last to the first, so neither spans nor
    pieces of a large block meet all of the other.
    """
    # from the end: at the same place a start comes before the piece's end (which must lie behind it), an end after it
    marks = parts.select(*_BLOCK, F.col("end").alias("_at"), F.lit(1).alias("_turn"), F.col("node").alias("_tie"), F.struct("node", "raw", "start", "end").alias("_piece"), F.lit(None).cast("long").alias("idx"))
    ask = lambda c, turn: spans.select(*_BLOCK, F.col(c).alias("_at"), F.lit(turn).alias("_turn"), F.lit(0).alias("_tie"), F.lit(None).cast(marks.schema["_piece"].dataType).alias("_piece"), F.col("idx").cast("long").alias("idx"))
    back = Window.partitionBy(*_BLOCK).orderBy(F.desc("_at"), "_turn", F.desc("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.unionByName(ask("start", 0)).unionByName(ask("end", 2))
    rows = rows.withColumn("_hit", F.last("_piece", True).over(back))
    place = lambda p: F.struct(p["node"].alias("node"), raw_offset(p["raw"], F.col("_at") - p["start"]).alias("offset"))
    starts = rows.where("_turn = 0 and _hit is not null").select(*_BLOCK, "idx", place(F.col("_hit")).alias("s"))
    # an end behind all pieces sees none of them before itself: the block's last piece is joined then
    ends = rows.where("_turn = 2").select(*_BLOCK, "idx", "_at", "_hit")
    last = parts.groupBy(*_BLOCK).agg(F.max(F.struct("end", "node", F.length("raw").alias("n"))).alias("_l"))
    ends = ends.join(last, _BLOCK, "left").select(*_BLOCK, "idx", F.when(F.col("_hit").isNotNull(), place(F.col("_hit"))).otherwise(F.struct(F.col("_l.node").alias("node"), F.col("_l.n").cast("int").alias("offset"))).alias("e"))
    both = starts.join(ends, [*_BLOCK, "idx"])
    return both.select(*_BLOCK, "idx", F.col("s.node").alias("start_node"), F.col("s.offset").alias("start_offset"), F.col("e.node").alias("end_node"), F.col("e.offset").alias("end_offset"))


def sentences_at(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """(point, sentence) for points (point, page_id, node, offset): the first sentence of the page whose range holds the
    point, both ends included; -1 if none does. ranges: as `node_ranges` gives them, with `sentence`, a number in page order."""
    p = points.select("point", "page_id", F.struct("node", "offset").alias("_p"))
    r = ranges.select("page_id", "sentence", F.struct("start_node", "start_offset").alias("_s"), F.struct("end_node", "end_offset").alias("_e"))
    hit = p.join(r, "page_id").where(F.col("_p").between(F.col("_s"), F.col("_e"))).groupBy("point").agg(F.min("sentence").alias("sentence"))
    return points.select("point").distinct().join(hit, "point", "left").select("point", F.coalesce("sentence", F.lit(-1)).cast("long").alias("sentence"))
