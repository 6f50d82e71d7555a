"""What captures of screens and windows need: choosing, matching and merging rows. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.identity import letters_key


def without_navigation(parts: DataFrame) -> DataFrame:
    """Parts (window, pos, kind, text): where three texts or more are long, short links that end no sentence go."""
    long_ = F.sum(((F.col("kind") != "link") & (F.length("text") > 80)).cast("int")).over(Window.partitionBy("window"))
    short_link = (F.col("kind") == "link") & (F.length("text") <= 45) & ~F.col("text").rlike("[.!?]")
    return parts.withColumn("_long", long_).where((F.col("_long") < 3) | ~short_link).drop("_long")


#: A screen of the machine: number, left, top, width, height, and whether it is the primary one.
Monitor = tuple[int, int, int, int, int, bool]


def containing_monitor(points: DataFrame, monitors: list[Monitor]) -> DataFrame:
    """(point, monitor): the first monitor whose rectangle holds a point (x, y), else the primary, else the first."""
    ranks = []
    for number, left, top, width, height, primary in monitors:
        inside = F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)
        ranks.append(F.struct(F.when(inside, 0).otherwise(1 if primary else 2).alias("rank"), F.lit(number).alias("monitor")))
    return points.select("point", F.array_min(F.array(*ranks))["monitor"].alias("monitor"))


def nearest_screen(points: DataFrame, monitors: list[Monitor]) -> DataFrame:
    """(point, monitor): the screen whose rectangle is least far from a point."""
    out = lambda v, low, size: F.greatest(F.lit(low) - F.col(v), F.col(v) - (low + size), F.lit(0))
    far = [F.struct((F.pow(out("x", a, w), 2) + F.pow(out("y", b, h), 2)).alias("far"), F.lit(n).alias("monitor")) for n, a, b, w, h, _ in monitors]
    return points.select("point", F.array_min(F.array(*far))["monitor"].alias("monitor"))


def overlap_lines(previous: Column, current: Column) -> Column:
    """How many of previous's last lines are current's first ones, the longest such run; arrays of lines, letters compared."""
    a, b = F.transform(previous, letters_key), F.transform(current, letters_key)

    def longest(both: Column) -> Column:
        n = F.least(F.size(both["a"]), F.size(both["b"]))
        sizes = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        fits = F.filter(sizes, lambda k: F.slice(both["a"], F.size(both["a"]) - k + 1, k) == F.slice(both["b"], F.lit(1), k))
        return F.coalesce(F.array_max(fits), F.lit(0))

    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), longest), 1)


def continued(captures: DataFrame) -> DataFrame:
    """(watch, seq, added, continues) of captures (watch, seq, text): the batch twin of the stream that watches a region."""
    lines = F.filter(F.split("text", "\n"), lambda x: letters_key(x) != "")
    order = Window.partitionBy("watch").orderBy("seq")
    rows = captures.withColumn("lines", lines).withColumn("old", F.lag("lines").over(order))
    size = F.when(F.col("old").isNull(), 0).otherwise(overlap_lines(F.col("old"), F.col("lines")))
    rows = rows.withColumn("n", size)
    carries = (F.col("n") > 1) | ((F.col("n") == 1) & (F.least(F.size("old"), F.size("lines")) == 1))
    added = F.when(carries, F.slice("lines", F.col("n") + 1, F.greatest(F.size("lines"), F.lit(1)))).otherwise(F.col("lines"))
    return rows.select("watch", "seq", F.array_join(added, "\n").alias("added"), carries.alias("continues"))


def merged_feed(rows: DataFrame) -> DataFrame:
    """(watch, row, text): captures that carry on are appended to the row they carry on from."""
    order = Window.partitionBy("watch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("row", F.sum((~F.col("continues")).cast("int")).over(order))
    whole = rows.groupBy("watch", "row").agg(F.sort_array(F.collect_list(F.struct("seq", "added"))).alias("all"))
    return whole.select("watch", "row", F.array_join(F.filter(F.transform("all", lambda x: x["added"]), lambda t: t != ""), "\n").alias("text"))


def schedule(chunks: DataFrame, lead: float = 0.25) -> DataFrame:
    """(stream, seq, start): when each chunk (stream, seq, now, seconds, rate) starts: after the last, or `lead` from now.

    The running clock max(cursor, now + lead) + seconds / rate is a running maximum once the seconds before are taken off.
    """
    order = Window.partitionBy("stream").orderBy("seq")
    before = F.coalesce(F.sum(F.col("seconds") / F.col("rate")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = chunks.withColumn("before", before)
    start = F.max(F.col("now") + lead - F.col("before")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    return rows.select("stream", "seq", start.alias("start"))


def ranked_choice(candidates: DataFrame) -> DataFrame:
    """(doc, source, notes): of candidates (doc, rung, source, text, note) the first rung with a text; notes in order, once each."""
    ok = F.col("text").isNotNull() & (F.trim("text") != "")
    found = candidates.groupBy("doc").agg(F.min_by("source", F.when(ok, F.col("rung"))).alias("source"), F.sort_array(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("rung", "note")))).alias("n"))
    return found.select("doc", "source", F.array_join(F.array_distinct(F.transform("n", lambda x: x["note"])), "; ").alias("notes"))
