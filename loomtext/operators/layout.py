"""Page layout: from placed glyph runs to lines, columns and running text.

Items are (page, str, x, y, width, height), y growing upwards. A page is one row while its items are looked at together
(their number is bounded by what a page holds), and pages are independent, so nothing but the gather by page is shuffled,
once. What a lambda needs of its page is settled before it (`once`): named as a column, it would be worked out for each item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.normalize import once

TOLERANCE, COLUMN_GAP, COLUMN_SHARE, LEAST_ITEMS = 0.5, 0.06, 0.15, 8
SPACE_GAP, PARAGRAPH_GAP, USUAL_HEIGHT = 0.2, 1.6, 10.0
#: Where a corridor is looked for: so many places a hundredth of the width apart, from a quarter of it on.
COLUMN_PLACES = 51


def _usable(items: DataFrame) -> DataFrame:
    return items.where(F.col("str").rlike(r"\S")).select("page", "str", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")))


def _quantile(values: Column, share: float) -> Column:
    """Of an array: the quantile, between two values in proportion; null if it is empty."""

    def between(s: Column) -> Column:
        at = share * (F.size(s) - 1)
        low = F.get(s, F.floor(at).cast("int"))
        return low + (at - F.floor(at)) * (F.get(s, F.ceil(at).cast("int")) - low)

    return once(F.sort_array(values), lambda s: F.when(F.size(s) > 0, between(s)))


def _median(values: Column) -> Column:
    """Of an array: the middle of its values other than 0, or the usual height."""
    return F.coalesce(_quantile(F.filter(values, lambda h: h != 0), 0.5), F.lit(USUAL_HEIGHT))


def _crossed(page_width: float) -> Column:
    """Of an item: the places of COLUMN_PLACES that it crosses, as bits; all of them if it isn't known."""
    at = [page_width * (0.25 + 0.01 * k) for k in range(COLUMN_PLACES)]
    right = F.col("x") + F.col("width")
    bits = reduce(Column.bitwiseOR, (F.when((F.col("x") < a) & F.coalesce(right > a, F.lit(True)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, a in enumerate(at)))
    return F.when(F.col("x").isNull(), F.lit((1 << COLUMN_PLACES) - 1)).otherwise(bits)


def columns(items: DataFrame, page_width: float) -> DataFrame:
    """Items with `col`: 1 right of a corridor that no item crosses and that is wide enough, if both sides hold a real share
    of the page's text; else 0."""
    usable = _usable(items)
    item = F.struct("str", "x", "y", "width", "height")
    whole = usable.groupBy("page").agg(F.bit_or(_crossed(page_width)).alias("crossed"), F.sum(F.length("str")).alias("n_chars"), F.collect_list(item).alias("all"))
    free = F.filter(F.sequence(F.lit(0), F.lit(COLUMN_PLACES - 1)), lambda k: F.getbit("crossed", k) == 0)
    middle = lambda f: F.lit(page_width) * (F.lit(0.25) + F.lit(0.01) * F.get(f, F.floor(F.size(f) / 2).cast("int")))
    wide = lambda f: (F.get(f, F.size(f) - 1) - F.get(f, F.lit(0))) * 0.01 >= COLUMN_GAP
    total = lambda side: F.aggregate(F.filter("all", side), F.lit(0), lambda acc, i: acc + F.length(i["str"]))

    def real(split: Column) -> Column:
        """The corridor, if there is text enough on both sides."""
        least = F.least(total(lambda i: i["x"] + i["width"] <= split), total(lambda i: i["x"] >= split))
        return once(least, lambda n: F.when((n >= COLUMN_SHARE * F.col("n_chars")) & (n > 0), split))

    corridor = once(free, lambda f: F.when((F.size("all") >= LEAST_ITEMS) & wide(f), middle(f)))
    split = F.when(F.col("page").isNotNull(), once(corridor, lambda s: F.when(s.isNotNull(), real(s))))
    found = whole.select("page", split.alias("split"), F.explode("all").alias("i")).select("page", "split", "i.*")
    return found.withColumn("col", F.coalesce((F.col("x") >= F.col("split")).cast("int"), F.lit(0))).drop("split")


def lines(items: DataFrame) -> DataFrame:
    """(page, col, row, y, x, right, text): the lines of each column from the top. Items within half the usual height of a
    line's first one belong to it; a space stands where two are apart."""
    if "col" not in items.columns:
        items = _usable(items).withColumn("col", F.lit(0))
    run = F.struct((-F.col("y")).alias("down"), "x", "str", "width", "height")
    whole = items.groupBy("page", "col").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    start = F.struct(F.array().cast("array<int>").alias("rows"), F.lit(-1).alias("row"), F.lit(None).cast("double").alias("head"))

    def numbered(near: Column) -> Column:
        def place(acc: Column, r: Column) -> Column:
            def put(new: Column) -> Column:
                row = acc["row"] + new.cast("int")
                return F.struct(F.concat(acc["rows"], F.array(row)).alias("rows"), row.alias("row"), F.when(new, r["down"]).otherwise(acc["head"]).alias("head"))

            return once(F.coalesce(F.abs(r["down"] - acc["head"]) > near, F.lit(True)), put)

        return F.aggregate("runs", start, place, lambda acc: acc["rows"])

    number = once(TOLERANCE * _median(F.transform("runs", lambda r: r["height"])), numbered)
    dealt = whole.select("page", "col", F.posexplode(F.arrays_zip("runs", number.alias("row"))).alias("pos", "i"))
    run = F.struct("i.runs.x", "pos", "i.runs.str", "i.runs.width", "i.runs.height", (-F.col("i.runs.down")).alias("y"))
    by_row = dealt.groupBy("page", "col", F.col("i.row").alias("row")).agg(F.sort_array(F.collect_list(run)).alias("all"))
    none = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("right"))

    def joined(gap: Column) -> Column:
        def join(acc: Column, i: Column) -> Column:
            apart = F.coalesce((i["x"] - acc["right"] > gap) & ~acc["text"].rlike(r"\s\z"), F.lit(False))
            return F.struct(F.concat(acc["text"], F.when(apart, " ").otherwise(""), i["str"]).alias("text"), (i["x"] + i["width"]).alias("right"))

        return F.aggregate("all", none, join, lambda acc: acc["text"])

    gap = SPACE_GAP * _median(F.transform("all", lambda i: i["height"]))
    text = F.trim(F.regexp_replace(once(gap, joined), r"\s+", " "))
    right = F.array_max(F.transform("all", lambda i: i["x"] + i["width"]))
    first = F.get("all", F.lit(0))
    return by_row.select("page", "col", "row", first["y"].alias("y"), first["x"].alias("x"), right.alias("right"), text.alias("text"))


def texts(page_lines: DataFrame) -> DataFrame:
    """(page, text): lines joined in order; a gap well above the usual one starts a paragraph, a word that a line end broke
    between small letters is joined again."""
    line = F.struct("col", "row", "y", "text")
    whole = page_lines.groupBy("page").agg(F.sort_array(F.collect_list(line)).alias("all"))
    gaps = F.filter(F.transform("all", lambda s, i: F.when(i > 0, F.get("all", i - 1)["y"] - s["y"])), lambda g: g > 0)
    normal = F.coalesce(_quantile(gaps, 0.25), F.lit(0.0))
    none = F.struct(F.lit("").alias("out"), F.lit(None).cast("double").alias("y"))

    def join(normal: Column, acc: Column, s: Column) -> Column:
        paragraph = (normal > 0) & (acc["y"] - s["y"] > normal * PARAGRAPH_GAP)
        broken = acc["out"].rlike("[a-z]-\\z") & s["text"].rlike("^[a-z]")
        out = (
            F.when(acc["y"].isNull(), s["text"])
            .when(paragraph, F.concat(acc["out"], F.lit("\n\n"), s["text"]))
            .when(broken, F.concat(F.substring(acc["out"], F.lit(1), F.length(acc["out"]) - 1), s["text"]))
            .when(acc["out"].rlike(r"\s\z"), F.concat(acc["out"], s["text"]))
            .otherwise(F.concat(acc["out"], F.lit(" "), s["text"]))
        )
        return F.struct(out.alias("out"), s["y"].alias("y"))

    joined = once(normal, lambda n: F.aggregate("all", none, lambda acc, s: join(n, acc, s), lambda acc: acc["out"]))
    return whole.select("page", F.trim(F.regexp_replace(joined, r"[ \t]+", " ")).alias("text"))
