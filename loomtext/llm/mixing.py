"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate in (0, 2), the copies the mix takes of it on average. Of all rates whose words add up
to each source's target, those with the greatest entropy (against the bounds 0 and 2) are exponentially tilted:
rate = 2 / (1 + exp(-tilt * size / mean size)). The tilts solve the convex dual, whose gradient for a source is
the words its rates take less its target; distributed Newton steps, kept inside a shrinking bracket, find them.
The steps run on the counts of (source, size), which the rates depend on alone, so a hot source is summed before
any shuffle and no step reads texts. Rates are then rounded into whole copies (0, 1 or 2) by a hash of the id,
and single documents whose size fits what a source still lacks or has too much are moved by one copy.

Null sources are a source of their own, the last; null texts have size 0. Documents of size 0 take 0 words. A
source whose target is 0 or twice its size takes none or all of its documents twice. Rows that repeat an id and a text in
a source get equal copies; rows that share an id alone, or have none, are told apart by their texts. Rounding hashes ids and texts only, so reruns agree. An empty table gives an empty result. A very long text is
counted whole and is one number from then on.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import cut, staged

WEIGHTS, SHARE, BOUND = (3, 1, 2), 1.5, 2
NEWTON_STEPS, TOLERANCE, SPARE = 40, 1e-4, 8


def sized(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    n_words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(*keep, text_mark(F.col(text)).alias("mark"), n_words.cast("long").alias("size"))


def text_mark(text: Column) -> Column:
    """Tells rows that share an id but not a text apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def numbered(by_source: DataFrame) -> DataFrame:
    """`by_source` with `place`: from 0, by code point, null last. Sources are sorted in ranges, each numbered by itself from
    where the one before ends, so that no task holds them all; a count a range reaches the driver."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    ranged = by_source.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = staged(ranged)
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    starts, at = [], 0
    for k in sorted(sizes):
        starts += [F.lit(k), F.lit(at)]
        at += sizes[k]
    start = F.element_at(F.create_map(*starts), F.col("range")) if starts else F.lit(0)
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranged.withColumn("place", start + within).drop("range")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, bound: int = BOUND) -> DataFrame:
    """(source, source_size, target): `share` of all words by weight, no source above `bound` times its own words.

    Targets are min(bound * size, weight * level) for the one level that spends the whole. The level is raised until no
    further source is filled by it: each time, what the filled ones leave is shared by the others' weights, two plain sums.
    """
    by_source = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)).cast("double")
    known = cut(by_source.select("source", "source_size", weight.alias("weight"), (bound * F.col("source_size")).cast("double").alias("cap")))
    whole = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    level, n_full = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("cap")
        n, spent, open_ = known.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == n_full or not open_:
            break
        n_full, level = n, (whole - spent) / open_
    if open_ == 0:
        level = float("inf")
    target = F.when(F.lit(level == float("inf")), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.lit(level if level < float("inf") else 0.0)))
    return known.select("source", "source_size", target.alias("target"))


def rate(tilt: Column, size: Column, unit: Column) -> Column:
    return F.lit(float(BOUND)) / (1 + F.exp(-tilt * size / unit))


def tilts(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, tilt, unit) for each source with a target between 0 and its bound, by Newton steps on the dual.

    counts: (source, size, n). unit is the source's mean size over documents with words. A step is no longer than
    three times the tilt (1 at least) and stays inside the bracket that earlier steps left, else it halves it.
    """
    counts = counts.where("size > 0").withColumnRenamed("source", "c_source")
    units = counts.groupBy("c_source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"))
    state = cut(
        wanted.where(f"target > 0 and target < {BOUND} * source_size")
        .join(units, F.col("c_source").eqNullSafe(F.col("source")))
        .select("source", "target", "unit", F.lit(0.0).alias("tilt"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
    )
    for _ in range(NEWTON_STEPS):
        scaled, r = F.col("size") / F.col("unit"), rate(F.col("tilt"), F.col("size"), F.col("unit"))
        taken = F.col("n") * F.col("size") * r
        sums = (
            counts.join(state, F.col("c_source").eqNullSafe(F.col("source")))
            .groupBy("source", "target", "unit", "tilt", "low", "high")
            .agg((F.sum(taken) - F.first("target")).alias("over"), F.sum(taken * scaled * (BOUND - r) / BOUND).alias("slope"))
        )
        low = F.when(F.col("over") < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("over") > 0, F.col("tilt")).otherwise(F.col("high"))
        most = 1 + 2 * F.abs("tilt")
        newton = F.col("tilt") - F.greatest(-most, F.least(most, F.col("over") / F.greatest("slope", F.lit(1e-300))))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        gap = F.abs("over") / F.col("target")
        state = cut(
            sums.withColumns({"low": low, "high": high, "newton": newton, "gap": gap})
            .withColumn("tilt", F.when(F.col("gap") <= TOLERANCE, F.col("tilt")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2))
            .select("source", "target", "unit", "tilt", "low", "high", "gap")
        )
        if (state.agg(F.max("gap")).first()[0] or 0) <= TOLERANCE:
            break
        state = state.drop("gap")
    else:
        warnings.warn("the tilts of some sources have not converged; their documents are taken at the last tilts", stacklevel=2)
    return state.select("source", F.round("tilt", 7).alias("tilt"), "unit")


def mixed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, mark, size, source_size, target, rate, copies) for each row of `docs`; mark tells texts apart."""
    sizes = staged(sized(docs, ("doc_id", "source"), text))
    counts = cut(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    wanted = cut(targets(sizes))
    found = tilts(counts, wanted).withColumnRenamed("source", "t_source")
    plan = cut(wanted.join(found, wanted["source"].eqNullSafe(found["t_source"]), "left").drop("t_source").withColumnRenamed("source", "p_source"))
    settled = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= BOUND * F.col("source_size"), float(BOUND))
    dice = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "mark"), F.lit(1 << 40)) / float(1 << 40)
    rated = (
        sizes.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
        .withColumn("rate", F.coalesce(settled, rate(F.col("tilt"), F.col("size"), F.col("unit")), F.lit(0.0)))
        .withColumn("copies", (F.floor("rate") + (dice < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
        .select("doc_id", "source", "mark", "size", "source_size", "target", "rate", "copies")
    )
    return evened(staged(rated))


def evened(rated: DataFrame) -> DataFrame:
    """Move single documents by a copy so that each source's words come as near its target as they let it.

    In each source, of the documents that can move the right way, one is picked for each power of two of the size and
    each of SPARE parts of a hash (plain minima, so no source meets in one task, and at most 64 * SPARE picks a source).
    The picks are then gone through from the largest: one that is no larger than what is still missing is moved. Rows
    that repeat an id and a text are one pick, with all their words.
    """
    words = rated.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words"), F.first("target").alias("target"))
    short = cut(words.select(F.col("source").alias("s_source"), (F.col("target") - F.col("words")).alias("short")))
    dice = F.xxhash64(F.lit("even"), F.col("doc_id"), F.col("mark"))
    same = rated.where("size > 0").groupBy("source", "doc_id", "mark").agg(F.sum("size").alias("size"), F.first("copies").alias("copies"))
    movable = F.when(F.col("short") > 0, F.col("copies") < BOUND).otherwise(F.col("copies") > 0)
    picks = (
        same.join(short, F.col("source").eqNullSafe(F.col("s_source")))
        .where(movable & (F.col("size") <= F.abs("short")))
        .groupBy("s_source", "short", F.floor(F.log2("size")).alias("band"), F.pmod(dice, F.lit(SPARE)).alias("part"))
        .agg(F.min(F.struct(dice.alias("dice"), "doc_id", "mark", "size")).alias("pick"))
        .groupBy("s_source", "short")
        .agg(F.sort_array(F.collect_list(F.struct("pick.size", "pick.dice", "pick.doc_id", "pick.mark")), asc=False).alias("picks"))
    )

    def step(acc: Column, p: Column) -> Column:
        fits = p["size"] <= acc["left"]
        left = F.when(fits, acc["left"] - p["size"]).otherwise(acc["left"])
        return F.struct(left.alias("left"), F.when(fits, F.concat(acc["ids"], F.array(F.struct(p["doc_id"].alias("id"), p["mark"].alias("mark"))))).otherwise(acc["ids"]).alias("ids"))

    none = F.struct(F.abs("short").alias("left"), F.array().cast(f"array<struct<id: {dict(rated.dtypes)['doc_id']}, mark: bigint>>").alias("ids"))
    moved = picks.select("s_source", F.signum("short").cast("long").alias("by"), F.explode(F.aggregate("picks", none, step, lambda acc: acc["ids"])).alias("m"))
    moved = moved.select("s_source", "by", F.col("m.id").alias("m_id"), F.col("m.mark").alias("m_mark"))
    on = (F.col("mark") == F.col("m_mark")) & F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("s_source"))
    changed = F.greatest(F.lit(0), F.least(F.lit(BOUND), F.col("copies") + F.coalesce("by", F.lit(0)))).cast("long")
    return rated.join(moved, on, "left").withColumn("copies", changed).drop("by", "s_source", "m_id", "m_mark")


def digest(docs: DataFrame) -> DataFrame:
    """What query op2 returns, with the rates and copies."""
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
