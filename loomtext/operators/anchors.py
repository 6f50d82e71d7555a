"""Anchors: bookmarks that find their place again after a text has changed.

An anchor (uri, exact, prefix, suffix, index_hint) meets the segments (uri, idx, text) of its document by an equi-join;
each rung of the ladder is a flag on the joined rows, and windows over an anchor's rows choose the rung and the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import identity as I
from loomtext.functions.normalize import once

CONTEXT, ACCEPT, BAND = 48, 0.5, 0.05


def with_context(segments: DataFrame) -> DataFrame:
    """Segments with the last characters of the two before and the first of the two after."""
    order = Window.partitionBy("uri").orderBy("idx")
    near = lambda *texts: F.array_join(F.array_compact(F.array(*texts)), " ")
    before = near(F.lag("text", 2).over(order), F.lag("text", 1).over(order))
    after = near(F.lead("text", 1).over(order), F.lead("text", 2).over(order))
    last = F.when(F.length(before) > CONTEXT, F.right(before, F.lit(CONTEXT))).otherwise(before)
    return segments.withColumns({"prefix": last, "suffix": F.substring(after, 1, CONTEXT), "before_text": before, "after_text": after})


def created(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """Anchors at positions (uri, index), clamped to the segments there are."""
    last = segments.groupBy("uri").agg(F.max("idx").alias("last"))
    wanted = positions.join(last, "uri").select("uri", F.greatest(F.lit(0), F.least("index", "last")).alias("idx"))
    found = with_context(segments).join(wanted, ["uri", "idx"])
    return found.select("uri", F.col("text").alias("exact"), "prefix", "suffix", F.col("idx").alias("index_hint"))


def located(anchors: DataFrame, segments: DataFrame) -> DataFrame:
    """(uri, index, how, verified) for each anchor (uri, exact, prefix, suffix, index_hint, rules_changed), one a uri.

    how: exact (one equal segment), ambiguous (several: neighbours choose), boundary (one holds the other), fuzzy
    (half the words or more), hint (the remembered index).
    """
    a = anchors.select("uri", "exact", F.col("prefix").alias("want_prefix"), F.col("suffix").alias("want_suffix"), "index_hint", "rules_changed")
    rows = a.join(with_context(segments), "uri", "left")
    low = lambda c: I.flat(F.lower(c))
    quote, words = I.padded_words(F.col("exact")), I.padded_words(F.col("text"))
    rows = rows.withColumns({
        "blank": (I.strip(F.coalesce("exact", F.lit(""))) == "") | F.col("idx").isNull(),
        "equal": F.coalesce(low(F.col("exact")) == low(F.col("text")), F.lit(False)),
        "touch": F.coalesce(I.contained(quote, words) | I.contained(words, quote), F.lit(False)),
        "distance": F.abs(F.col("idx") - F.col("index_hint")),
    })
    every = Window.partitionBy("uri")
    rows = rows.withColumns({"n_equal": F.sum(F.col("equal").cast("int")).over(every), "n_touch": F.sum(F.col("touch").cast("int")).over(every), "last": F.max("idx").over(every)})
    unsure = (F.col("n_equal") == 0) & (F.col("n_touch") == 0) & ~F.col("blank")  # words are compared where no rung above holds
    rows = rows.withColumn("score", F.when(unsure, F.coalesce(I.overlap(low(F.col("exact")), low(F.col("text"))), F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("best", F.max("score").over(every))
    how = (
        F.when(F.col("blank"), "hint").when(F.col("n_equal") == 1, "exact").when(F.col("n_equal") > 1, "ambiguous")
        .when(F.col("n_touch") > 0, "boundary").when(F.col("best") >= ACCEPT, "fuzzy").otherwise("hint")
    )
    rows = rows.withColumn("how", how)
    fits = (
        F.when(F.col("how").isin("exact", "ambiguous"), F.col("equal")).when(F.col("how") == "boundary", F.col("touch"))
        .when(F.col("how") == "fuzzy", F.col("score") >= F.col("best") - BAND).otherwise(True)
    )
    rows = rows.where(fits)  # neighbours are compared for candidates alone
    before = low(F.col("before_text"))
    near = F.coalesce(
        I.overlap(low(F.col("want_prefix")), F.when(F.length(before) > CONTEXT, F.right(before, F.lit(CONTEXT))).otherwise(before))
        + I.overlap(low(F.col("want_suffix")), F.substring(low(F.col("after_text")), 1, CONTEXT)),
        F.lit(0.0),
    )
    near = F.when(F.col("how").isin("ambiguous", "boundary", "fuzzy"), near).otherwise(0.0)
    rank = F.row_number().over(every.orderBy(F.desc("near"), "distance", "idx"))
    fallback = F.greatest(F.lit(0), F.least("index_hint", F.coalesce("last", F.lit(0))))
    top = rows.withColumn("near", near).withColumn("_rank", rank).where("_rank = 1")
    return top.select("uri", F.when(F.col("how") == "hint", fallback).otherwise(F.col("idx")).cast("int").alias("index"), "how", ((F.col("how") == "exact") & ~F.col("rules_changed")).alias("verified"))


def bare_words(text):
    """Words alone, in lower case, punctuation taken out."""
    return I.flat(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", "")))


def created_offsets(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """"offsets" anchors (uri, quote, before, after, index): up to two neighbours each way, whole; none out of range."""
    order = Window.partitionBy("uri").orderBy("idx")
    rows = segments.withColumns({"before": F.collect_list("text").over(order.rowsBetween(-2, -1)), "after": F.collect_list("text").over(order.rowsBetween(1, 2))})
    return rows.join(positions.withColumnRenamed("index", "idx"), ["uri", "idx"]).select("uri", F.col("text").alias("quote"), "before", "after", F.col("idx").alias("index"))


def located_offsets(anchors: DataFrame, segments: DataFrame) -> DataFrame:
    """(uri, index, how, verified, stamp_changed) for "offsets" anchors with stamp and current_stamp, one a uri.

    The same ladder as `located`: punctuation doesn't count, likeness is that of character pairs, neighbours count by
    their mean likeness, and only an anchor whose stamp is known and unchanged is verified.
    """
    order, every = Window.partitionBy("uri").orderBy("idx"), Window.partitionBy("uri")
    near = {f"{way}{k}": getattr(F, way)("text", k).over(order) for way in ("lag", "lead") for k in (1, 2)}
    anchors = anchors.withColumns({"quote_words": bare_words(F.col("quote")), "quote_pairs": I.bigrams(F.col("quote"))})  # once, not for each segment
    rows = anchors.join(segments.withColumns(near | {"total": F.count("*").over(every)}), "uri", "left")
    wanted = [(F.element_at("before", -k), F.col(f"lag{k}")) for k in (1, 2)] + [(F.get("after", F.lit(k - 1)), F.col(f"lead{k}")) for k in (1, 2)]
    wanted = [(F.when(F.size("before") >= k, w) if k else w, h) for (w, h), k in zip(wanted, (1, 2, 0, 0))]
    both = [(w, h, w.isNotNull() & h.isNotNull()) for w, h in wanted]
    likeness = sum((F.when(ok, I.bigram_similarity(w, h)).otherwise(0.0) for w, h, ok in both), F.lit(0.0))
    checked = sum((ok.cast("int") for _, _, ok in both), F.lit(0))
    rows = rows.withColumn("words", bare_words(F.col("text")))
    quote, words = F.col("quote_words"), F.col("words")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    known = F.col("stamp").isNotNull() & F.col("current_stamp").isNotNull()
    rows = rows.withColumns({
        "equal": F.coalesce(quote == words, F.lit(False)),
        "touch": F.coalesce(I.contained(pad(quote), pad(words)) | I.contained(pad(words), pad(quote)), F.lit(False)),
        "same": F.coalesce(known & (F.col("stamp") == F.col("current_stamp")), F.lit(False)),
        "changed": F.coalesce(known & (F.col("stamp") != F.col("current_stamp")), F.lit(False)),
    })
    rows = rows.withColumns({"n_equal": F.sum(F.col("equal").cast("int")).over(every), "n_touch": F.sum(F.col("touch").cast("int")).over(every)})
    unsure = (F.col("n_equal") == 0) & (F.col("n_touch") == 0)
    n_quote, n_text = F.size("quote_pairs"), F.greatest(F.length(I.flat(F.lower("text"))) - 1, F.lit(0))
    hopeless = 2 * F.least(n_quote, n_text) < (ACCEPT - BAND - 0.01) * (n_quote + n_text)  # by its length alone no candidate
    alike = F.when(F.col("quote") == F.col("text"), 1.0).when(hopeless, 0.0).otherwise(once(I.bigrams(F.col("text")), lambda pairs: I.dice(F.col("quote_pairs"), pairs)))
    rows = rows.withColumn("score", F.when(unsure, F.coalesce(alike, F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("best", F.max("score").over(every))
    how = F.when(F.col("n_equal") == 1, "exact").when(F.col("n_equal") > 1, "ambiguous").when(F.col("n_touch") > 0, "boundary").when(F.col("best") >= ACCEPT, "fuzzy").otherwise("hint")
    rows = rows.withColumn("how", F.when(F.col("idx").isNull(), "hint").otherwise(how))
    fits = F.when(F.col("how").isin("exact", "ambiguous"), F.col("equal")).when(F.col("how") == "boundary", F.col("touch")).when(F.col("how") == "fuzzy", F.col("score") >= F.col("best") - BAND).otherwise(True)
    rows = rows.where(fits)  # neighbours are compared for candidates alone
    near = F.when((checked > 0) & F.col("how").isin("ambiguous", "boundary", "fuzzy"), likeness / checked).otherwise(0.0) - F.abs(F.col("idx") - F.col("index")) / (F.col("total") * 1000)
    top = rows.withColumn("near", near).withColumn("_rank", F.row_number().over(every.orderBy(F.desc("near"), "idx"))).where("_rank = 1")
    hint = F.least("index", F.coalesce(F.col("total") - 1, F.lit(0)))
    return top.select("uri", F.when(F.col("how") == "hint", hint).otherwise(F.col("idx")).cast("int").alias("index"), "how", ((F.col("how") == "exact") & F.col("same")).alias("verified"), F.col("changed").alias("stamp_changed"))


def message(how, stamp_changed):
    """What a reader is told about how a place was found."""
    return (
        F.when(how == "exact", "").when(how == "ambiguous", "This sentence appears more than once.").when(how == "boundary", "The sentence here has changed.")
        .when((how == "fuzzy") & stamp_changed, "The reading rules have changed since.").when(how == "fuzzy", "The text here has changed.").otherwise("The place was not found.")
    )
