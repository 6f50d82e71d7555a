"""Reading on: from page to next page, as long as the next one is trusted and new."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def page_key(url: Column) -> Column:
    """Addresses that differ in their fragment alone are one page."""
    return F.regexp_replace(url, "#.*$", "")


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage, in the folder that the session names (a local session without one gets a folder of its own)."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


def read_on(starts: DataFrame, next_: DataFrame) -> DataFrame:
    """(session, step, url): the pages that each session reads, from its start (session, url) on, step 0.

    next_: (url, next_url, confirm), as `sources.html.next_pages` finds it; a next page that is to be confirmed, and one
    that the session has read, end the session. Of several next pages of one address the smallest counts.

    The frontier doubles: links that lead 1, 2, 4, ... pages on are joined to themselves, and each session's path of that
    length is carried on by one join, so a series of a million pages takes 20 rounds. A path without a link or with a page
    twice is complete, and is cut before the page that repeats. Null sessions and addresses take no part; repeated starts
    are one.
    """
    trusted = next_.where(~F.coalesce("confirm", F.lit(True)))
    hops = trusted.groupBy(page_key(F.col("url")).alias("page")).agg(F.min(page_key(F.col("next_url"))).alias("to")).where("page is not null and to is not null")
    first = starts.select("session", page_key(F.col("url")).alias("page")).where("session is not null and page is not null")
    paths = first.groupBy("session").agg(F.min("page").alias("page")).select("session", F.lit(0).cast("long").alias("step"), "page")
    hops, paths, done, reach = _cut(hops), _cut(paths), [], 1
    while True:
        more = paths.join(hops, "page").select("session", (F.col("step") + reach).alias("step"), F.col("to").alias("page"))
        longer = _cut(paths.unionByName(more))
        reach *= 2
        state = longer.groupBy("session").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"))
        open_ = _cut(state.where((F.col("n") == reach) & (F.col("pages") == reach)).select("session"))
        done.append(longer.join(open_, "session", "left_anti"))
        if open_.isEmpty():
            break
        paths = longer.join(open_, "session", "left_semi")
        hops = _cut(hops.join(hops.select(F.col("page").alias("to"), F.col("to").alias("further")), "to").select("page", F.col("further").alias("to")))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    nth = F.row_number().over(Window.partitionBy("session", "page").orderBy("step"))
    rows = whole.withColumn("_again", F.when(nth > 1, F.col("step")))
    rows = rows.withColumn("_end", F.min("_again").over(Window.partitionBy("session")))
    return rows.where("_end is null or step < _end").select("session", "step", F.col("page").alias("url"))
