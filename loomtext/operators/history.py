"""Reading history, preferences and rule tables as DataFrame operations: upserts are merges of event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accumulated(events: DataFrame) -> DataFrame:
    """History rows of reading events (uri, ts, title, last_index, total, seconds, finished).

    Seconds add up (negative ones count as none), the first time stays, the last event's position wins, and a title
    stays until another comes.
    """
    order = F.struct("ts", "event_id")
    return events.groupBy("uri").agg(
        F.min("ts").alias("first_read"),
        F.max("ts").alias("last_read"),
        F.sum(F.greatest(F.lit(0.0), "seconds")).alias("seconds"),
        F.max_by("last_index", order).alias("last_index"),
        F.max_by("total", order).alias("total"),
        F.max_by("finished", order).alias("finished"),
        F.max_by("title", F.when(F.col("title").isNotNull(), order)).alias("title"),
    )


def recent(history: DataFrame, most: int = 100) -> DataFrame:
    return history.orderBy(F.desc("last_read"), "uri").limit(most)


def unfinished(history: DataFrame) -> DataFrame:
    return history.where("not finished and last_index > 0")


def pruned(history: DataFrame, most: int, cutoff) -> DataFrame:
    """The `most` last read rows that aren't older than `cutoff`; the global rank is a top-k first, so no task sorts all."""
    return history.where(F.col("last_read") >= cutoff).orderBy(F.desc("last_read"), "uri").limit(most)


def without(history: DataFrame, uris: DataFrame) -> DataFrame:
    return history.join(uris, "uri", "left_anti")


def merged_rules(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """Rules (pos, match, say): a user's rule takes the place of a built-in one of the same match in any case; others follow."""
    b = builtin.select(F.lower("match").alias("key"), F.col("pos").alias("b_pos"), F.col("match").alias("b_match"), F.col("say").alias("b_say"))
    u = user.select(F.lower("match").alias("key"), F.col("pos").alias("u_pos"), F.col("match").alias("u_match"), F.col("say").alias("u_say"))
    both = b.join(u, "key", "full")
    return both.select(F.coalesce("u_match", "b_match").alias("match"), F.coalesce("u_say", "b_say").alias("say"), F.struct(F.col("b_pos").isNull().alias("added"), F.coalesce("b_pos", "u_pos").alias("at")).alias("place"))


def seeded(rules: DataFrame, seed: DataFrame) -> DataFrame:
    """Rules with those of the seed that they lack."""
    return rules.unionByName(seed.join(rules, F.lower(seed["match"]) == F.lower(rules["match"]), "left_anti"))


def first_seen(rows: DataFrame, key, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in order, within `by`."""
    rank = F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def last_turns(turns: DataFrame, n: int, role: str = "assistant") -> DataFrame:
    """One document a conversation: its last n turns of a role, in order, parted by blank lines."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = turns.where(F.col("role") == role).withColumn("_rank", rank).where(F.col("_rank") <= n)
    rows = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("all"))
    return rows.select("conv_id", F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("text"))


def tail_window(turns: DataFrame, most: int) -> DataFrame:
    """The rows at each conversation's end whose texts add up to `most` bytes or less."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("_sum", F.sum(F.octet_length("text") + 1).over(back)).where(F.col("_sum") <= most).drop("_sum")
