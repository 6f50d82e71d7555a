"""Streams: only what is new. Each function takes a streaming (or batch) DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEAST_CHARS = 24


def new_turns(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Assistant turns of transcript lines (value, ts): broken lines go, and a uuid counts once within the watermark."""
    rows = lines.select("ts", *(F.get_json_object("value", f"$.{k}").alias(k) for k in ("uuid", "type", "text")))
    return rows.where("type = 'assistant' and trim(text) <> ''").withWatermark("ts", late).dropDuplicatesWithinWatermark(["uuid"])


def fresh_lines(snapshots: DataFrame, late: str = "1 hour") -> DataFrame:
    """Lines (watch, seq, line, ts) not seen before in their window, in any case; the first snapshot only primes.

    Short lines count as seen but aren't given out.
    """
    rows = snapshots.where("trim(line) <> ''").withColumn("key", F.lower("line")).withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark(["watch", "key"]).where(f"seq > 0 and length(line) >= {LEAST_CHARS}").drop("key")


def growth_bursts(additions: DataFrame, quiet: str = "400 milliseconds", least: int = 120, late: str = "10 seconds") -> DataFrame:
    """Bursts of added text (page, n_chars, ts: when the quiet is over) that a quiet gap ends, if they add enough."""
    bursts = additions.withWatermark("ts", late).groupBy("page", F.session_window("ts", quiet).alias("burst"))
    return bursts.agg(F.sum("n_chars").alias("n_chars")).where(F.col("n_chars") >= least).select("page", "n_chars", F.col("burst.end").alias("ts"))


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("window"), "event_type").count()


def continuation(previous: str | None, current: str) -> str | None:
    """What `current` adds to the end of `previous`, if its first lines are previous's last ones; else null."""
    key = lambda line: "".join(c for c in line.lower() if c.isalnum())
    old, new = ([x for x in (t or "").splitlines() if key(x)] for t in (previous, current))
    a, b = [key(x) for x in old], [key(x) for x in new]
    longest = min(len(a), len(b))
    size = next((n for n in range(longest, 0, -1) if a[-n:] == b[:n]), 0)
    if size == 0 or (size == 1 and size < longest):
        return None
    return "\n".join(new[size:])


def changed_captures(captures: DataFrame, least: int = 20) -> DataFrame:
    """Captures (watch, seq, text) that differ from the last one: the added lines of one that carries on, flagged so.

    State: a watch's last capture. Within a batch a watch's captures are taken in order of seq.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, text in zip(rows["seq"], rows["text"].fillna("")):
            letters = "".join(c for c in text.lower() if c.isalnum())
            if not letters or len(text.strip()) < least or letters == "".join(c for c in (last or "").lower() if c.isalnum()):
                continue
            more = continuation(last, text)
            if more is None or more:
                out.append((key[0], seq, text if more is None else more, more is not None))
            last = text
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["watch", "seq", "text", "continues"]).astype({"continues": bool})

    return captures.groupBy("watch").applyInPandasWithState(step, "watch long, seq long, text string, continues boolean", "last string", "append", GroupStateTimeout.NoTimeout)


def changed_values(values: DataFrame, least: int = 8) -> DataFrame:
    """Values (watch, seq, text) that differ from the one before and are long enough; what was there at the start isn't new."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for _, r in pd.concat(list(frames)).sort_values("seq").iterrows():
            text = r["text"] or ""
            if last is not None and text != last and len(text.strip()) >= least:
                out.append((key[0], r["seq"], text))
            last = text
        state.update((last,))
        yield pd.DataFrame(out, columns=["watch", "seq", "text"])

    return values.groupBy("watch").applyInPandasWithState(step, "watch long, seq long, text string", "last string", "append", GroupStateTimeout.NoTimeout)
