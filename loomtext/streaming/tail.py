"""Growing files and passages held back: each stream function has a batch twin that gives the same rows from all its input.

A poll (watch, seq, path, typed, size, at, data) is one look at a file: its size in bytes, and the bytes from `at` on, where
`at` is a line's beginning no later than the end of the last complete line seen before (0 if the file was replaced).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_LINE = "type string, uuid string, message struct<content: string>"
_TURN = ["watch", "path", "seq", "n", "uuid", "text"]


def _assistants(lines: DataFrame, *more: str) -> DataFrame:
    """Lines of JSON that are assistant turns, with uuid and text: content is a text or typed blocks."""
    rows = lines.withColumn("_j", F.from_json("line", _LINE))
    content = F.col("_j.message.content")
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    said = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return rows.where("_j.type = 'assistant'").select("watch", "path", "seq", "n", F.col("_j.uuid").alias("uuid"), F.coalesce(said, content).alias("text"), *more)


def _with_text(turns: DataFrame) -> DataFrame:
    return turns.where(F.trim("text") != "").select(*_TURN)


def _targets(polls: DataFrame, pinned: Column | None) -> DataFrame:
    """One poll of each look: the pinned file while it is there, else the one typed into last, the first path of equals."""
    first = [F.coalesce(F.col("path") == pinned, F.lit(False)).desc()] if pinned is not None else []
    rank = F.row_number().over(Window.partitionBy("watch", "seq").orderBy(*first, F.desc_nulls_last("typed"), "path"))
    return polls.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def followed(polls: DataFrame, pinned: Column | None = None, from_start: bool = False) -> DataFrame:
    """Assistant turns (watch, path, seq, n, uuid, text) written to the file that each watch follows, as polls find them.

    A file is joined at the end of its last complete line (the first one at its beginning, if asked), a line counts once it
    is complete, a file that shrank is read again from its beginning, and a uuid counts once while a file is followed. What
    was said before is one look back in the watch's window, so a watch's polls are sorted, never gathered. Null data count
    as none; n is the line's number within its poll.
    """
    by = Window.partitionBy("watch").orderBy("seq")
    held = F.coalesce(F.decode(F.col("data"), "ISO-8859-1"), F.lit(""))  # a character for each byte
    rows = _targets(polls, pinned).withColumn("_held", held).drop("data")
    rows = rows.withColumn("_whole", F.length("_held") - F.length(F.substring_index("_held", "\n", -1)))
    rows = rows.withColumns({"_last": F.lag("path").over(by), "_before": F.lag(F.col("at") + F.col("_whole")).over(by)})
    joined = F.col("_last").isNull() | (F.col("_last") != F.col("path"))
    rows = rows.withColumns({"_run": F.sum(joined.cast("int")).over(by), "_joined": joined})
    start = F.when(F.col("_joined"), F.when(F.lit(from_start) & F.col("_last").isNull(), 0).otherwise(F.col("at") + F.col("_whole"))).when(F.col("size") < F.col("_before"), 0).otherwise(F.col("_before"))
    skip = F.greatest(F.lit(0), start - F.col("at")).cast("int")
    rows = rows.withColumn("_skip", skip).where("_skip < _whole")
    fresh = F.substr(F.col("_held"), F.col("_skip") + 1, F.col("_whole") - F.col("_skip") - 1)
    text = F.make_valid_utf8(F.encode(fresh, "ISO-8859-1").cast("string"))
    lines = rows.select("watch", "path", "seq", "_run", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    turns = _assistants(lines, "_run")
    again = F.row_number().over(Window.partitionBy("watch", "_run", "uuid").orderBy("seq", "n"))
    return _with_text(turns.withColumn("_again", F.when(F.col("uuid") != "", again).otherwise(1)).where("_again = 1"))


def followed_stream(polls: DataFrame, pinned: str | None = None, from_start: bool = False) -> DataFrame:
    """`followed` over a stream of polls; within a batch a watch's polls are taken in order of seq, all files of a look together.

    State of a watch: the file, the end of its last complete line, the uuids heard from it (they grow with the file).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        path, offset, heard = state.get if state.exists else (None, 0, [])
        heard, out = set(heard), []
        for seq, look in pd.concat(list(frames)).groupby("seq", sort=True):
            look = look.assign(pin=look["path"] == pinned).sort_values(["pin", "typed", "path"], ascending=[False, False, True], na_position="last")
            poll = look.iloc[0]
            data = poll["data"] or b""
            whole = data.rfind(b"\n") + 1
            if poll["path"] != path:
                start = 0 if path is None and from_start else None
                path, heard = poll["path"], set()
            else:
                start = 0 if poll["size"] < offset else offset
            offset = int(poll["at"]) + whole
            skip = whole if start is None else max(0, start - int(poll["at"]))
            if skip >= whole:
                continue
            for n, line in enumerate(data[skip : whole - 1].decode("utf-8", "replace").split("\n")):
                try:
                    turn = json.loads(line)
                except ValueError:
                    continue
                if not isinstance(turn, dict) or turn.get("type") != "assistant":
                    continue
                uuid = turn.get("uuid")
                if uuid not in heard:
                    out.append((key[0], path, seq, n, line))
                if uuid:
                    heard.add(uuid)
        state.update((path, offset, sorted(heard)))
        yield pd.DataFrame(out, columns=["watch", "path", "seq", "n", "line"])

    lines = polls.groupBy("watch").applyInPandasWithState(
        step, "watch long, path string, seq long, n int, line string", "path string, offset long, heard array<string>", "append", GroupStateTimeout.NoTimeout
    )
    return _with_text(_assistants(lines))


def flushed(events: DataFrame) -> DataFrame:
    """Passages (watch, seq, text, title) that were held while a watch was playing, joined when it is idle.

    events: (watch, seq, text, title, playing). A text waits while its watch plays; the first event at or after it at which
    the watch is idle gives out all that wait, a blank line between, under the last title heard. A null text is a change
    of state alone, a null playing leaves the state as it is (idle at first). What still waits at the end isn't given out.
    """
    by = Window.partitionBy("watch").orderBy("seq")
    rows = events.withColumns({"_on": F.coalesce(F.last("playing", True).over(by), F.lit(False)), "_title": F.last(F.when(F.col("title") != "", F.col("title")), True).over(by)})
    back = Window.partitionBy("watch").orderBy(F.desc("seq"))  # from the end, so that the next idle event is a running value
    out = F.last(F.when(~F.col("_on"), F.struct(F.col("seq").alias("seq"), F.col("_title").alias("title"))), True).over(back)
    waits = rows.withColumn("_out", out).where("text is not null and _out is not null")
    told = waits.groupBy("watch", F.col("_out.seq").alias("seq")).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").alias("at"), "text"))).alias("_t"), F.first("_out.title").alias("title"))
    return told.select("watch", "seq", F.array_join(F.transform("_t", lambda t: t["text"]), "\n\n").alias("text"), F.coalesce("title", F.lit("Window")).alias("title"))


def flushed_stream(events: DataFrame) -> DataFrame:
    """`flushed` over a stream; state of a watch: what waits, the last title, whether it plays."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, title, playing = state.get if state.exists else ([], None, False)
        waiting, out = list(waiting), []
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, text, name, on in zip(rows["seq"], rows["text"], rows["title"], rows["playing"]):
            playing = playing if pd.isna(on) else bool(on)
            title = name if isinstance(name, str) and name else title
            if isinstance(text, str):
                waiting.append(text)
            if waiting and not playing:
                out.append((key[0], seq, "\n\n".join(waiting), title or "Window"))
                waiting = []
        state.update((waiting, title, playing))
        yield pd.DataFrame(out, columns=["watch", "seq", "text", "title"])

    return events.groupBy("watch").applyInPandasWithState(step, "watch long, seq long, text string, title string", "waiting array<string>, title string, playing boolean", "append", GroupStateTimeout.NoTimeout)
