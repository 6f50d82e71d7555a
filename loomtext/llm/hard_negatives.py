"""Hard-negative mining over a vector-approximation file.

Vectors become integers, floor(256 x). Their approximation file holds, for each row, one byte a dimension: the cell of that
dimension's value, cells being cut at quantiles of a bounded sample and closed by the smallest and largest value of all rows.
An anchor turns its own vector into two tables, cells by dimensions, of the least and the most that a cell can add to an inner
product; a row's bounds are sums of looked-up entries. Only rows whose bounds leave open that they enter are scored exactly:

1. positives: rows of the anchor's label whose upper bound reaches the worst score that some task has kept, and those only;
2. negatives: rows of other labels whose bounds meet one of the anchor's windows (50 to 95 hundredths of a positive's score)
   and reach what is already kept in it.

Anchors go to the tasks in chunks whose tables have TABLES entries at most (1,024 anchors of 64 dimensions), so neither the driver nor a task holds more; for each chunk
the approximation file is read twice, once a step. A task gives out its first few rows for each anchor or window, and a window
function ranks those of all tasks. Bounds are exact integers, so nothing is lost; the sample only decides how tight they are.

Rows with a null id, label or vector, or a null or non-finite component, take no part; nor do empty vectors. Vectors meet only those of equal length. A
row with an anchor's own id is not among its others, so a repeated row isn't its own positive; a repeated anchor gives its
rows again. Ties go to the smaller id; equal rows with equal ids count each. An empty table gives no rows. Components past 2^31
/ 256, or vectors so long that scores could pass 62 bits, stop the job with a message. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import forget, small_batches, staged, tidy
from loomtext.sources.tables import spread

#: Kept for an anchor, and for a window; the windows, in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Cells of a dimension; rows that their quantiles are fitted on (about); entries of a chunk's tables; anchors and rows that meet at once.
CELLS, SAMPLE, TABLES, ANCHOR_BLOCK, ROW_BLOCK = 256, 20_000, 1 << 25, 256, 2_048
#: Stands for no score yet, and for a window that nothing enters.
NONE, SHUT = np.int64(-(1 << 62)), np.int64(1 << 62)


class Cells(NamedTuple):
    """Of each dimension: where cells begin, and the least and greatest value of each."""

    inner: np.ndarray  # dimensions x (cells - 1)
    low: np.ndarray  # dimensions x cells
    high: np.ndarray


def whole_vectors(rows: DataFrame, vec_id: str, embedding: str, label: str, relabelled: Column | None) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part; vec holds integers."""
    vec = F.col(embedding).cast("array<double>")
    good = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vec, lambda x: F.when(F.abs(x) < 2.0**23, F.floor(x * 256)).otherwise(F.raise_error(F.lit("a component is too large"))).cast("int"))
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if relabelled is None else relabelled).cast("long").alias("label"), ints.alias("vec"))


def fitted_cells(rows: DataFrame, size: int) -> Cells:
    """Cells for vectors of `size` dimensions: inner cuts from about SAMPLE rows chosen by a hash of the row, outer ones from all rows."""
    mine = rows.where(F.size("vec") == size)
    ends = mine.select(F.posexplode("vec")).groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high"), F.count("*").alias("n")).toPandas().sort_values("pos")
    share = min(1.0, SAMPLE / max(1, int(ends["n"].max())))
    chosen = mine.where(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(2 * SAMPLE)
    sample = np.array(chosen.select("vec").toPandas()["vec"].tolist(), dtype=np.int64).reshape(-1, size)
    if not len(sample):
        sample = ends[["low"]].to_numpy(dtype=np.int64).T
    inner = np.ceil(np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0).T).astype(np.int64)
    low = np.concatenate([ends[["low"]].to_numpy(dtype=np.int64), inner], axis=1)
    high = np.concatenate([inner - 1, ends[["high"]].to_numpy(dtype=np.int64)], axis=1)
    return Cells(inner, low, high)


def approximated(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """The approximation file: (vec_id, label, size, cells, exact), the last two binary, bytes and 32-bit integers."""
    held = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.asarray(v, dtype=np.int32) for v in b.column("vec").to_numpy(zero_copy_only=False)]
            found: list[bytes] = [b""] * len(vectors)
            for size in {len(v) for v in vectors}:
                at = [k for k, v in enumerate(vectors) if len(v) == size]
                block = np.stack([vectors[k] for k in at])
                inner = held.value[size].inner
                code = np.stack([np.searchsorted(inner[d], block[:, d], side="right") for d in range(size)], axis=1).astype(np.uint8)
                for k, row in zip(at, code):
                    found[k] = row.tobytes()
            out = [b.column("vec_id"), b.column("label"), pa.array([len(v) for v in vectors], pa.int32()), pa.array(found, pa.binary()), pa.array([v.tobytes() for v in vectors], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "size", "cells", "exact"])

    return spread(rows).mapInArrow(tidy(run), "vec_id long, label long, size int, cells binary, exact binary")


class Anchors(NamedTuple):
    number: np.ndarray  # of each anchor: its number among all,
    vec_id: np.ndarray
    label: np.ndarray
    exact: np.ndarray  # its vector (a row),
    least: np.ndarray  # what each cell of each dimension adds to a score, at least (anchors x dimensions x cells)
    most: np.ndarray  # and at most


def anchors_of(frame: pd.DataFrame, cells: Cells, size: int) -> Anchors:
    exact = np.frombuffer(b"".join(frame["exact"]), dtype=np.int32).reshape(-1, size).astype(np.int64)
    peak = int(np.abs(cells.low).max(initial=1)), int(np.abs(cells.high).max(initial=1))
    if size * max(peak) ** 2 >= 1 << 62:
        raise ValueError("scores of these vectors could pass 62 bits")
    kind = np.int32 if size * max(peak) ** 2 < 1 << 31 else np.int64  # bounds of this width can't overflow
    a, b = (exact[:, :, None] * x[None] for x in (cells.low, cells.high))
    return Anchors(frame["number"].to_numpy(np.int64), frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), exact, np.minimum(a, b).astype(kind), np.maximum(a, b).astype(kind))


class Rows(NamedTuple):
    vec_id: np.ndarray
    label: np.ndarray
    cells: np.ndarray  # dimensions x rows
    exact: np.ndarray  # rows x dimensions


def row_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Rows]:
    for b in batches:
        for at in range(0, b.num_rows, ROW_BLOCK):
            part = b.slice(at, ROW_BLOCK)
            cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), dtype=np.uint8).reshape(-1, size).T
            exact = np.frombuffer(b"".join(part.column("exact").to_pylist()), dtype=np.int32).reshape(-1, size)
            yield Rows(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), np.ascontiguousarray(cells), exact)


def bounds(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Sums of the tables' entries: anchors x rows."""
    total = np.take(table[:, 0], cells[0], axis=1)
    for d in range(1, len(cells)):
        total += np.take(table[:, d], cells[d], axis=1)
    return total


def pair_bounds(table: np.ndarray, cells: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Sums of the tables' entries for some pairs."""
    total = np.zeros(len(a), dtype=np.int64)
    for d in range(len(cells)):
        total += table[a, d, cells[d, r]]
    return total


def scores(anchors: Anchors, rows: Rows, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact scores of pairs."""
    out = np.empty(len(a), dtype=np.int64)
    for at in range(0, len(a), 65_536):
        part = slice(at, at + 65_536)
        out[part] = np.einsum("ij,ij->i", anchors.exact[a[part]], rows.exact[r[part]].astype(np.int64))
    return out


class Kept:
    """The first few (score, id) of each slot seen so far: by score from the highest, then by id."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.worst = np.full(slots, NONE)  # the last score of a full slot
        self.slot, self.score, self.vec_id = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def take(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        slot, score, vec_id = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.vec_id, vec_id)))
        order = np.lexsort((vec_id, -score, slot))
        slot, score, vec_id = slot[order], score[order], vec_id[order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        last = place == self.most - 1
        self.worst[slot[last]] = score[last]
        keep = place < self.most
        self.slot, self.score, self.vec_id = slot[keep], score[keep], vec_id[keep]


def nearest_in_task(rows: Iterator[Rows], anchors: Anchors, most: int) -> Kept:
    """The first rows of each anchor's label, its own id aside. Slots: anchors."""
    kept = Kept(len(anchors.label), most)
    for block in rows:
        for label in np.intersect1d(anchors.label, block.label).tolist():
            mine, theirs = np.flatnonzero(anchors.label == label), np.flatnonzero(block.label == label)
            cells = np.ascontiguousarray(block.cells[:, theirs])
            for at in range(0, len(mine), ANCHOR_BLOCK):
                part = mine[at : at + ANCHOR_BLOCK]
                other = anchors.vec_id[part][:, None] != block.vec_id[theirs][None]
                least = kept.worst[part]
                if len(theirs) > most and (least == NONE).any():  # `most` rows, the own one aside, reach their lower bounds
                    low = np.where(other, bounds(anchors.least[part], cells), np.iinfo(anchors.least.dtype).min)
                    low = np.partition(low, len(theirs) - most, axis=1)[:, len(theirs) - most]
                    least = np.where(other.sum(axis=1) >= most, np.maximum(least, low), least)
                a, r = np.nonzero(other & (bounds(anchors.most[part], cells) >= least[:, None]))
                kept.take(part[a], scores(anchors, block, part[a], theirs[r]), block.vec_id[theirs[r]])
    return kept


def windows_in_task(rows: Iterator[Rows], anchors: Anchors, low: np.ndarray, high: np.ndarray, most: int) -> Kept:
    """The first rows of other labels in each window of each anchor; low and high: anchors x windows. Slots: windows, by anchor."""
    width = low.shape[1]
    kept = Kept(low.size, most)
    for block in rows:
        for at in range(0, len(anchors.label), ANCHOR_BLOCK):
            part = slice(at, at + ANCHOR_BLOCK)
            least, top = np.maximum(low[part], kept.worst.reshape(-1, width)[part]), high[part]
            reach = np.where(least <= top, least, SHUT).min(axis=1)
            other = anchors.label[part][:, None] != block.label[None]
            a, r = np.nonzero(other & (bounds(anchors.most[part], block.cells) >= reach[:, None]))
            under = pair_bounds(anchors.least[part], block.cells, a, r)
            below = under <= top.max(axis=1)[a]
            a, r = a[below], r[below]
            score = scores(anchors, block, a + at, r)
            for k in range(width):
                inside = (score >= least[a, k]) & (score <= top[a, k])
                kept.take((a[inside] + at) * width + k, score[inside], block.vec_id[r[inside]])
    return kept


def chunks(file: DataFrame, is_anchor: Column) -> Iterator[tuple[int, pd.DataFrame]]:
    """(size, anchors), of one vector length each, whose tables have TABLES entries at most (one anchor has what it has)."""
    chosen = file.where(is_anchor)
    sizes = {r["size"]: r["count"] for r in chosen.groupBy("size").count().collect()}
    for size in sorted(sizes):
        most = max(1, TABLES // (2 * size * CELLS))
        parts = 1 if sizes[size] <= most else -(-2 * sizes[size] // most)  # dealt by a hash, so few parts pass `most`, and those are cut
        mine = chosen.where(F.col("size") == size).withColumn("chunk", F.pmod(F.xxhash64("vec_id", "exact"), F.lit(parts)))
        for k in range(parts):
            found = mine.where(F.col("chunk") == k).select("vec_id", "label", "exact").toPandas()
            found = found.sort_values(["vec_id", "label", "exact"], ignore_index=True)
            for at in range(0, len(found), most):
                yield size, found.iloc[at : at + most].reset_index(drop=True)


def ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def scan(file: DataFrame, size: int, work, slots: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = work(row_blocks(batches, size))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kept.slot, kept.score, kept.vec_id)], [slots, "score", "vec_id"])

    return file.where(F.col("size") == size).select("vec_id", "label", "cells", "exact").mapInArrow(tidy(run), f"{slots} long, score long, vec_id long")


def mined_chunk(file: DataFrame, size: int, frame: pd.DataFrame, cells: Cells, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = file.sparkSession
    numbered = frame.assign(number=range(len(frame)))
    anchors = spark.sparkContext.broadcast((numbered, cells))
    near = scan(file, size, lambda rows: nearest_in_task(rows, anchors_of(*anchors.value, size), positives), "anchor")
    first = ranked(near, ["anchor"], positives).toPandas()  # `positives` rows an anchor of the chunk
    score = np.zeros((len(frame), positives), dtype=np.int64)
    bottom, top = np.full(score.shape, 1, dtype=np.int64), np.zeros(score.shape, dtype=np.int64)  # empty windows
    ids = np.zeros(score.shape, dtype=np.int64)
    a, k = first["anchor"].to_numpy(np.int64), first["rank"].to_numpy(np.int64) - 1
    score[a, k], ids[a, k] = first["score"], first["vec_id"]
    some = score > 0
    bottom[some], top[some] = -(-low * score[some] // 100), high * score[some] // 100
    zero = np.zeros(score.shape, dtype=bool)
    zero[a, k] = first["score"].to_numpy(np.int64) == 0
    bottom[zero] = 0  # a positive of score 0 has the window from 0 to 0; one below has none
    windows = spark.sparkContext.broadcast((bottom, top))
    far = scan(file, size, lambda rows: windows_in_task(rows, anchors_of(*anchors.value, size), *windows.value, negatives), "slot")
    found = ranked(far, ["slot"], negatives)
    slots = pd.DataFrame({"slot": np.arange(score.size), "anchor_id": np.repeat(frame["vec_id"].to_numpy(np.int64), positives), "positive_id": ids.ravel(), "positive_score": score.ravel()})
    return found.join(F.broadcast(spark.createDataFrame(slots)), "slot").select(
        "anchor_id", "positive_id", F.col("rank").cast("long").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


RESULT = "anchor_id long, positive_id long, rank long, negative_id long, positive_score long, negative_score long"


def mined(
    rows: DataFrame, is_anchor: Column, relabelled: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """For each anchor (a condition on vec_id) and each of its first `positives` rows of the same label, the first `negatives` rows
    of other labels that score `low` to `high` hundredths of the positive; `relabelled` replaces the label."""
    small_batches(rows)
    vectors = staged(whole_vectors(rows, vec_id, embedding, label, relabelled))
    sizes = [r[0] for r in vectors.select(F.size("vec")).distinct().collect()]
    cells = {size: fitted_cells(vectors, size) for size in sorted(sizes)}
    file = staged(approximated(vectors, cells))
    forget(vectors)
    found = rows.sparkSession.createDataFrame([], RESULT)
    for size, frame in chunks(file, is_anchor):
        part = staged(mined_chunk(file, size, frame, cells[size], positives, negatives, low, high))
        found = found.unionByName(part)
    return found


def digest(rows: DataFrame) -> DataFrame:
    """What query op12 returns."""
    return mined(rows, F.col("vec_id") % 50 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: DuckDB SQL for query op12.
ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
