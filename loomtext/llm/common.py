"""What the operators of this subpackage share: tables, shared storage, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Drops the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: later steps start from files that outlive executors.

    The shuffle files behind it are dropped, since the written table replaces them. The table goes with `forget`, at the
    latest when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    folder, files = _files(spark, path)
    files.deleteOnExit(folder)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_path = path
    return found


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def forget(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for t in tables:
        folder, files = _files(t.sparkSession, t._staged_path)
        files.delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of iterative steps."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes of an Arrow batch, about.
BATCH_BYTES = 4_000_000


def small_batches(docs: DataFrame) -> DataFrame:
    """`docs`. From now on the session's Arrow batches hold about BATCH_BYTES, so that a batch of long texts takes little
    memory outside the heap and in the Python workers, whatever the number of its rows."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def released() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and stand beside a full heap then."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work` on a task's batches, with its memory released when the task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            released()

    return run


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, longer by as many underscores as it takes for `docs` to have no such columns."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """Evaluate `value` once a row and use it in `body`, lambdas included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % n


def blocks(texts: Iterable[str | None], most: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about a million characters, nulls as empty: what a task holds at once doesn't grow with a batch of long texts."""
    block, size = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        block.append(t)
        size += len(t)
        if size > most:
            yield block
            block, size = [], 0
    if block:
        yield block


def pieces(raw: bytes, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, which of them are white space) of pieces of about `most` bytes that end after white space."""
    data, at = np.frombuffer(raw, dtype=np.uint8), 0
    white = lambda part: (part == 32) | ((part >= 9) & (part <= 13))
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and not len(gap := np.flatnonzero(white(data[end : end + most]))):
            end = min(end + most, len(data))
        if end < len(data):
            end += int(gap[0]) + 1
        yield data[at:end], white(data[at:end])
        at = end


#: log2 of the bits that one row brings to the driver.
BLOCK_BITS = 16


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """2^bits bits, packed from the lowest, with those set that a column of longs names. The tasks pack them: what reaches
    the driver is 2^(bits - BLOCK_BITS) rows of bytes at most, so no more than the bits themselves."""
    size = min(BLOCK_BITS, bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at, given = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "set"))
            order = np.argsort(at)
            at, given = at[order], given[order]
            first = np.flatnonzero(np.diff(at >> (size - 6), prepend=-1))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)]):
                block = held.setdefault(int(at[a]) >> (size - 6), np.zeros(1 << (size - 6), dtype=np.int64))
                block[at[a:b] & ((1 << (size - 6)) - 1)] |= given[a:b]
        for block, packed in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed.tobytes()], pa.binary())], ["block", "packed"])

    word = rows.groupBy((F.shiftright(column, 6)).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({column} & 63 as int)))").alias("set"))
    found = word.repartition(F.shiftright("at", size - 6)).select(F.col("at").cast("long").alias("at"), "set").mapInArrow(pack, "block long, packed binary")
    out = np.zeros((1 << (bits - size), 1 << (size - 6)), dtype=np.int64)
    for row in found.collect():
        out[row["block"]] |= np.frombuffer(row["packed"], dtype=np.int64)
    return out.reshape(-1).view(np.uint8)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """(text, label, share) of about `rows` rows (and no more than twice as many) of each label 0 and 1, by a hash of the id.

    share is the weight that gives the labels their true shares again, 1 on average. Sorted, so reruns agree. Which
    rows are taken is settled on the labels, before any text is read; of several labels of an id the least counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return pd.DataFrame({"text": [], "label": [], "share": []})
    dice = F.pmod(F.xxhash64(F.lit("labels"), doc_id), F.lit(1 << 30)) / float(1 << 30)
    part = F.coalesce(*(F.when(F.col("label") == k, min(1.0, rows / n)) for k, n in sorted(counts.items())))
    chosen = known.where(dice < part)
    chosen = chosen.orderBy(dice, doc_id).limit(4 * rows)  # the bounds, should they be met, take the same rows again
    found = docs.select(F.col(doc_id), F.col(text).alias("text")).join(F.broadcast(chosen), doc_id)
    frame = found.select("text", "label", doc_id, F.xxhash64("text").alias("mark")).orderBy(doc_id, "mark").limit(4 * rows).toPandas()[["text", "label"]]
    frame["text"] = frame["text"].fillna("")
    frame = frame.sort_values(["text", "label"], ignore_index=True)
    taken = frame["label"].value_counts()
    share = {k: counts[k] / taken[k] for k in taken.index}
    total = sum(share[k] * taken[k] for k in taken.index)
    frame["share"] = frame["label"].map(share) * len(frame) / max(total, 1)
    return frame


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps: each node's links are rewired to the smallest node
    it sees, until nothing changes. The minima are plain aggregates, so a hub is summed before the shuffle.
    """
    found = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        state = tuple(found.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))")).first())
        if state == seen:
            return found.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                found.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        found = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
