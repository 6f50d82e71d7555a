"""Line dedup by an exact set-similarity join over all lines of all documents.

A line is the set of its words (ASCII letters lower-cased, parted by white space). A line is removed if an earlier
line, by (doc_id, place), has a Jaccard similarity of THRESHOLD or more with it, whether or not that line stays.
Every line with a word takes part. Words are told apart by 64-bit hashes.

1. Lines with equal sets are one class, settled by a plain minimum before any join. Sets of fewer than LEAST_JOINED
   words are similar to equal sets only (4 words are to 5 that hold them), so they have no entries in the join.
2. Words are ordered by rarity: the count of a word's bucket over all documents (it only orders words, so a fixed
   number of buckets does, and the result is exact). Two similar sets share one of the rarest few words of each
   (prefix filter), so a class has an entry for each of those. Entries of a word meet in a task, sorted by size: the
   length filter is a window of that order, the positional filter follows, and last the parity of the words' counts in
   128 buckets, which can't differ in more buckets than the sets do in words. Each class comes out once for a word, with
   its nearest earlier class. Entries are shuffled by buckets of words, many to a row; how many buckets follows from how
   many entries there are, so a bucket is small.
3. The sets of the classes that have a candidate are read again from the texts, in one pass, and the nearest
   candidate is verified on them.
4. A class whose nearest isn't similar, but that has more candidates, meets them all again among those sets, with
   counts themselves to tell the nearest; what is still open then is verified against every candidate.

In a word of more than WIDE classes, a class that is very near one of the word's earliest classes isn't compared
further. If that one proves not to be similar, the class meets all others of its words again (`unseen`). A word of more
than PART classes is dealt in parts of about that size; what finds nothing similar in its part meets the other parts,
a pair of parts at a time. So no task holds more than PART classes a side, and no pair that may be similar is lost.

Null and empty texts have no lines to remove. Null ids sort first. Rows that repeat an id and a text share their
places: a line is not earlier than its copy there, so both stay or both go. Removed lines go with their line ends. An
empty table gives an empty result. A very long text is hashed in pieces that end between words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import BATCH_BYTES, bitmap, blocks, forget, let, pieces, small_batches, staged, tidy

LEAST_WORDS, LEAST_JOINED = 1, 4
#: The threshold as a fraction, 4/5: sizes and overlaps are compared in integers.
NUMERATOR, DENOMINATOR = 4, 5
THRESHOLD = NUMERATOR / DENOMINATOR
RARITY_BITS, TOKEN_BITS, MARK_BITS, CHUNK = 18, 40, 24, 4096
#: A candidate as near as this, of 0 to 1, is taken to be the one to verify without looking for a nearer one.
SURE = 0.5
#: Classes of a prefix word that a task compares at once; groups in which a class may drop out, and what it meets first.
PART, WIDE, HEADS = 4096, 512, 64
#: log2 of the counters of prefix words; buckets of words at least, and entries of a bucket, about, where there are more;
#: entries that a task packs at once; bytes of a hashed piece, so small that its arrays stay in a core's cache.
PREFIX_BITS, LEAST_BUCKETS, BUCKET_ENTRIES, PACK, PIECE = 20, 1024, 1 << 18, 1 << 18, 1 << 18
#: Stands for a null id, and sorts first.
NO_ID = -(1 << 63)

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64, up to n at least. Those for a usual piece are kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    up, down = np.full(n, _ODD, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    made = [np.cumprod(up, dtype=np.uint64, out=up), np.cumprod(down, dtype=np.uint64, out=down)]
    if n <= 1 << 22:
        _powers[:] = made
    return made[0], made[1]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line of the block, 64-bit hash) of each word, and the block's first line of each text."""
    lines, hashes, line_end = [], [], 0
    for raw, space in pieces(("\n".join(texts) + "\n").encode().lower(), PIECE):
        inside = np.zeros(len(raw) + 2, dtype=bool)
        np.logical_not(space, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        breaks = np.flatnonzero(raw == 10)
        up, down = powers(len(raw) + 1)
        run = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.multiply(raw, up[: len(raw)], out=run[1:])
        np.cumsum(run, out=run)
        h = (run[ends] - run[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        lines.append(line_end + np.searchsorted(breaks, starts))
        hashes.append(h)
        line_end += len(breaks)
    counts = np.array([t.count("\n") + 1 for t in texts])
    return np.concatenate(lines), np.concatenate(hashes), np.cumsum(counts) - counts


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def counted(rows: DataFrame, buckets: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """How often each of 2^bits buckets stands in what `buckets` finds in the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for found in buckets(batch):
                total += np.bincount(found, minlength=len(total))
        chunks = total.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks))), pa.array([c.tobytes() for c in chunks])], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, dtype=np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([c.tobytes() for c in sums.values()])], ["chunk", "counts"])

    kind = "chunk long, counts binary"
    found = rows.mapInArrow(tidy(count), kind).repartition("chunk").mapInArrow(add, kind).toPandas()
    counts = np.zeros((1 << bits) // CHUNK * CHUNK, dtype=np.int64).reshape(-1, CHUNK)
    for chunk, own in zip(found["chunk"], found["counts"]):
        counts[chunk] = np.frombuffer(own, dtype=np.int64)
    return counts.ravel()


def rarity(docs: DataFrame) -> np.ndarray:
    """The place of each bucket of words when ordered by the count of its words over all documents."""

    def buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block in blocks(_texts(batch)):
            yield (words_of(block)[1] >> np.uint64(64 - RARITY_BITS)).astype(np.int64)

    counts = counted(docs.select("text"), buckets, RARITY_BITS)
    places = np.empty(len(counts), dtype=np.uint32)
    places[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts), dtype=np.uint32)
    return places


#: Bits of a line's place that its row's mark takes.
MARK_MASK = 0xFFFFFFFF


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def clashes(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, turn): rows whose mark, by turns before that one, is that of another text under their id.

    Rows of one id (null ids are one) are told apart by a 32-bit mark of their text, which stands in the low half of a line's
    place. Of the texts that share id and mark, all but one take another mark, by turns, until all differ; the table has only
    those, a few of a hundred thousand texts under one id, none where ids are unique.
    """
    found = docs.select("doc_id", F.lit(0).cast("long").alias("hash"), F.lit(0).alias("turn")).limit(0)
    several = staged(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if several.isEmpty():  # no text is read where ids are unique
        return found
    rows, turns = docs.select("doc_id", text_hash().alias("hash")).join(several, "doc_id", "left_semi"), None
    while True:
        now = with_mark(rows, turns, "mark")
        open_ = staged(now.groupBy("doc_id", "mark").agg(F.min("hash").alias("first"), F.max("hash").alias("last")).where("first <> last").drop("last"))
        if open_.isEmpty():
            return found
        more = now.join(open_, ["doc_id", "mark"]).where("hash <> first").select("doc_id", "hash", F.lit(1).alias("again")).distinct()
        turn = (F.coalesce("turn", F.lit(0)) + F.coalesce("again", F.lit(0))).cast("int")
        found = turns = staged(found.join(more, ["doc_id", "hash"], "full").select("doc_id", "hash", turn.alias("turn")))


def with_mark(docs: DataFrame, turns: DataFrame | None, into: str) -> DataFrame:
    """`docs` (with doc_id, and text or hash) with the rows' marks; `turns` has those that aren't of turn 0."""
    own = F.col("hash") if "hash" in docs.columns else text_hash()
    if turns is None:
        return docs.withColumn(into, own.bitwiseAND(F.lit(MARK_MASK)))
    known = turns.select(F.col("doc_id").alias("_t_id"), F.col("hash").alias("_t_hash"), "turn")
    joined = docs.withColumn("_hash", own).join(known, (F.col("doc_id") == F.col("_t_id")) & (F.col("_hash") == F.col("_t_hash")), "left")
    mark = F.when(F.col("turn").isNull(), F.col("_hash")).otherwise(F.xxhash64("_hash", "turn")).bitwiseAND(F.lit(MARK_MASK))
    return joined.withColumn(into, mark).drop("_t_id", "_t_hash", "turn", "_hash")


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark), null ids as NO_ID: rows with one id and one mark have one text."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    turns = clashes(rows)
    return with_mark(rows, None if turns.isEmpty() else turns, "mark")


def _distinct(line: np.ndarray, h: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the distinct words of each line, the rarest of a line first, ties by hash."""
    low = TOKEN_BITS - RARITY_BITS
    token = (order[(h >> np.uint64(64 - RARITY_BITS)).astype(np.int64)] << np.uint64(low)) | ((h >> np.uint64(20)) & np.uint64((1 << low) - 1))
    if len(line) and line[-1] < 1 << (64 - TOKEN_BITS):
        key = (line.astype(np.uint64) << np.uint64(TOKEN_BITS)) | token
        by = np.argsort(key)
        own, k = h[by], key[by]
        if ((k[1:] == k[:-1]) & (own[1:] != own[:-1])).any():  # words that share a token
            by = np.lexsort((h, key))
    else:
        by = np.lexsort((h, token, line))
    line, h = line[by], h[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return line[new], h[new]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h + np.uint64(1)) * np.uint64(_ODD)
    return h ^ (h >> np.uint64(31))


def _again(h: np.ndarray) -> np.ndarray:
    h = (_mixed(h) ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def prefix_size(n):
    """How many of the rarest words of a set of n are its prefix."""
    return np.where(n < LEAST_JOINED, 0, n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1)


def _prefix_tokens(h: np.ndarray) -> np.ndarray:
    return (_mixed(h) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    size = rows.itemsize * rows.shape[1]
    data = np.ascontiguousarray(rows)
    offsets = np.arange(0, size * (len(rows) + 1), size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _slices(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes of the values between each two offsets."""
    ends = (offsets * values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column's rows, one after the other, and each row's number of bytes."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.chunk(0)
    if not len(rows):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    ends = np.frombuffer(rows.buffers()[1], dtype=np.int32)[rows.offset : rows.offset + len(rows) + 1]
    data = rows.buffers()[2]
    return np.frombuffer(data if data is not None else b"", dtype=np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of bytes again: two words of parities, or BUCKETS counts."""
    data, sizes = _bytes(column)
    data = data.reshape(len(sizes), -1)
    return data if data.shape[1] == BUCKETS else data.copy().view(np.uint64)


def _taken(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, offsets) of the first `sizes` elements from each start."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1]), offsets


LINE = "doc_id long, place long, n int, bits binary, k1 long, k2 long, prefix binary"
BUCKETS = 128


def lines_of(docs: DataFrame, places: np.ndarray) -> DataFrame:
    """A row for each line with a word: its place, its number of distinct words, counts by bucket, set keys and rarest words."""
    held = docs.sparkSession.sparkContext.broadcast(places)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value.astype(np.uint64)
        for batch in batches:
            ids, marks, at = batch.column("doc_id"), batch.column("mark").to_numpy(), 0
            for block in blocks(_texts(batch)):
                line, h, first = words_of(block)
                of, h = _distinct(line, h, order)
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                if len(starts):
                    n = np.diff(starts, append=len(of))
                    bucket = _again(h) >> np.uint64(57)
                    one = np.uint64(1) << (bucket & np.uint64(63))
                    bits = np.stack([np.bitwise_xor.reduceat(np.where((bucket > 63) == high, one, np.uint64(0)), starts) for high in (False, True)], axis=1)
                    other = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
                    k1, k2 = np.add.reduceat(h, starts), np.add.reduceat(other ^ (other >> np.uint64(32)), starts)
                    taken, offsets = _taken(starts, prefix_size(n))
                    doc = np.searchsorted(first, of[starts], side="right") - 1
                    place = ((of[starts] - first[doc]) << 32) | marks[at + doc]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(at + doc)),
                            pa.array(place),
                            pa.array(n.astype(np.int32)),
                            _binary(bits),
                            *(pa.array(x.view(np.int64)) for x in (k1, k2)),
                            _slices(_prefix_tokens(h[taken]), offsets),
                        ],
                        ["doc_id", "place", "n", "bits", "k1", "k2", "prefix"],
                    )
                at += len(block)

    return docs.select("doc_id", "text", "mark").mapInArrow(tidy(lines), LINE)


# The comparisons of a task: rows are arrays n, room (words from the entry's on) and the buckets' counts, by size.


def _windows(low: np.ndarray, high: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y): for each row y the rows x from low[y] to high[y], so many pairs at a time, but whole rows y."""
    widths = np.maximum(high - low, 0)
    rows = np.flatnonzero(widths)
    ends = np.cumsum(widths[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        r = rows[at:to]
        w = widths[r]
        yield np.repeat(low[r] - np.cumsum(w) + w, w) + np.arange(w.sum()), np.repeat(r, w)
        at = to


def _least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many words, at least, two sets differ: by their counts in BUCKETS buckets, modulo 256 or modulo 2."""
    if a.dtype == np.uint8:
        apart = a - b
        return np.minimum(apart, -apart).sum(axis=1, dtype=np.int64)
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _near(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, far) of the pairs that pass the length, positional and count filters. far, up to 1: of the words in which
    the sets may differ, how many their counts do differ in."""
    n, room = rows["n"], rows["room"]
    size = n[x] + n[y]
    fits = (NUMERATOR + DENOMINATOR) * np.minimum(room[x], room[y]) >= NUMERATOR * size
    x, y, size = x[fits], y[fits], size[fits]
    small = np.minimum(n[x], n[y])
    fits = DENOMINATOR * small >= NUMERATOR * (size - small)
    x, y, size = x[fits], y[fits], size[fits]
    differ = (DENOMINATOR + NUMERATOR) * _least_difference(rows["bits"][x], rows["bits"][y])
    most = (DENOMINATOR - NUMERATOR) * size
    near = differ <= most
    return x[near], y[near], differ[near] / most[near]


class _Found:
    """Of each row: its nearest earlier row, the distance, how many there are, and whether it has a partner at all."""

    def __init__(self, rank: np.ndarray) -> None:
        n = len(rank)
        self.rank, self.far, self.x = rank, np.full(n, np.inf), np.zeros(n, dtype=np.int64)
        self.count, self.active, self.unseen = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)

    def add(self, x: np.ndarray, y: np.ndarray, far: np.ndarray) -> None:
        """Pairs of which x is the earlier one."""
        if not len(y):
            return
        self.active[x] = self.active[y] = True
        self.count += np.bincount(y, minlength=len(self.count))
        by = np.lexsort((self.rank[x], far, y))
        x, y, far = x[by], y[by], far[by]
        first = np.flatnonzero(np.diff(y, prepend=-1))
        x, y, far = x[first], y[first], far[first]
        nearer = (far < self.far[y]) | ((far == self.far[y]) & (self.rank[x] < self.rank[self.x[y]]))
        self.far[y[nearer]], self.x[y[nearer]] = far[nearer], x[nearer]


def _size_window(group: np.ndarray, n: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: where, in its group, sizes from `least` to `most` begin and end. Rows are sorted by group and size."""
    span = int(n.max(initial=0)) + 2
    key = group * span + n
    bound = lambda sizes, side: np.searchsorted(key, group * span + np.clip(sizes, 0, span - 1), side=side)
    return bound(least, "left"), bound(most, "right")


def _candidates(rows: dict[str, np.ndarray], rank: np.ndarray, starts: np.ndarray, ends: np.ndarray, sure: float, wide: int) -> _Found:
    """What each row of words' groups meets. rows are sorted by word and size; rank is their order by (doc_id, place)."""
    n, room = rows["n"], rows["room"]
    found, sizes = _Found(rank), ends - starts
    group = np.repeat(np.arange(len(starts)), sizes)
    least = (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR
    # as the larger of two, a row reaches the sizes that its place in the prefix leaves room for
    low, high = _size_window(group, n, least, ((DENOMINATOR + NUMERATOR) * room - NUMERATOR * n) // NUMERATOR)
    high = np.minimum(high, np.arange(len(n)))
    wide_group = sizes > wide
    high[wide_group[group]] = 0
    for x, y in _windows(low, high):
        x, y, far = _near(rows, x, y)
        swap, apart = rank[x] > rank[y], rank[x] != rank[y]  # two prefix words of a class may be told by one number
        found.add(np.where(swap, y, x)[apart], np.where(swap, x, y)[apart], far[apart])
    for g in np.flatnonzero(wide_group).tolist():
        own = np.arange(starts[g], ends[g])
        heads = own[np.argsort(rank[own])[:HEADS]]
        for a in range(0, len(own), PART):
            y, x = (v.ravel() for v in np.broadcast_arrays(own[a : a + PART, None], heads))
            later = rank[x] < rank[y]
            found.add(*_near(rows, x[later], y[later]))
        found.unseen[own] = found.far[own] <= sure
        found.count[own] = 0  # those that go on meet the heads again
    if wide_group.any():
        low, high = _size_window(group, n, least, DENOMINATOR * n // NUMERATOR)
        high[~wide_group[group] | found.unseen] = 0
        for x, y in _windows(low, high):
            later = rank[x] < rank[y]
            found.add(*_near(rows, x[later], y[later]))
    return found


def by_keys(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole groups, of `least` rows or more, the last apart."""
    held: list[pa.RecordBatch] = []
    n_held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for k, c in zip(keys, columns):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= bool(held) and held[-1].column(k)[-1].as_py() != c[0]
        cuts = np.flatnonzero(new)
        if len(cuts) and n_held + cuts[-1] >= least:
            cut = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, n_held, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n_held += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _ranks(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Each row's rank by (doc_id, place), from 0; equal ones have one rank."""
    by = np.argsort(ids)
    doc = np.empty(len(ids), dtype=np.int64)
    doc[by] = np.cumsum(np.diff(ids[by], prepend=0) != 0)
    key = doc << 32 | places >> 32
    by = np.argsort(key)
    k, p = key[by], places[by]
    if ((k[1:] == k[:-1]) & (p[1:] != p[:-1])).any():  # texts that share an id
        by = np.lexsort((places, ids))
        k, p = key[by], places[by]
    rank = np.zeros(len(ids), dtype=np.int64)
    rank[by[1:]] = np.cumsum((k[1:] != k[:-1]) | (p[1:] != p[:-1]))
    return rank


def _rows(table: pa.Table, keys: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(arrays, rank, starts, ends) of a table of whole groups."""
    n = table.column("n").to_numpy().astype(np.int64)
    rows = {"n": n, "room": n - table.column("pos").to_numpy(), "bits": _unpacked(table.column("bits"))}
    rank = _ranks(table.column("doc_id").to_numpy(), table.column("place").to_numpy())
    new = np.zeros(len(n), dtype=bool)
    new[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return rows, rank, starts, np.append(starts[1:], len(n))


ENTRY = ("token", "doc_id", "place", "n", "pos", "bits")
ENTRIES = "token int, doc_id long, place long, n int, pos int, bits binary"
MET = "doc_id long, place long, x_id long, x_place long, far double, more boolean, unseen boolean, active boolean"


def entries_of(classes: DataFrame) -> DataFrame:
    """A row for each entry."""
    return classes.select("doc_id", "place", "n", "bits", "prefix").mapInArrow(lambda batches: (_entries(b) for b in batches), ENTRIES)


def _prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, position) of the entries of a batch of classes."""
    data, sizes = _bytes(batch.column("prefix"))
    sizes = sizes // 4
    own = np.repeat(np.arange(len(sizes)), sizes)
    return data.view(np.int32), own, (np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)


def _entries(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> pa.RecordBatch:
    """The entries of a batch of classes, or those for prefix words that a bitmap of 2^MARK_BITS bits marks."""
    token, own, pos = _prefixes(batch)
    if wanted is not None:
        kept = wanted[token.view(np.uint32) >> np.uint32(32 - MARK_BITS)]
        token, own, pos = token[kept], own[kept], pos[kept]
    rows = pa.array(own)
    return pa.RecordBatch.from_arrays([pa.array(token), *(batch.column(c).take(rows) for c in ("doc_id", "place", "n")), pa.array(pos), batch.column("bits").take(rows)], list(ENTRY))


def _prefix_buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint32) >> np.uint32(32 - PREFIX_BITS)).astype(np.int64)


def prefix_counts(classes: DataFrame) -> np.ndarray:
    """The number of entries by 2^PREFIX_BITS buckets of prefix words."""
    return counted(classes.select("prefix"), lambda batch: iter([_prefix_buckets(_bytes(batch.column("prefix"))[0].view(np.int32))]), PREFIX_BITS)


def common_words(classes: DataFrame, part: int = PART, counts: np.ndarray | None = None) -> DataFrame:
    """(token, parts): prefix words of more than `part` classes, and in how many parts they are dealt. Words are counted
    one by one only in buckets of more than `part` entries (counts: `prefix_counts`)."""
    spark = classes.sparkSession
    large = (prefix_counts(classes) if counts is None else counts) > part
    if not large.any():
        return spark.range(0).selectExpr("cast(id as int) as token", "1 as parts")
    held = spark.sparkContext.broadcast(np.packbits(large))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(held.value).view(bool)
        for batch in batches:
            tokens = _bytes(batch.column("prefix"))[0].view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[wanted[_prefix_buckets(tokens)]])], ["token"])

    counts = classes.select("prefix").mapInArrow(read, "token int").groupBy("token").count().where(f"count > {part}")
    return counts.select("token", F.ceil(F.col("count") / part).cast("int").alias("parts"))


def part_of(parts: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", "place"), parts).cast("int")


def dealt(classes: DataFrame, common: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """The entries (all, or those given), `split` where the word has several parts; token is the word and the part."""
    part = F.coalesce(part_of(F.col("parts")), F.lit(0))
    token = F.shiftleft(F.col("token").cast("long"), 32).bitwiseOR(part.cast("long"))
    found = (entries_of(classes) if entries is None else entries).join(common, "token", "left")
    return found.select(token.alias("token"), *ENTRY[1:], F.col("parts").isNotNull().alias("split"))


def _met(table: pa.Table, found: _Found, out: np.ndarray, split: np.ndarray) -> pa.RecordBatch:
    ids, places = table.column("doc_id").combine_chunks(), table.column("place").combine_chunks()
    none = np.isinf(found.far[out])
    x = pa.array(found.x[out], mask=none)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(out)),
            places.take(pa.array(out)),
            ids.take(x),
            places.take(x),
            pa.array(found.far[out]),
            pa.array(found.count[out] > 1),
            pa.array((found.unseen | split)[out]),
            pa.array(found.active[out]),
        ],
        ["doc_id", "place", "x_id", "x_place", "far", "more", "unseen", "active"],
    )


#: Of an entry's columns when they are packed.
PACKED = {"token": np.int32, "doc_id": np.int64, "place": np.int64, "n": np.int32, "pos": np.int32, "bits": np.uint64}


def packed(classes: DataFrame, n_entries: int, common: np.ndarray | None = None) -> DataFrame:
    """The entries, but for words that `common`, a bitmap of 2^MARK_BITS bits, marks: bucket, and a binary column for each
    of ENTRY with a bucket's values. There are as many buckets as `n_entries` entries take, whole words in each."""
    held = classes.sparkSession.sparkContext.broadcast(common)
    n_buckets = np.uint64(max(LEAST_BUCKETS, n_entries // BUCKET_ENTRIES))

    def rows(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        first = np.cumsum([0] + [len(p["n"]) for p in parts[:-1]])
        by = np.argsort(held["token"].view(np.uint32))
        token, pos, own = held["token"][by], held["pos"][by], (held["own"] + np.repeat(first, [len(p["own"]) for p in parts]))[by]
        bucket = (token.view(np.uint32).astype(np.uint64) * n_buckets >> np.uint64(32)).astype(np.int32)
        starts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(by))
        columns = {"token": token, "pos": pos} | {c: held[c][own] for c in ("doc_id", "place", "n", "bits")}
        arrays = [pa.array(bucket[starts[:-1]]), *(_slices(columns[c], starts) for c in ENTRY)]
        found = pa.RecordBatch.from_arrays(arrays, ["bucket", *ENTRY])
        step = max(1, len(arrays[0]) * BATCH_BYTES // found.nbytes)
        for k in range(0, found.num_rows, step):
            yield found.slice(k, step)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = None if held.value is None else np.unpackbits(held.value, bitorder="little").view(bool)
        parts, n = [], 0
        for batch in batches:
            token, own, pos = _prefixes(batch)
            if apart is not None:
                kept = ~apart[token.view(np.uint32) >> np.uint32(32 - MARK_BITS)]
                token, own, pos = token[kept], own[kept], pos[kept]
            if len(token):
                whole = {c: batch.column(c).to_numpy() for c in ("doc_id", "place", "n")} | {"bits": _unpacked(batch.column("bits"))}
                parts.append({"token": token, "pos": pos, "own": own} | whole)
                n += len(token)
            if n >= PACK:
                yield from rows(parts)
                parts, n = [], 0
        if n:
            yield from rows(parts)

    return classes.select("doc_id", "place", "n", "bits", "prefix").mapInArrow(tidy(pack), "bucket int, " + ", ".join(f"{c} binary" for c in ENTRY))


def entries_in(table: pa.Table) -> pa.Table:
    """The entries of a table of `packed` buckets, sorted by word and size; none is split."""
    columns = {c: _bytes(table.column(c))[0].view(kind) for c, kind in PACKED.items()}
    by = np.argsort(columns["token"].view(np.uint32).astype(np.uint64) << np.uint64(32) | columns["n"].astype(np.uint64))
    bits = columns.pop("bits").reshape(-1, 2)[by]
    return pa.table({c: pa.array(x[by]) for c, x in columns.items()} | {"bits": _binary(bits), "split": pa.array(np.zeros(len(by), dtype=bool))})


def candidates(classes: DataFrame, common: DataFrame, n_entries: int, sure: float = SURE, wide: int = WIDE) -> DataFrame:
    """MET: the classes that meet a candidate by a prefix word, once a word: the nearest earlier one, if there is one,
    whether there are more, whether some may be unseen, and whether the class is part of a pair (`active`)."""

    def met(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _candidates(*_rows(table, ("token",)), sure, wide)
        split = table.column("split").to_numpy()
        out = np.flatnonzero(found.active | split)
        if len(out):
            yield _met(table, found, out, split)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_keys(batches, ("bucket",), 1):  # a batch of rows holds many entries
            yield from met(entries_in(table))

    def meet_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_keys(batches, ("token",)):
            yield from met(table)

    marked_ = None if common.isEmpty() else token_bitmap(common)
    found = packed(classes, n_entries, marked_).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), MET)
    if marked_ is None:
        return found
    several = dealt(classes, common, entries_among(classes, common, marked_)).repartition("token").sortWithinPartitions("token", "n")
    return found.unionByName(several.mapInArrow(tidy(meet_split), MET))


def nearest(met: DataFrame) -> DataFrame:
    """One row a class: (doc_id, place, x_id, x_place, more, unseen, active)."""
    near = F.when(F.col("x_id").isNotNull(), F.struct("far", "x_id", "x_place"))
    several = (F.max(near) != F.min(near)) | F.max("more")
    found = met.groupBy("doc_id", "place").agg(F.min(near).alias("x"), F.coalesce(several, F.lit(False)).alias("more"), F.max("unseen").alias("unseen"), F.max("active").alias("active"))
    return found.select("doc_id", "place", "x.x_id", "x.x_place", "more", "unseen", "active")


def word_sets(docs: DataFrame, at: DataFrame, places: np.ndarray) -> DataFrame:
    """(doc_id, place, n, bits, prefix, words): the words of the lines at `at` (doc_id, place), their rarest ones, and their
    counts in BUCKETS buckets.

    The places are marked in a bitmap of 2^MARK_BITS bits, so that lines which nobody asks for are mostly passed over
    where they are read, and no text is shuffled; a join on the exact place drops the others.
    """
    mix = lambda doc_id, place: (doc_id.view(np.uint64) * np.uint64(_ODD) ^ place.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = lambda doc_id, place: (mix(doc_id, place) >> np.uint64(64 - MARK_BITS)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(bucket(batch.column("doc_id").to_numpy(), batch.column("place").to_numpy())))], ["bucket"])

    held = docs.sparkSession.sparkContext.broadcast((bitmap(at.mapInArrow(mark, "bucket long"), "bucket", MARK_BITS), places))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, order = held.value
        wanted, order = np.unpackbits(marked, bitorder="little").view(bool), order.astype(np.uint64)
        for batch in batches:
            ids, marks, seen = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy(), 0
            for block in blocks(_texts(batch)):
                n_lines = np.array([t.count("\n") + 1 for t in block])
                doc = np.repeat(np.arange(len(block)), n_lines)
                own_ids, own_place = ids[seen + doc], ((np.arange(len(doc)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)) << 32) | marks[seen + doc]
                asked = wanted[bucket(own_ids, own_place)]
                if asked.any():
                    chosen, own_ids, own_place = [x for x, a in zip("\n".join(block).split("\n"), asked.tolist()) if a], own_ids[asked], own_place[asked]
                    for k in range(0, len(chosen), 1 << 14):
                        some = slice(k, k + (1 << 14))
                        yield sets(chosen[some], own_ids[some], own_place[some], order)
                seen += len(block)

    def sets(texts: list[str], ids: np.ndarray, place: np.ndarray, order: np.ndarray) -> pa.RecordBatch:
        line, h, _ = words_of(texts)
        of, h = _distinct(line, h, order)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        n, own = np.diff(starts, append=len(of)), of[starts]
        counts = np.bincount(np.repeat(np.arange(len(starts)), n) * BUCKETS + (_again(h) >> np.uint64(57)).astype(np.int64), minlength=BUCKETS * len(starts))
        taken, offsets = _taken(starts, prefix_size(n))
        prefix = _slices(_prefix_tokens(h[taken]), offsets)
        words = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
        parts = [pa.array(ids[own]), pa.array(place[own]), pa.array(n.astype(np.int32)), _binary(counts.astype(np.uint8).reshape(-1, BUCKETS)), prefix, words]
        return pa.RecordBatch.from_arrays(parts, ["doc_id", "place", "n", "bits", "prefix", "words"])

    found = docs.select("doc_id", "text", "mark").mapInArrow(tidy(read), "doc_id long, place long, n int, bits binary, prefix binary, words array<long>")
    return found.join(at.select("doc_id", "place"), ["doc_id", "place"], "left_semi").dropDuplicates(["doc_id", "place"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, place) of the pairs (with x_id, x_place) whose sets of words are similar enough."""
    own = sets.select("doc_id", "place", "words")
    x = own.select(F.col("doc_id").alias("x_id"), F.col("place").alias("x_place"), F.col("words").alias("x_words"))
    common = F.size(F.array_intersect("words", "x_words"))
    both = pairs.join(own, ["doc_id", "place"]).join(x, ["x_id", "x_place"])
    return both.where(DENOMINATOR * common >= NUMERATOR * (F.size("words") + F.size("x_words") - common)).select("doc_id", "place").distinct()


def meetings(x: DataFrame, y: DataFrame, part: int = PART) -> DataFrame:
    """Entries x and y whose word both sides have, as cells (token, x_part, y_part) of at most about `part` rows a side."""
    kinds = {"x": x, "y": y}
    cells = None
    for end, rows in kinds.items():
        counts = rows.groupBy("token").agg(F.ceil(F.count("*") / part).cast("int").alias(f"{end}_parts"))
        cells = counts if cells is None else cells.join(counts, "token")
    cells = staged(cells)
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    sides = []
    for end, other in ("xy", "yx"):
        rows = kinds[end].join(cells, "token").withColumn(f"{end}_part", part_of(F.col(f"{end}_parts"))).withColumn(f"{other}_part", every(f"{other}_parts"))
        sides.append(rows.select(*ENTRY, "x_part", "y_part", F.lit(end == "y").alias("asks")))
    return sides[0].unionByName(sides[1]).repartition("token", "x_part", "y_part").sortWithinPartitions("token", "x_part", "y_part", "n")


CELL = ("token", "x_part", "y_part")


def _asked(table: pa.Table) -> Iterator[tuple[_Found, np.ndarray, np.ndarray]]:
    """(what was found, x, y) of a table of whole cells: rows that ask, y, meet the earlier ones that don't, x."""
    rows, rank, starts, ends = _rows(table, CELL)
    asks, n = table.column("asks").to_numpy(), rows["n"]
    group = np.repeat(np.arange(len(starts)), ends - starts)
    low, high = _size_window(group, n, (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR, DENOMINATOR * n // NUMERATOR)
    high[~asks] = 0
    ids, places = table.column("doc_id").to_numpy(), table.column("place").to_numpy()
    found = _Found(rank)
    for x, y in _windows(low, high):
        later = ~asks[x] & ((ids[x] < ids[y]) | ((ids[x] == ids[y]) & (places[x] < places[y])))
        x, y, far = _near(rows, x[later], y[later])
        found.add(x, y, far)
        yield found, x, y
    yield found, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)


def asked_nearest(cells: DataFrame) -> DataFrame:
    """MET of `meetings`: of each y its nearest x; x come as active."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_keys(batches, CELL):
            for found, _, _ in _asked(table):
                pass
            out = np.flatnonzero(found.active)
            if len(out):
                yield _met(table, found, out, np.zeros(table.num_rows, dtype=bool))

    return cells.mapInArrow(meet, MET)


PAIR = "doc_id long, place long, x_id long, x_place long"


def asked_pairs(cells: DataFrame) -> DataFrame:
    """(doc_id, place, x_id, x_place): all pairs of `meetings` that pass the filters."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_keys(batches, CELL):
            ids, places = table.column("doc_id").combine_chunks(), table.column("place").combine_chunks()
            for _, x, y in _asked(table):
                if len(y):
                    x, y = pa.array(x), pa.array(y)
                    yield pa.RecordBatch.from_arrays([ids.take(y), places.take(y), ids.take(x), places.take(x)], ["doc_id", "place", "x_id", "x_place"])

    return cells.mapInArrow(meet, PAIR).distinct()


def token_bitmap(tokens: DataFrame) -> np.ndarray:
    """2^MARK_BITS bits that mark prefix words (token)."""
    return bitmap(tokens.select(F.shiftrightunsigned("token", 32 - MARK_BITS).cast("long").alias("b")), "b", MARK_BITS)


def entries_among(classes: DataFrame, tokens: DataFrame, marked: np.ndarray | None = None) -> DataFrame:
    """The entries of classes for prefix words that `tokens` (token) may hold, by a `token_bitmap`."""
    held = classes.sparkSession.sparkContext.broadcast(token_bitmap(tokens) if marked is None else marked)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(held.value, bitorder="little").view(bool)
        for batch in batches:
            yield _entries(batch, wanted)

    return classes.select("doc_id", "place", "n", "bits", "prefix").mapInArrow(read, ENTRIES)


def settled(sets: DataFrame, open_: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, place) of `open_` that are similar to one of the earlier `sets`: the nearest is verified first, then, of
    what is left, every candidate."""
    at = ["doc_id", "place"]
    asks = staged(entries_of(sets.join(open_, at, "left_semi")))
    others = staged(entries_among(sets, asks.select("token")))  # read twice
    cells = staged(meetings(others, asks, part))
    met = staged(nearest(asked_nearest(again(cells))).where("x_id is not null"))
    similar = staged(verified(met, sets))
    left = staged(met.where("more").select(*at).join(similar, at, "left_anti"))
    if not left.isEmpty():
        kept = cells.where("not asks").unionByName(cells.where("asks").join(left, at, "left_semi"))
        similar = staged(similar.unionByName(verified(asked_pairs(again(kept)), sets)))
    forget(asks, others, cells, met, left)
    return similar


def again(cells: DataFrame) -> DataFrame:
    return cells.repartition(*CELL).sortWithinPartitions(*CELL, "n")


def removed_lines(docs: DataFrame, sure: float = SURE, part: int = PART, wide: int = WIDE) -> DataFrame:
    """(doc_id, place) of each line to remove; place holds the line's number in its high half. Null ids come as NO_ID."""
    return removed_from(marked(docs), sure, part, wide).distinct()


def removed_from(docs: DataFrame, sure: float = SURE, part: int = PART, wide: int = WIDE) -> DataFrame:
    """`removed_lines` of `marked` rows, once for each row."""
    at = ["doc_id", "place"]
    small_batches(docs)
    places = rarity(docs)
    lines = staged(lines_of(docs, places))
    grouped = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "place", "n", "bits", "prefix")).alias("c"), F.count("*").alias("n_lines"))
    classes = staged(grouped.select("k1", "k2", "n_lines", "c.*"))
    counts = prefix_counts(classes)
    common = staged(common_words(classes, part, counts))
    met = staged(nearest(candidates(classes, common, int(counts.sum()), sure, wide)))
    sets = staged(word_sets(docs, met.where("active"), places))
    similar = staged(verified(met.where("x_id is not null"), sets))
    left = staged(met.where("more or unseen").select(*at, "unseen").join(similar, at, "left_anti"))
    unseen = left.where("unseen")
    if not unseen.isEmpty():
        asks = staged(entries_of(classes.join(unseen, at, "left_semi")))
        others = staged(entries_among(classes, asks.select("token")))  # read twice
        more = staged(nearest(asked_nearest(meetings(others, asks, part))).select(*at).join(sets, at, "left_anti"))
        sets = sets.unionByName(staged(word_sets(docs, more, places)))
        forget(asks, others)
    if not left.isEmpty():
        similar = similar.unionByName(settled(sets, left.select(*at), part))
    forget(common, met, left)
    gone = similar.select(F.col("doc_id").alias("f_id"), F.col("place").alias("f_place"), F.lit(True).alias("gone"))
    firsts = classes.select("k1", "k2", "n_lines", F.col("doc_id").alias("f_id"), F.col("place").alias("f_place"))
    firsts = firsts.join(gone, ["f_id", "f_place"], "left").where("gone or n_lines > 1")
    found = lines.select("doc_id", "place", "k1", "k2").join(firsts, ["k1", "k2"])
    return found.where("gone or doc_id <> f_id or place <> f_place").select("doc_id", "place")


def removals(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, removed) of `marked` rows: the numbers of the lines to remove from each document that loses any."""
    found = removed_from(rows)
    number, mark = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    return found.groupBy("doc_id", mark.alias("mark")).agg(F.sort_array(F.collect_set(number)).alias("removed"))


def deduped(docs: DataFrame, into: str = "removed_lines") -> DataFrame:
    """`docs` with the texts less their removed lines, and a column of the removed lines' numbers (from 0). Other columns stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # the caller's other columns travel in one, so that no name can clash
    packed = docs.select("doc_id", "text", F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest"))
    rows = packed.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    turns = clashes(rows)
    turns = None if turns.isEmpty() else turns
    gone = removals(with_mark(rows, turns, "mark"))
    keyed = with_mark(packed.select(F.col("doc_id").alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", "rest"), turns, "mark")

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    clean = F.when(F.col("removed").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), without))
    joined = keyed.join(gone, ["doc_id", "mark"], "left")
    columns = {"doc_id": F.col("own"), "text": clean, **{c: F.col("rest").getField(c) for c in rest}}
    columns = {c: columns[c] for c in docs.columns} | {into: F.coalesce("removed", F.array().cast("array<int>"))}
    return joined.select(*(v.alias(c) for c, v in columns.items()))


def digest(docs: DataFrame) -> DataFrame:
    """What query op8 returns: each document's lines, how many are removed, and their numbers."""
    rows = docs.select("doc_id", "text")
    turns = clashes(rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text"))
    turns = None if turns.isEmpty() else turns
    keyed = with_mark(rows.select(F.col("doc_id").alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text"), turns, "mark")
    gone = removals(keyed.drop("own"))
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(ends + 1).cast("long")
    found = keyed.select("own", "doc_id", "mark", n_lines.alias("n_lines")).join(gone, ["doc_id", "mark"], "left")
    return found.select(F.col("own").alias("doc_id"), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"))
