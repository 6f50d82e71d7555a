"""Phrase collocation mining: the phrases of 1 to MOST_WORDS words of all texts, counted by language and scored by how
strongly their parts belong together.

Texts are lower-cased (A to Z only), cut at marks and line ends into pieces, and those at blanks and tabs into words. Each
run of words inside a piece becomes a row and is counted by language; a phrase that stands LEAST times or more is a
candidate. It is scored at its weakest cut, floor(2000000 a / (l + r)) with a its count and l and r the counts of the parts,
dropped if a phrase one word longer holds COVERED hundredths of its places (if any longer candidate does, the one between
does too), and ranked within its language.

Most rows of a corpus stand there once, and would only be shuffled to be dropped, and text is shuffled dearly. So the rows
are exploded three times:

1. words and pairs, as 128-bit keys, counted: those that reach LEAST go into a filter of bounded size;
2. longer phrases of which the filter has every pair (a phrase is no commoner than a part of it), likewise;
3. the texts of the keys that are left, each from the documents of one bucket only, the one that came with its count.

A full filter lets more rows through to steps 2 and 3, never fewer; what it lets through by mistake finds no count. Counts are
summed in the tasks first, so a phrase that all documents hold is a row or a few of each task.

Null texts are empty; a null language is `und` (as the language `und` is). An empty table gives no rows. Repeated rows count
again. Ties: equal scores by count, then by the phrase's UTF-8 bytes, so that ranks are unique. Very long texts are taken in
slices that overlap by MOST_WORDS - 1 words. Only the two columns named are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import bitmap, forget, small_batches, staged, tidy
from loomtext.sources.tables import spread

MOST_WORDS, LEAST, COVERED, KEEP = 4, 30, 80, 2_000
#: Bytes of a slice; keys that a task holds before it gives them out; buckets of documents.
SLICE, HELD_KEYS, BUCKETS = 2_000_000, 4_000_000, 1 << 15
#: log2 of the bits of a filter, at least and at most (32 MB).
LEAST_BITS, MOST_BITS = 20, 28
#: Characters that part words, and that part pieces (fixed values).
BLANKS, MARKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"


class Slice(NamedTuple):
    raw: bytes
    start: np.ndarray  # of each word: its first byte,
    end: np.ndarray  # the byte behind it,
    piece: np.ndarray  # the number of its piece,
    bucket: np.ndarray  # and the bucket of its document
    carried: int  # words that the slice before has counted


@cache
def kinds() -> np.ndarray:
    """Of each byte: 0 in a word, 1 between words, 2 between pieces."""
    out = np.zeros(256, dtype=np.uint8)
    out[list(BLANKS)], out[list(MARKS)] = 1, 2
    return out


def slices(texts: pa.Array, buckets: np.ndarray, most_words: int, most: int) -> Iterator[Slice]:
    """The texts in slices of about `most` bytes that end with a word; a slice begins with the last words of the one before."""
    own = texts.cast(pa.binary())
    begin = np.cumsum(np.append(0, pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64) + 1))[:-1]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), b"\n")[0]
    raw, at, head, carried = joined.as_buffer().to_pybytes().lower(), 0, b"", 0
    parting = BLANKS + MARKS
    while at < len(raw):
        stop = min(at + most, len(raw))
        while stop < len(raw) and raw[stop] not in parting:
            stop += 1
        part, first = head + raw[at:stop], at - len(head)
        kind = kinds()[np.frombuffer(part, dtype=np.uint8)]
        inside = np.zeros(len(part) + 2, dtype=np.int8)
        inside[1:-1] = kind == 0
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bucket = buckets[np.searchsorted(begin, start + first, side="right") - 1]
        yield Slice(part, start, end, np.cumsum(kind == 2, dtype=np.int32)[start], bucket, carried)
        at, carried = stop, min(most_words - 1, len(start))
        head = part[start[-carried] :] if carried else b""


@cache
def hashing(which: int) -> tuple[np.ndarray, int, int]:
    """A number for each byte, an odd factor and its inverse, modulo 2^64."""
    rng = np.random.default_rng(which)
    factor = int(rng.integers(1 << 62)) * 2 + 1
    return rng.integers(0, 1 << 64, 256, dtype=np.uint64), factor, pow(factor, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(factor: int, n: int) -> np.ndarray:
    found = _POWERS.get(factor)
    if found is None or len(found) < n:
        found = np.full(max(n, SLICE + SLICE // 4), factor, dtype=np.uint64)
        found[0] = 1
        found = np.cumprod(found)
        if n <= SLICE + SLICE // 4:
            _POWERS[factor] = found
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(s: Slice, which: int) -> np.ndarray:
    """A 64-bit hash of each word: its bytes as a polynomial, from differences of one running sum."""
    value, factor, inverse = hashing(which)
    data = np.frombuffer(s.raw, dtype=np.uint8)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value[data] * powers(factor, len(data))[: len(data)], out=total[1:])
    return mixed((total[s.end] - total[s.start]) * powers(inverse, len(data) + 1)[s.start] + (s.end - s.start).astype(np.uint64))


def language_seed(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), dtype=np.uint64)[0]


def longer(keys: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Keys of n words from those of n - 1 words and the words' hashes."""
    return mixed(keys[: len(words) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :] + np.uint64(n))


def whole(s: Slice, n: int) -> np.ndarray:
    """Whether the n words from each word on stand in one piece and weren't counted by the slice before."""
    most = len(s.start) - n + 1
    return (s.piece[:most] == s.piece[n - 1 :]) & (np.arange(most) + n > s.carried)


class Filter(NamedTuple):
    """Bits of keys, two a key: holds every key put in, and a few others."""

    bits: int
    packed: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for shift in (0, 32):
            at = (keys >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            found &= (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def filter_of(keys: DataFrame) -> Filter:
    """Of a table with a column `key`: 32 bits a key at least, up to MOST_BITS, so its size is bounded."""
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * keys.count()).bit_length()))
    at = keys.select(F.explode(F.array(*(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) if not shift else F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in (0, 32)))).alias("bit"))
    return Filter(bits, bitmap(at, "bit", bits))


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    langs = pc.fill_null(batch.column("lang"), "und")
    for lang in pc.unique(langs).to_pylist():
        mine = pc.equal(langs, lang)
        yield lang, pc.fill_null(batch.column("text").filter(mine), ""), batch.column("bucket").filter(mine).to_numpy(zero_copy_only=False)


def keyed(s: Slice, lang: str, most_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first and second half of the keys of the n words from each word on), for n = 1, 2, ..."""
    seed, words = language_seed(lang), [word_hashes(s, which) for which in (1, 2)]
    keys = [mixed(w + seed) for w in words]
    for n in range(1, min(most_words, len(s.start)) + 1):
        if n > 1:
            keys = [longer(k, w, n) for k, w in zip(keys, words)]
        yield n, *keys


def runs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each distinct key, and how often the key occurs (a key may come twice if it shares its first half with another)."""
    order = np.argsort(first)
    a, b = first[order], second[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, dtype=np.int64)
    return order[new], np.diff(np.append(new, len(a)))


def frequent(docs: DataFrame, sizes: range, least: int, known: Filter | None, most_words: int) -> DataFrame:
    """(key, key2, f, bucket) of the phrases of `sizes` words that stand `least` times or more, with the bucket of some document
    that holds them; with `known`, of those of which it has every pair."""
    slice_bytes, most = SLICE, HELD_KEYS

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def given() -> pa.RecordBatch:
            first, second, bucket = (np.concatenate(x) for x in zip(*held))
            held.clear()
            at, counts = runs(first, second)
            columns = first[at].view(np.int64), second[at].view(np.int64), counts.astype(np.int32), bucket[at]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "key2", "n", "bucket"])

        for batch in batches:
            for lang, texts, buckets in by_language(batch):
                for s in slices(texts, buckets, most_words, slice_bytes):
                    paired = None
                    for n, first, second in keyed(s, lang, sizes[-1]):
                        if known is not None and n == 2:
                            paired = known.value.has(first)
                        if n in sizes:
                            good = whole(s, n)
                            if paired is not None:
                                for shift in range(n - 1):
                                    good &= paired[shift : shift + len(good)]
                            held.append((first[good], second[good], s.bucket[: len(good)][good]))
                    if sum(len(x) for x, _, _ in held) > most:
                        yield given()
        if held:
            yield given()

    if known is not None:
        known = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.mapInArrow(tidy(explode), "key long, key2 long, n int, bucket short")
    # dealt by key before it is summed: the tasks have summed their own rows
    counts = rows.repartition("key").groupBy("key", "key2").agg(F.sum("n").alias("f"), F.min("bucket").alias("bucket"))
    return staged(counts.where(F.col("f") >= least))


def placed(first: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """A key that holds for the documents of one bucket."""
    return mixed(first ^ ((bucket.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))


def named(docs: DataFrame, wanted: Filter, most_words: int) -> DataFrame:
    """(key, key2, lang, n_words, phrase, f): the texts of the keys that `wanted` has in their buckets; n_words 0, with f: how many words the language has."""
    wanted, slice_bytes, most = docs.sparkSession.sparkContext.broadcast(wanted), SLICE, HELD_KEYS // 8

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            for lang, texts, buckets in by_language(batch):
                for s in slices(texts, buckets, most_words, slice_bytes):
                    out = [(0, 0, lang, 0, "", len(s.start) - s.carried)]
                    for n, first, second in keyed(s, lang, most_words):
                        at = np.flatnonzero(whole(s, n))
                        at = at[wanted.value.has(placed(first[at], s.bucket[at]))]
                        at = at[runs(first[at], second[at])[0]]
                        for a, b, x, y in zip(first[at].view(np.int64).tolist(), second[at].view(np.int64).tolist(), s.start[at].tolist(), s.end[at + n - 1].tolist()):
                            if (a, b) not in given:
                                given.add((a, b))
                                out.append((a, b, lang, n, b" ".join(s.raw[x:y].split()).decode(), None))
                    if len(given) > most:
                        given.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()))], ["key", "key2", "lang", "n_words", "phrase", "f"])

    return docs.mapInArrow(tidy(explode), "key long, key2 long, lang string, n_words int, phrase string, f long")


def placed_keys(keys: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = placed(b.column("key").to_numpy().view(np.uint64), b.column("bucket").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["key"])

    return keys.select("key", "bucket").mapInArrow(run, "key long")


def phrase_counts(docs: DataFrame, least: int, most_words: int) -> DataFrame:
    """(lang, n_words, phrase, f) of the phrases that stand `least` times or more; n_words 0: all words of the language."""
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(BUCKETS)).cast("short"))
    keys = frequent(docs, range(1, 3), least, None, most_words)
    parts = [keys]
    if most_words > 2:
        parts.append(frequent(docs, range(3, most_words + 1), least, filter_of(keys), most_words))
        keys = keys.unionByName(parts[1])
    texts = staged(named(docs, filter_of(placed_keys(keys)), most_words))
    texts_of = texts.where("n_words > 0").groupBy("key", "key2").agg(F.min(F.struct("lang", "n_words", "phrase")).alias("of"))
    counts = keys.join(texts_of, ["key", "key2"]).select("of.*", "f")
    totals = texts.where("n_words = 0").groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))
    found = staged(counts.unionByName(totals))
    forget(texts, *parts)
    return found


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, score) of the phrases of two words and more, at the cut with the lowest score (ties: the first)."""
    words = F.split("phrase", " ")
    cuts = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "n_words", "a", "k",
        F.array_join(F.slice("words", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("n_words") - F.col("k")), " ").alias("tail"),
    )
    part = counts.where("n_words > 0").select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    both = cuts.join(part, ["lang", "head"]).join(part.withColumnsRenamed({"head": "tail", "l": "r"}), ["lang", "tail"])
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    least = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n_words")).alias("cut"))
    return least.select("lang", "phrase", "cut.n_words", "cut.a", "cut.l", "cut.r", "cut.score")


def covered(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most): the count of the commonest phrase that has one word more, in front or behind."""
    words = F.split("phrase", " ")
    parts = F.array(F.slice(words, 1, F.col("n_words") - 1), F.slice(words, 2, F.col("n_words") - 1))
    rows = counts.where("n_words > 2").select("lang", F.explode(parts).alias("part"), "f")
    return rows.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("f").alias("most"))


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST, keep: int = KEEP, covering: int = COVERED) -> DataFrame:
    """The first `keep` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    if most_words < 2:
        raise ValueError("a phrase to score has two words at least")
    docs = spread(small_batches(docs).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")))
    counts = phrase_counts(docs, least, most_words)
    over = covered(counts)
    decimal = lambda c: F.col(c).cast("decimal(20, 0)")
    found = scored(counts).join(over, ["lang", "phrase"], "left").where(F.col("most").isNull() | (decimal("most") * 100 < decimal("a") * covering))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep)
    totals = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for query op11.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
runs AS (
  SELECT lang, k AS n_words, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k))),
counts AS (SELECT lang, n_words, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, phrase, n_words, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE n_words > 1),
cuts AS (SELECT *, unnest(range(1, n_words)) AS k FROM candidates),
valued AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
weakest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
open AS (
  SELECT * FROM weakest c
  WHERE NOT EXISTS (SELECT 1 FROM candidates x WHERE x.lang = c.lang AND x.n_words > len(string_split(c.phrase, ' '))
                    AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ') AND 100::HUGEINT * x.a >= 80::HUGEINT * c.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM open)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
