"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint holds, bit by bit, the majority of the XXH64 values of its word shingles. Two
fingerprints link at a distance of RADIUS or less; a group is what links reach.

The index: a fingerprint is cut into SEGMENTS halves, with a table for each, keyed by the half's value. Two fingerprints
at distance 2 or less differ in at most one bit of one of their halves, so for each half the small Hamming ball around
its value is enumerated and looked up in the half's table, and the complete distance of what is found is verified. (A
bit that differs is 0 in one of the two, so only bits that are 0 are flipped: the other one's look-up would find the
same pair.)

A table entry of more than HOT fingerprints, as near copies share a half, isn't returned whole. It is indexed again by
the other half: its fingerprints enter under that half's ball, those whose look-up reached it by a flipped bit under
that half's value alone. All that meet under such a key are within 2 bits of each other, at most 65 of them, so each is
linked to the smallest. No link is lost: two fingerprints of an entry that differ in two bits meet under the key
between them.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share their fingerprint and
group. An empty table gives an empty result. Null ids stay; a group of null ids only has a null component.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm import near
from loomtext.llm.common import components, small_batches, staged

SEGMENTS, BITS, RADIUS, HOT = 2, 64, 2, 16


def simhash(text: str | None, words: int) -> int:
    """The fingerprint of one whole text, as a signed 64-bit integer."""
    import xxhash

    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(joined, 42)]
    else:
        ends = list(accumulate(len(t) + 1 for t in tokens))
        starts = [0, *ends]
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :])]
    h = np.array(hashes, dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 5, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """`docs` with a long column of fingerprints, over shingles of so many words."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in texts], dtype="int64")

    return small_batches(docs).withColumn(into, prints(F.col(text)))


def _half(fp: Column, s: int | Column) -> Column:
    """A half's value, as a long from 0."""
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, BITS // SEGMENTS)
    return (low, high)[s] if isinstance(s, int) else F.when(s == 0, low).otherwise(high)


def _ball(value: Column, only_zero_bits: bool = False) -> Column:
    """All values of a half with one bit flipped."""
    bits = F.sequence(F.lit(0), F.lit(BITS // SEGMENTS - 1))
    flipped = F.transform(bits, lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.filter(flipped, lambda v: v > value) if only_zero_bits else flipped


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` within RADIUS of each other."""
    fp, half = F.col("fp"), F.col("half")
    halves = F.array(*(F.struct(F.lit(s).alias("s"), _half(fp, s).alias("half")) for s in range(SEGMENTS)))
    table = prints.select("fp", F.explode(halves).alias("e")).select("fp", "e.s", "e.half")
    found = table.select("fp", "s", F.explode(F.concat(F.array(half), _ball(half, only_zero_bits=True))).alias("half"), half.alias("own"))
    crowded = staged(table.groupBy("s", "half").count().where(f"count > {hot}").select("s", "half"))
    stored = table.join(crowded, ["s", "half"], "left_anti").withColumnRenamed("fp", "other")
    pairs = found.join(stored, ["s", "half"]).where((half != F.col("own")) | (fp < F.col("other")))
    pairs = pairs.where(F.bit_count(fp.bitwiseXOR(F.col("other"))) <= RADIUS).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))

    rest = _half(fp, 1 - F.col("s"))
    keys = F.when(half == F.col("own"), F.concat(F.array(rest), _ball(rest))).otherwise(F.array(rest))
    again = found.join(crowded, ["s", "half"], "left_semi").select("fp", "s", "half", F.explode(keys).alias("rest"))
    met = again.withColumn("first", F.min("fp").over(Window.partitionBy("s", "half", "rest"))).where("first <> fp")
    met = met.where(F.bit_count(fp.bitwiseXOR(F.col("first"))) <= RADIUS).select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(met).distinct()


def grouped(docs: DataFrame, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`; component_id is the smallest id that links reach."""
    rows = staged(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words, "text", "fp").select("doc_id", "fp"))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    classes = classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(classes.select("fp", "root").join(least, "root").drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = 5) -> DataFrame:
    """`docs` with one row of each group of near duplicates: texts whose shingles have a Jaccard similarity of 0.8 or
    more. Op6's RADIUS finds few of them, so the stage has longer fingerprints with an index of more tables (see `near`). Columns stay."""
    return near.keep_first(docs, words)


def digest(docs: DataFrame, words: int = 3) -> DataFrame:
    """What query op6 returns."""
    found = grouped(docs, words)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
