"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the buckets of its words, word pairs and pairs that skip a word, each counted once. The
regression has learning rates by coordinate and an L1 penalty, so that most weights are exactly zero; the others
are sent to the tasks as two short arrays (at most BUCKETS entries, whatever the size of the corpus).

It learns from a bounded sample of labelled rows (about ROWS_PER_CLASS of each label, chosen by a hash of the id,
each weighed so that the labels keep their shares). Null and empty texts have no features and get the base rate.
With no labels every score is 0. Rows that repeat get equal scores. An empty table gives an empty result. A very long text
is hashed in pieces that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import blocks, labelled_sample, pieces, remainder, small_batches
from loomtext.llm.line_dedup import powers

BITS = 20
BUCKETS = 1 << BITS
ROWS_PER_CLASS, EPOCHS = 5_000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1

ODD = 0x9E3779B97F4A7C15


class Weights(NamedTuple):
    bias: float
    buckets: np.ndarray
    values: np.ndarray


@cache
def letter_bytes() -> np.ndarray:
    """Lower-cased letters and digits, and all bytes beyond ASCII, as they are; anything else as 0."""
    table = np.zeros(256, dtype=np.uint64)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            table[b] = ord(chr(b).lower()) if b < 128 else b
    return table


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, bucket) of all features of a block of texts, repeats included."""
    text_ends = np.cumsum([len(t.encode()) + 1 for t in texts])
    hashes, own, at = [], [], 0
    for raw, _ in pieces(("\n".join(texts) + "\n").encode()):
        c = letter_bytes()[raw]
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = c > 0
        edge = np.flatnonzero(np.diff(inside))
        starts, ends = edge[::2], edge[1::2]
        up, down = powers(len(raw) + 1)
        run = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(c * up[: len(raw)], dtype=np.uint64, out=run[1:])
        h = (run[ends] - run[starts]) * down[starts]
        h ^= h >> np.uint64(29)
        hashes.append(h * np.uint64(0xBF58476D1CE4E5B9))
        own.append(np.searchsorted(text_ends, at + starts, side="right"))
        at += len(raw)
    doc, h = np.concatenate(own), np.concatenate(hashes)
    docs, grams = [doc], [h]
    for gap, mix in ((1, 0x94D049BB133111EB), (2, 0xD6E8FEB86659FD93)):
        near = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][near])
        grams.append(((h[:-gap] * np.uint64(mix)) ^ h[gap:])[near] * np.uint64(ODD))
    buckets = np.concatenate(grams) >> np.uint64(64 - BITS)
    return np.concatenate(docs), buckets.astype(np.int64)


def learned(texts: list[str], labels: list[int], shares: list[float]) -> Weights:
    """FTRL-proximal over the texts in order, `shares` being the weight of each."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias = np.log((np.dot(labels, shares) + 0.5) / (np.dot(np.subtract(1, labels), shares) + 0.5)) if texts else 0.0
    rows, at = [], 0
    for block in blocks(texts):
        doc, bucket = features(block)
        keys = np.unique(doc * BUCKETS + bucket)
        cuts = np.searchsorted(keys, np.arange(len(block) + 1) * BUCKETS)
        rows += [(keys[a:b] & (BUCKETS - 1), labels[at + k], shares[at + k]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        at += len(block)
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            i, y, share = rows[k]
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30)))
            g = (p - y) * share
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
            bias -= 0.01 * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    used = np.flatnonzero(w)
    return Weights(float(bias), used.astype(np.int32), w[used].astype(np.float32))


def score_block(texts: list[str], dense: np.ndarray, bias: float) -> np.ndarray:
    doc, bucket = features(texts)
    known = dense[bucket] != 0
    keys = np.unique(doc[known] * BUCKETS + bucket[known])
    total = np.bincount(keys >> BITS, weights=dense[keys & (BUCKETS - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(bias + total, -30, 30)))


def trained(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Weights | None:
    """Weights learned from about `rows` rows of each label; None without labelled rows."""
    found = labelled_sample(docs, labels, label, rows, doc_id, text)
    if found.empty:
        return None
    return learned(found["text"].tolist(), found["label"].astype(int).tolist(), found["share"].tolist())


def scored(docs: DataFrame, weights: Weights | None, text: str = "text", into: str = "toxicity") -> DataFrame:
    """`docs` with a double column: how likely the whole text is toxic."""
    if weights is None:
        return docs.withColumn(into, F.lit(0.0))
    held = small_batches(docs).sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, buckets, values = held.value
        dense = np.zeros(BUCKETS, dtype=np.float32)
        dense[buckets] = values
        for texts in batches:
            yield pd.Series([x for block in blocks(texts) for x in score_block(block, dense, bias)], dtype="float64")

    return docs.withColumn(into, score(F.col(text)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What query op5 returns."""
    docs, held_out = docs.select("doc_id", "text"), remainder("doc_id", 5) == 0
    weights = trained(docs.where(~held_out), labels)
    found = scored(docs, weights, into="score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
