"""Quality scores by a byte-level convolutional network, in numpy.

A text's bytes are covered by overlapping chunks. Learned filters slide over each chunk (a filter has a weight
for each byte value at each of its places), each filter's largest response in the chunk is kept, and the text's
features are the largest and the mean of these over all its chunks, with the share of chunks where a filter
responds at all. One logistic unit combines them into a probability.

It learns from a bounded sample of labelled rows (about ROWS_PER_CLASS of each label, chosen by a hash of the id,
weighed so that the labels keep their shares), whole texts each. Null and empty texts are one chunk of zero bytes.
With no labels every score is 0.5. Rows that repeat get equal scores. An empty table gives an empty result. A very long
text is covered by chunks like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import blocks, labelled_sample, remainder, small_batches

CHUNK, OVERLAP = 320, 64
WIDTH, FILTERS = 6, 16
ROWS_PER_CLASS, EPOCHS, RATE, BATCH = 1_500, 6, 0.02, 32


class Net(NamedTuple):
    filters: np.ndarray  # place x byte x filter
    offset: np.ndarray  # of each filter
    weights: np.ndarray  # of each text feature
    bias: np.ndarray


def chunks_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(chunk x byte, number of the text of each chunk); the last chunk of a text ends with its last byte."""
    step = CHUNK - OVERLAP
    raw = [t.encode() for t in texts]
    counts = np.array([max(1, -(-(len(r) - OVERLAP) // step)) for r in raw])
    out = np.zeros((int(counts.sum()), CHUNK), dtype=np.uint8)
    at = 0
    for r, n in zip(raw, counts.tolist()):
        b = np.frombuffer(r, dtype=np.uint8)
        if len(b) <= CHUNK:
            out[at, : len(b)] = b
        else:
            starts = np.minimum(np.arange(n) * step, len(b) - CHUNK)
            out[at : at + n] = np.lib.stride_tricks.sliding_window_view(b, CHUNK)[starts]
        at += n
    return out, np.repeat(np.arange(len(texts)), counts)


def responses(net: Net, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response in each chunk, and where."""
    places = CHUNK - WIDTH + 1
    best = np.empty((len(chunks), FILTERS), dtype=np.float32)
    where = np.empty((len(chunks), FILTERS), dtype=np.int32)
    for a in range(0, len(chunks), 256):
        part = chunks[a : a + 256]
        found = net.filters[0][part[:, :places]]
        for k in range(1, WIDTH):
            found += net.filters[k][part[:, k : k + places]]
        top = found.argmax(axis=1)
        where[a : a + 256] = top
        best[a : a + 256] = np.take_along_axis(found, top[:, None, :], axis=1)[:, 0]
    return best + net.offset, where


def pooled(best: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text features (largest, mean, share above zero) of rectified responses, and the rectified responses."""
    on = np.tanh(np.maximum(best, 0))
    largest = np.maximum.reduceat(on, starts, axis=0)
    mean = np.add.reduceat(on, starts, axis=0) / counts[:, None]
    share = np.add.reduceat((best > 0).astype(np.float32), starts, axis=0) / counts[:, None]
    return np.concatenate([largest, mean, share], axis=1), on


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score_block(net: Net, texts: list[str]) -> np.ndarray:
    chunks, doc = chunks_of(texts)
    counts = np.bincount(doc, minlength=len(texts))
    best, _ = responses(net, chunks)
    features, _ = pooled(best, np.cumsum(counts) - counts, counts)
    return sigmoid(features @ net.weights + net.bias[0])


def learned(texts: list[str], labels: list[int], shares: list[float]) -> Net:
    """Adam on the weighed log loss; a filter's gradient falls on the bytes under its largest responses alone."""
    rnd = np.random.default_rng(11)
    net = Net(
        (rnd.normal(size=(WIDTH, 256, FILTERS)) * 0.25).astype(np.float32),
        np.zeros(FILTERS, dtype=np.float32),
        (rnd.normal(size=3 * FILTERS) * 0.1).astype(np.float32),
        np.zeros(1, dtype=np.float32),
    )
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net]
    y, share = np.array(labels, dtype=np.float32), np.array(shares, dtype=np.float32)
    chunks, doc = chunks_of(texts)
    counts = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(counts) - counts
    step = 0
    for epoch in range(EPOCHS):
        order = rnd.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            n = counts[pick]
            starts = np.cumsum(n) - n
            rows = np.repeat(first[pick] - starts, n) + np.arange(n.sum())
            best, where = responses(net, chunks[rows])
            features, on = pooled(best, starts, n)
            wrong = (sigmoid(features @ net.weights + net.bias[0]) - y[pick]) * share[pick] / len(pick)
            by_feature = wrong[:, None] * net.weights[None, :]
            of = np.repeat(np.arange(len(pick)), n)
            top = on == features[:, :FILTERS][of]
            ties = np.add.reduceat(top, starts, axis=0)[of]
            grad = by_feature[:, :FILTERS][of] * top / ties + by_feature[:, FILTERS : 2 * FILTERS][of] / n[of, None]
            grad *= (best > 0) * (1 - on**2)
            by_filter = np.zeros_like(net.filters)
            picked = chunks[rows]
            f = np.broadcast_to(np.arange(FILTERS), where.shape)
            for k in range(WIDTH):
                np.add.at(by_filter[k], (np.take_along_axis(picked, where + k, axis=1), f), grad)
            grads = (by_filter, grad.sum(axis=0), wrong @ features + 1e-4 * net.weights, np.array([wrong.sum()], dtype=np.float32))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (m, v) in zip(net, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def trained(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Net | None:
    """A network that learned from about `rows` rows of each label; None without labelled rows."""
    found = labelled_sample(docs, labels, label, rows, doc_id, text)
    if found.empty:
        return None
    return learned(found["text"].tolist(), found["label"].tolist(), found["share"].tolist())


def scored(docs: DataFrame, net: Net | None, text: str = "text", into: str = "quality") -> DataFrame:
    """`docs` with a double column: how likely the whole text is of label 1."""
    if net is None:
        return docs.withColumn(into, F.lit(0.5))
    held = small_batches(docs).sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x for block in blocks(texts) for x in score_block(held.value, block)], dtype="float64")

    return docs.withColumn(into, score(F.col(text)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What query op3 returns."""
    docs, held_out = docs.select("doc_id", "text"), remainder("doc_id", 5) == 0
    net = trained(docs.where(~held_out), labels)
    found = scored(docs, net, into="score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
