"""Hard negatives against brute force in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = []
    for vec_id, vec, label in rows:
        if None in (vec_id, vec, label) or not vec or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        good.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    out = []
    for anchor, mine, vec in good:
        if anchor % 50:
            continue
        others = [(-sum(a * b for a, b in zip(vec, v)), i, label) for i, label, v in good if i != anchor and len(v) == len(vec)]
        for p_score, positive, _ in sorted(x for x in others if x[2] == mine)[:5]:
            near = sorted(x for x in others if x[2] != mine and 50 * -p_score <= 100 * -x[0] <= 95 * -p_score)[:3]
            out += [(anchor, positive, rank, i, -p_score, -s) for rank, (s, i, _) in enumerate(near, 1)]
    return sorted(out)


def vectors(seed, n, dims):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.2) for _ in range(dims)] for _ in range(4)]
    return [(k, [c + rnd.gauss(0, 0.1) for c in centres[rnd.randrange(4)]], rnd.randrange(3)) for k in range(n)]


@pytest.mark.parametrize("tables", [1 << 25, 1])
def test_mined(spark, monkeypatch, tables):
    monkeypatch.setattr(hn, "TABLES", tables)
    rows = vectors(1, 330, 6)
    rows += [(400 + k, [0.25] * 6, k % 2) for k in range(60)]  # copies of one vector, ties
    rows += rows[50:53] + [rows[100]] * 3 + [(None, [0.1] * 6, 1), (450, None, 1), (500, [0.3] * 6, None), (550, [0.1, None, 0.2], 0), (600, [float("nan")] * 6, 1), (601, [float("inf")] * 6, 1), (650, [], 1)]
    rows += [(700, [0.5, 0.5], 1), (701, [0.5, 0.4], 1), (702, [0.3, 0.4], 2), (750, [0.0] * 6, 1), (800, [9.0] * 6, 0), (-50, [-0.2] * 6, 2)]
    frame = spark.createDataFrame(rows, ROWS)
    got = sorted(tuple(r) for r in hn.digest(frame.withColumn("cells", F.lit(1)).withColumn("size", F.lit(2)).withColumn("vec", F.lit(3)).withColumn("score", F.lit(4))).collect())
    expected = brute(rows)
    assert got == expected and len(expected) > 50


def test_tables_without_rows(spark):
    assert hn.digest(spark.createDataFrame([], ROWS)).count() == 0
    assert hn.digest(spark.createDataFrame([(50, [0.1], 1)], ROWS)).count() == 0
    assert hn.digest(spark.createDataFrame([(50, None, 1), (100, [None], 2)], ROWS)).count() == 0


def test_components_that_are_too_large_stop_the_job(spark):
    with pytest.raises(Exception, match="too large"):
        hn.digest(spark.createDataFrame([(50, [1e30], 1), (51, [1.0], 1)], ROWS)).collect()


def test_bounds_hold_whatever_the_sample(spark):
    rng = np.random.default_rng(3)
    vecs = rng.integers(-200, 200, (500, 4))
    inner = np.sort(rng.integers(-20, 20, (4, hn.CELLS - 1)), axis=1)
    cells = hn.Cells(inner, np.concatenate([vecs.min(axis=0)[:, None], inner], axis=1), np.concatenate([inner - 1, vecs.max(axis=0)[:, None]], axis=1))
    codes = np.stack([np.searchsorted(inner[d], vecs[:, d], side="right") for d in range(4)])
    import pandas as pd

    frame = pd.DataFrame({"number": [0, 1], "vec_id": [0, 1], "label": [0, 0], "exact": [v.astype(np.int32).tobytes() for v in vecs[:2]]})
    anchors = hn.anchors_of(frame, cells, 4)
    exact = vecs[:2] @ vecs.T
    assert (hn.bounds(anchors.least, codes) <= exact).all() and (exact <= hn.bounds(anchors.most, codes)).all()
