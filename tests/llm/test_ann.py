import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    fine = {i: np.array(v, dtype=np.float64) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in fine if i % every == 0):
        near = sorted((float(np.sqrt(((fine[q] - v) ** 2).sum())), i) for i, v in fine.items() if i != q)[:k]
        out[q] = [(i, d) for d, i in near]
    return out


def collected(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_small_tables_are_exact(spark):
    rnd = random.Random(3)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rnd.gauss(0, 1)) for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300, None), (301, [0.0] * 8), (310, [float("nan")] * 8), (320, [None] * 8), (330, [1.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got, expected = collected(ann.neighbours(frame, every=10)), brute(rows[:-1], 10, 10)
    assert got.keys() == expected.keys()
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got[q], expected[q]))
    assert ann.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_and_lengths_that_repeat(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 3.0]), (5, [1.0, 1.0]), (None, [1.0, 0.5]), (10, [1.0]), (7, [4.0]), (8, [-0.0]), (9, [0.0, 3.0])]
    found = ann.neighbours(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), every=10).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in found)
    far, side, up = round(10**0.5, 6), round(5**0.5, 6), 1.0
    first = [(0, 1, 0, 0.0), (0, 2, 5, up), (0, 3, 0, far), (0, 4, 9, far)]
    assert got == sorted([*first, *first, (0, 1, 9, 0.0), (0, 2, 5, side), (0, 3, 0, far), (0, 4, 0, far), (10, 1, 7, 3.0)])


def test_large_cells_are_halved(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 6)).astype(np.float32))]
    nodes = spark.createDataFrame(rows, "node long, vec array<float>").withColumn("cell", F.lit(7).cast("long"))
    cells = ann.split_cells(nodes.select("cell", "node", "vec"), 100)
    assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 100 and cells.select("node").distinct().count() == 900
    got, expected = collected(ann._neighbours(nodes.select(F.col("node").alias("row"), F.col("node").alias("vec_id"), "vec", "node"), 50, 10)), brute(rows, 50, 10)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected) >= 0.9 * 10 * len(expected)


def test_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16))
    v = (centres[rng.integers(0, 10, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(len(v))]
    frame = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA).withColumn("node", F.lit(1))
    got, expected = collected(ann.neighbours(frame, every=100)), brute(rows, 100, 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_a_round_gives_back_only_what_can_enter(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    nodes = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "node long, vec array<float>")
    pairs = ann._pairs
    ids, d = np.arange(400), ann.squared(v.astype(np.float64))
    reach = np.sort(d, axis=1)[:, 7]
    reach[5] = np.inf  # a list that isn't full
    a, b, far = pairs(ids, d, 12, reach)
    every = list(zip(*pairs(ids, d, 12)))
    assert set(zip(a, b, far)) == {(x, y, z) for x, y, z in every if z <= reach[x] or x == 5} and len(a) == 399 * 8 + 12 < len(every)
    graph = ann.nearest(spark.createDataFrame([(i, (i + s) % 400, float(d[i, (i + s) % 400])) for i in range(400) for s in range(1, 9)], "a long, b long, d double").withColumn("fresh", F.lit(False)), 8)
    done = {(r.a, r.b) for r in ann.descended(graph, nodes, 8, 8).collect()}
    links, lists = {}, {i: set() for i in range(400)}
    for r in graph.collect():
        links.setdefault(r.a, set()).add(r.b)
    for i in range(400):
        lists[i] |= links[i] | set(sorted((x for x in links if i in links[x]), key=lambda x: (d[x, i], x))[:8])
    met = {i: set(s) for i, s in links.items()}
    for members in lists.values():
        for x in members:
            met[x] |= set(sorted(members - {x}, key=lambda y: d[x, y])[: ann.NEAR])
    assert done == {(x, y) for x, s in met.items() for y in sorted(s, key=lambda y: (d[x, y], y))[:8]}
