import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from loomtext.functions import fingerprint
from loomtext.operators import ranges
from loomtext.sources import html


def pages(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(["a", "bc", "é", "\U0001f600", " ", "  ", "\n\t", "."]) for _ in range(rng.randrange(0, 9)))
    rows = []
    for k in range(n):
        body = "".join(rng.choice([text(), f"<b>{text()}</b>", f"<i>{text()}<u>{text()}</u></i>", f"<nav>{text()}</nav>", f"</p><p>{text()}"]) for _ in range(rng.randrange(1, 9)))
        rows.append((k, f"<div><p>{body}</p></div>"))
    return rows


def clamped(raw, want):
    at = len(raw) - len(raw.lstrip())
    while want > 0 and at < len(raw):
        at += len(re.match(r"\s+|.", raw[at:], re.S)[0])
        want -= 1
    return at


def test_pieces_and_ranges_are_the_text(spark):
    frame = spark.createDataFrame(pages(1, 150), "page_id long, html string")
    found = html.nodes(frame)
    roots = found.where("path = array()").select("page_id", F.col("node").alias("root")).where("root = 0")
    texts = {(r.page_id, r.block): r.text for r in html.blocks(found, roots).collect()}
    parts = ranges.pieces(found, roots)
    by = {}
    for r in parts.orderBy("node").collect():
        by.setdefault((r.page_id, r.block), []).append(r)
        if (r.page_id, r.block) in texts:
            assert texts[r.page_id, r.block][r.start : r.end] == re.sub(r"\s+", " ", r.raw).strip()
    rng, spans = random.Random(2), []
    for key, t in texts.items():
        for idx in range(12):
            start = rng.randrange(len(t) + 2)
            spans.append((*key, idx, start, start + rng.randrange(len(t) + 3)))
    want = {}
    for page, block, idx, start, end in spans:
        p = by[page, block]
        first = next((x for x in p if start < x.end), None)
        if first is None:
            continue
        last = next((x for x in p if end <= x.end), None)
        stop = (p[-1].node, len(p[-1].raw)) if last is None else (last.node, clamped(last.raw, end - last.start))
        want[page, block, idx] = (first.node, clamped(first.raw, start - first.start), *stop)
    got = ranges.node_ranges(spark.createDataFrame(spans, "page_id long, block int, idx int, start int, end int"), parts).collect()
    assert {(r.page_id, r.block, r.idx): (r.start_node, r.start_offset, r.end_node, r.end_offset) for r in got} == want and len(want) > 500
    assert len(got) == len(want)


def test_sentences_at(spark):
    rows = [(1, 0, 5, 2, 5, 9), (1, 1, 5, 9, 8, 1), (1, 2, 6, 0, 6, 4), (2, 0, 5, 0, 5, 1)]
    found = spark.createDataFrame(rows, "page_id long, sentence int, start_node int, start_offset int, end_node int, end_offset int")
    points = [(0, 1, 5, 1), (1, 1, 5, 2), (2, 1, 5, 9), (3, 1, 6, 2), (4, 1, 8, 2), (5, 2, 5, 1), (6, 3, 0, 0), (7, None, 0, 0)]
    got = ranges.sentences_at(found, spark.createDataFrame(points, "point int, page_id long, node int, offset int"))
    assert {r.point: r.sentence for r in got.collect()} == {0: -1, 1: 0, 2: 0, 3: 1, 4: -1, 5: 0, 6: -1, 7: -1}


def test_fingerprints(spark):
    hashed = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()[:16]
    cases = [
        ('{"b": 1, "a": [1.0, {"_x": 2, "z": null}], "_c": {}}', '{"a":[1,{"z":null}],"b":1}'), ('{"10": 1, "9": 2, "a": 3, "01": 4}', '{"9":2,"10":1,"01":4,"a":3}'),
        ('["é\\n", "\\u0001", true, -0.0, 1e21, 1.5e-7, 0.00001, 123456789012345680000, -2.50, 1e400]', '["é\\n","\\u0001",true,0,1e+21,1.5e-7,0.00001,123456789012345680000,-2.5,null]'),
        ('  "x" ', '"x"'), ("[]", "[]"),
    ]
    rows = [(k, t) for k, (t, _) in enumerate(cases)] + [(90, None), (91, "{broken"), (92, ""), (93, "NaN"), (94, "[" * 100_000)]
    got = {r.k: r.f for r in spark.createDataFrame(rows, "k int, t string").select("k", fingerprint.fingerprint(F.col("t")).alias("f")).collect()}
    assert [got[k].fingerprint for k in range(len(cases))] == [hashed(t) for _, t in cases]
    assert [(got[k].fingerprint, got[k].error) for k in range(90, 95)] == [(None, "null")] + [(None, "invalid JSON")] * 4
    files = spark.createDataFrame([("s", "b", "2"), ("s", "a", "1"), ("s", "c", None), ("t", "a", None)], "g string, name string, fingerprint string")
    assert {r.g: (r.combined, r.n) for r in fingerprint.combined(files, ["g"]).collect()} == {"s": (hashed("a:1\nb:2"), 2), "t": (hashed(""), 0)}
    assert json.loads(cases[0][1])
