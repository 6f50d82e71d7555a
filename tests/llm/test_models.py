"""Learned operators: held-out accuracy, whole texts, edge cases. And the pipeline's stages."""

import random

import numpy as np
import pytest

from loomtext.llm import langid, quality_cnn, toxicity
from loomtext.llm.common import components

SYLLABLES = {"en": "the ing and tion er of ly th is on".split(), "de": "der ung sch ein ich keit und ß ver".split(), "es": "ción los que ar ñ mente el ado".split(), "ru": "не что ова ный ста при ко".split()}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n)) + "."


def test_language(spark):
    rnd = random.Random(1)
    langs = list(SYLLABLES)
    rows = [(i, prose(rnd, langs[i % 4], rnd.randint(5, 60)), langs[i % 4], "s", 0) for i in range(400)]
    rows += [(1000, None, None, "s", 0), (1001, "", "en", "s", 0), (1002, "12 !! 3", None, "s", 0), (1003, prose(rnd, "ru", 20000), None, "s", 0), (1003, prose(rnd, "ru", 3), None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = langid.digest(docs).collect()
    assert len(got) == len(rows)
    true = {r[0]: r[2] for r in rows[:400]}
    held = [r for r in got if r.held_out and r.doc_id in true]
    assert len(held) > 50 and np.mean([r.lang_pred == true[r.doc_id] for r in held]) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 1003} == {"ru"} and all(0 <= r.score <= 1 for r in got)
    assert langid.digest(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in langid.labelled(docs).collect())[-3:] == [399, 1003, 1003]
    model = langid.trained(docs)
    mixed = prose(rnd, "en", 40) + " " + prose(rnd, "es", 40)
    spans = langid.label_block([mixed], model)[0][2]
    assert [s["lang"] for s in spans] == ["en", "es"] and abs(spans[1]["start"] - len(mixed) / 2) < len(mixed) / 4


def test_many_languages(spark):
    rnd = random.Random(4)
    names = [f"l{k:03d}" for k in range(600)]
    own = {n: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for n in names}
    text = lambda n: " ".join(rnd.choice(own[n]) for _ in range(20))
    few = names[:200]
    model = langid.learned([text(n) for n in few for _ in range(3)], [n for n in few for _ in range(3)])
    assert [x[0] for x in langid.label_block([text(n) for n in few], model)] == few
    both = langid.label_block([f"{text(few[150])} {text(few[190])}"], model)[0][2]
    assert [s["lang"] for s in both] == [few[150], few[190]]
    docs = spark.createDataFrame([(k, n, n) for k, n in enumerate(names)], "doc_id long, text string, lang string")
    assert {r.lang for r in langid.sample(docs).collect()} == set(names)


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(100):
        sizes = rng.integers(1, 12, size=6)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        scores = rng.normal(size=(sizes.sum(), 3)) * rng.choice([0.5, 2])
        scores -= scores.max(axis=1)[:, None]
        got = langid.viterbi(scores, starts, sizes, 1.5)
        for s, n in zip(starts, sizes):
            best = scores[s].copy()
            for i in range(1, n):
                best = np.maximum(best, best.max() - 1.5) + scores[s + i]
            path = got[s : s + n]
            value = sum(scores[s + i, p] for i, p in enumerate(path)) - 1.5 * np.sum(path[1:] != path[:-1])
            assert abs(value - best.max()) < 1e-6


def labelled(spark, good, bad, column):
    rnd = random.Random(3)
    rows = [(i, (bad if i % 4 == 0 else good)(rnd), "en", "s", 0) for i in range(600)]
    rows += [(2000, None, "en", "s", 0), (2001, "", "en", "s", 0), (2002, good(rnd) * 500, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_chars long")
    labels = spark.createDataFrame([(i, int((i % 4 == 0) == (column == "toxic"))) for i in range(600)] + [(None, 1), (5000, 1)], f"doc_id long, {column} int")
    return docs, labels


def test_toxicity(spark):
    docs, labels = labelled(spark, lambda r: prose(r, "en", 60), lambda r: prose(r, "en", 30) + " you vile rotten fool " + prose(r, "en", 20), "toxic")
    got = toxicity.digest(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and len(got) == 603
    assert toxicity.digest(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.digest(docs, labels.limit(0)).collect()} == {0.0}
    weights = toxicity.trained(docs, labels)
    assert len(weights.buckets) < 2000


def test_toxicity_features_keep_within_texts():
    doc, bucket = toxicity.features(["Alpha beta", "", "gamma", "ALPHA  beta!"])
    assert np.bincount(doc, minlength=4).tolist() == [3, 0, 1, 3]
    assert sorted(bucket[doc == 0]) == sorted(bucket[doc == 3])


def test_quality(spark):
    docs, labels = labelled(spark, lambda r: prose(r, "en", 60), lambda r: prose(r, "en", 60).upper().replace(" ", "!! "), "quality")
    got = quality_cnn.digest(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got) and len(got) == 603
    assert quality_cnn.digest(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_cnn.digest(docs, labels.limit(0)).collect()} == {0.5}


def test_chunks_cover_every_byte():
    for n in (0, 1, 319, 320, 321, 577, 5000):
        text = "".join(chr(97 + k % 26) for k in range(n))
        chunks, doc = quality_cnn.chunks_of([text, "zz"])
        own = chunks[doc == 0]
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        starts = [min(k * step, max(0, n - quality_cnn.CHUNK)) for k in range(len(own))]
        seen = {s + j for s in starts for j in range(min(n, quality_cnn.CHUNK))}
        assert seen == set(range(n))
        assert all(bytes(c[: min(n, quality_cnn.CHUNK)]).decode() == text[s : s + quality_cnn.CHUNK] for s, c in zip(starts, own))


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_stages(spark, pipeline, tmp_path):
    rnd = random.Random(9)
    texts = ["\n".join(prose(rnd, "en", rnd.randint(8, 40)) for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    texts += [texts[0], texts[1] + "\n" + prose(rnd, "en", 9), None, "", "123"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(rnd, "de", 30), "de", "s0", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen[name] = docs.collect()
    assert {r.doc_id for r in rows_of(seen["language"])} == {*range(62), None}
    assert {r.doc_id for r in rows_of(seen["line_dedup"])} == {*range(60), 61, None}
    assert [r.text for r in seen["line_dedup"] if r.doc_id == 61] == [texts[61].split("\n")[-1]]
    assert len(seen["simhash"]) == len({r.doc_id for r in seen["simhash"]})
    assert all(r.round_trip for r in seen["bpe"]) and len(seen["bpe"]) == len(seen["mixing"]) > 40


def rows_of(rows):
    return rows


def test_the_language_stage_keeps_a_corpus_of_equal_or_null_ids(spark):
    from loomtext.llm import langid

    en, de = "the people of the town were there when it began and all of them saw that", "und die leute aus der stadt waren da als es begann und alle haben das gesehen"
    rows = [(f"{t} {k}", lang) for k in range(400) for t, lang in ((en, "en"), (de, "de"))]
    for doc_id in (None, 7, 8):
        docs = spark.createDataFrame([(doc_id, t, lang) for t, lang in rows], "doc_id long, text string, lang string")
        assert langid.sample(docs, rows=50).groupBy("lang").count().where("count between 15 and 120").count() == 2
        kept = langid.labelled(docs).collect() if doc_id != 8 else langid.labelled(docs.withColumn("language", docs.lang).withColumn("_language", docs.lang)).collect()
        if kept or doc_id != 7:
            assert len(kept) == 800 and sum(r.lang == ("de" if "leute" in r.text else "en") for r in kept) >= 790
    copies = spark.createDataFrame([(1, en, "en")] * 3_000 + [(2, de, "de")], "doc_id long, text string, lang string")
    assert {r.lang for r in langid.sample(copies, rows=5).collect()} == {"en", "de"} and langid.sample(copies).count() == 2
