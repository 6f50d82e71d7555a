"""Operators of column expressions against brute force: quality rules, license scans, mixing."""

import random
import re

import duckdb
import pyarrow as pa

from loomtext.llm import licenses, mixing, quality_rules

WORDS = r"[^\x20\x09-\x0D]+"


def rough_texts(seed, n):
    rnd = random.Random(seed)
    vocab = ["the", "of", "Home", "|", "a.", "b!", "###", "é", "one", "two,", "x" * 40, "…", "under", "the", "MIT", "License", "Apache", "2.0", "CC", "BY-NC"]
    sep = [" ", " ", "\n", "\t", "  ", "\n\n", "\r\n", "\x0b", "\xa0"]
    return ["".join(rnd.choice(vocab) + rnd.choice(sep) for _ in range(rnd.choice([0, 3, 60, 200]))) for _ in range(n)]


def test_quality_rules(spark, documents):
    texts = [None, "", " \n ", "word " * 60, "a b c " * 40, *rough_texts(1, 60)]
    texts += texts[5:8]
    docs = documents(texts)
    got = {r.doc_id: r for r in quality_rules.digest(docs.withColumn("_words", docs.lang).withColumn("kept", docs.lang)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(WORDS, t or "")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(WORDS, x)]
        expected = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    assert {r[0]: r[7] for r in con.execute(quality_rules.ORACLE_SQL).fetchall()} == {i: r.kept for i, r in got.items()}
    assert quality_rules.digest(documents([])).count() == 0


def test_quality_rules_keep_a_callers_columns(spark, documents):
    from pyspark.sql import functions as F

    docs = documents(["Some words stand here."]).withColumn("_words", F.lit("w")).withColumn("_LINES", F.lit("l")).withColumn("_rules", F.lit("r")).withColumn("_words_", F.lit("x"))
    row = quality_rules.judged(docs, into="verdict").first()
    assert (row["_words"], row["_LINES"], row["_rules"], row["_words_"]) == ("w", "l", "r", "x") and row.verdict.n_words == 4
    assert quality_rules.judged(docs).first()["_rules"].n_words == 4


def test_lines_are_cleaned_first(spark, documents):
    prose = " ".join(f"Word{k} goes{k} on{k} for{k} long{k}, and ends{k}." for k in range(12))
    docs = documents([prose + "\nHome | About | News | Contact | Login\nAll rights reserved by us.", "Home | News | Login\n" * 40 + prose[:200]])
    a, b = quality_rules.judged(docs).orderBy("doc_id").select("_rules.*").collect()
    assert a.kept and a.clean_text == prose and not b.kept


def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark, documents):
    gpl = "x y. This work is licensed under the GNU General Public License, version 3. z"
    words = "a b c d the of " * 50
    texts = [None, "", "Released under the MIT License.", "under the MIT license " * 300, "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0", gpl, words + gpl + words, "GNU is Not Unix; a public version of a general work", *rough_texts(2, 60)]
    texts += texts[2:4]
    docs = documents(texts)
    got = {r.doc_id: r for r in licenses.digest(docs.withColumn("_license", docs.lang)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[5].labels == got[6].labels == "gpl-3" and got[7].labels == ""
    assert licenses.digest(documents([])).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    total, capped, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [n for n in names if n not in capped]
        left = total - sum(2 * sizes[n] for n in capped)
        target = {n: 2 * sizes[n] for n in capped} | {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if target[n] > 2 * sizes[n]]
        if not over:
            return target
        capped |= set(over)


def test_mixing(spark, documents):
    rnd = random.Random(4)
    texts = [None, "", *(" ".join(["w"] * rnd.choice([1, 5, 40, 300])) for _ in range(400))]
    sources = {i: rnd.choice(["a", "a", "a", "b", "Z", "é", None]) for i in range(len(texts))}
    rows = [(i, t, "en", sources[i], 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")
    got = mixing.digest(docs).collect()
    size = {i: len(re.findall(WORDS, t or "")) for i, t in enumerate(texts)}
    assert {r.doc_id: r["size"] for r in got} == size and len(got) == len(texts)
    totals = {}
    for i, s in sources.items():
        totals[s] = totals.get(s, 0) + size[i]
    target = brute_targets(totals)
    taken = {}
    for r in got:
        s = sources[r.doc_id]
        assert r.source_size == totals[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken in (0, r["size"], 2 * r["size"]) and 0 <= r.rate <= 2
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 5 for s in taken)
    again = {r.doc_id: r.taken for r in mixing.digest(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.digest(docs.limit(0)).count() == 0
    only = mixing.digest(docs.where("doc_id < 2")).collect()
    assert [r.taken for r in only] == [0, 0]


def test_mixing_tells_rows_that_share_an_id_apart(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i % 40, words(10 + i % 7 + 20 * (i % 2)), "en", "ac"[i % 2], 0) for i in range(160)]
    rows += [(None, f"{words(9)} {i}", "en", "b", 0) for i in range(120)] + [(7, words(33), "en", "d", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    copies, words_of, target = {}, {}, {}
    for r in got:
        copies.setdefault((r.doc_id, r.source, r.mark), set()).add(r.copies)
        words_of[r.source] = words_of.get(r.source, 0) + r.copies * r["size"]
        target[r.source] = r.target
    assert all(len(c) == 1 for c in copies.values())
    nulls = [r.copies for r in got if r.doc_id is None]
    assert 0 < sum(nulls) < 2 * len(nulls) and len(set(nulls)) > 1
    assert all(abs(words_of[s] - target[s]) <= 120 for s in target), [(s, words_of[s], target[s]) for s in target]


def test_sources_are_numbered_by_code_point(spark):
    names = [None, "", "a", "B", "é", "z", "\U00010000", "\uffee", *(f"h{i}" for i in range(300))]
    frame = spark.createDataFrame([(n,) for n in names], "source string")
    got = {r.source: r.place for r in mixing.numbered(frame).collect()}
    ordered = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n])
    assert got == {n: k for k, n in enumerate([*ordered, None])}


def test_rates_meet_their_targets(spark, documents):
    texts = [" ".join(["w"] * (i % 50 + 1)) for i in range(300)]
    got = mixing.mixed(documents(texts)).collect()
    words = {}
    for r in got:
        words.setdefault(r.source, [0.0, r.target])[0] += r.rate * r["size"]
    assert all(abs(a - b) <= 2e-4 * b + 1 for a, b in words.values())


def test_every_notice_votes(spark, documents):
    notices = [f"{x.text}. Some more words stand here." for x in licenses.TEMPLATES]
    texts = ["\n".join(notices), *notices, *["under the terms of the general public version 2 for any purpose"] * 5]
    got = {r.doc_id: r.labels for r in licenses.digest(documents(texts)).collect()}
    assert set(got[0].split(",")) == {x.label for x in licenses.TEMPLATES}
    assert all(x.label in got[n + 1].split(",") for n, x in enumerate(licenses.TEMPLATES))


def test_a_mandatory_phrase_alone_is_found(spark, documents):
    for x in licenses.TEMPLATES:
        frequencies = dict.fromkeys(x.mandatory.split(), 3)
        index = {w for w, _ in licenses.index_of(frequencies)}
        assert len(index & set(x.mandatory.split())) >= 2 and index <= frequencies.keys()
    got = licenses.digest(documents(["x redistribution and use in source and binary forms y", "no notice"])).collect()
    assert {r.doc_id: r.labels for r in got} == {0: "bsd", 1: ""}
