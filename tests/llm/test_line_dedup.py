import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.llm import line_dedup


def words(line):
    return {w for w in line.encode().lower().split()}


def brute(rows):
    lines = [(i, k, words(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if len(words(x)) >= line_dedup.LEAST_WORDS]
    gone = {i: [] for i, _ in rows}
    for a, (i, k, x) in enumerate(lines):
        if any(5 * len(x & y) >= 4 * len(x | y) for _, _, y in lines[:a]):
            gone[i].append(k)
    return gone


def made(seed, n_docs, vocabulary, lines=6):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(3, 30))] for _ in range(12)]
    texts = []
    for _ in range(n_docs):
        out = []
        for _ in range(rnd.randint(0, lines)):
            line = list(rnd.choice(base)) if rnd.random() < 0.7 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 25))]
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                line[rnd.randrange(len(line))] = rnd.choice(vocab)
            out.append("  ".join(w.upper() if rnd.random() < 0.1 else w for w in line))
        texts.append("\n".join(out))
    return texts


def test_matches_brute_force(spark, documents):
    texts = [None, "", "\n\n", "é É a b c d", *made(3, 60, 40), *made(4, 60, 4000)]
    got = {r.doc_id: r for r in line_dedup.digest(documents(texts)).collect()}
    expected = brute(list(enumerate(texts)))
    assert {i: r.removed_lines or "" for i, r in got.items()} == {i: ",".join(map(str, x)) for i, x in expected.items()}
    assert sum(map(len, expected.values())) > 50


def test_rows_that_drop_out_meet_all_others_again(spark, documents):
    texts = made(5, 40, 60)
    found = line_dedup.removed_lines(documents(texts).select("doc_id", "text"), sure=2.0, wide=3).collect()
    got = {i: [] for i in range(len(texts))}
    for r in found:
        got[r.doc_id].append(r.place >> 32)
    assert {i: sorted(x) for i, x in got.items()} == brute(list(enumerate(texts)))


def test_large_groups(spark, documents):
    rnd = random.Random(6)
    base = [f"b{k}" for k in range(30)]
    texts = []
    for _ in range(150):
        line = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 5, 6])):
            line[rnd.randrange(30)] = f"n{rnd.randrange(400)}"
        texts.append(" ".join(line))
    got = {r.doc_id: r.removed_lines or "" for r in line_dedup.digest(documents(texts)).collect()}
    assert got == {i: ",".join(map(str, x)) for i, x in brute(list(enumerate(texts))).items()}


def test_texts_columns_and_empty(spark, documents):
    line = "one two three four five six"
    docs = documents([f"{line}\nshort", f"x\n{line} \nlast", None]).withColumn("place", F.lit(1)).withColumn("removed", F.lit("clash"))
    got = {r.doc_id: r.text for r in line_dedup.deduped(docs).collect()}
    assert got == {0: f"{line}\nshort", 1: "x\nlast", 2: None}
    assert line_dedup.deduped(documents([])).count() == 0


def test_false_near_candidate_in_the_first_block(spark, documents):
    rnd = random.Random(7)
    common, shared = [f"c{k}" for k in range(60)], ["t1", "t2", "t3"]

    def corpus(x, z, y):
        lines = [x, *(shared + rnd_words for rnd_words in fill), z, y]
        used = [w for line in lines for w in line]
        ballast = [w for w in common for _ in range(2000 - used.count(w))]  # all counts, and so the order of words, stay the same
        return [" ".join(line) for line in [*lines, ballast]]

    fill = [rnd.sample(common, 15) for _ in range(700)]
    probes = [[*shared, *common[:6], w] for w in common[6:]]
    places = line_dedup.rarity(documents(corpus(*probes[:3])).select("doc_id", "text"))
    bits = {r.doc_id: r.bits for r in line_dedup.lines_of(line_dedup.marked(documents([" ".join(p) for p in probes])), places).collect()}
    alike = {}
    for i, b in bits.items():
        alike.setdefault(b, []).append(common[6 + i])
    (a, b, *_), (c, d, *_), (e, *_) = sorted(alike.values(), key=len)[::-1][:3]
    same = [*shared, *common[:5]]
    texts = corpus([*same, a, c], [*same, b, e], [*same, b, d])  # first and last: equal counts by bucket, Jaccard 8/12; the last two: 9/11
    got = {r.doc_id: r.removed_lines or "" for r in line_dedup.digest(documents(texts)).collect()}
    expected = brute(list(enumerate(texts)))
    assert expected[702] == [0] and expected[701] == []
    assert got == {i: ",".join(map(str, x)) for i, x in expected.items()}


def test_short_lines(spark, documents):
    texts = ["All rights reserved.\nHome", "home\nall  rights RESERVED.", "全著作権所有。\none two three four", "全著作権所有。\none two three four five", "two three four\nfour three two\nall rights\n \n", "rights all all"]
    got = {r.doc_id: r.removed_lines or "" for r in line_dedup.digest(documents(texts)).collect()}
    assert got == {0: "", 1: "0,1", 2: "", 3: "0,1", 4: "1", 5: "0"}
    assert got == {i: ",".join(map(str, x)) for i, x in brute(list(enumerate(texts))).items()}


def test_common_words_are_dealt_in_parts(spark, documents):
    rnd = random.Random(9)
    texts = [*made(10, 40, 60), *(" ".join(["dated", "entry", *(f"v{rnd.randrange(40)}" for _ in range(rnd.choice([4, 8, 9])))]) for _ in range(150))]
    texts.append(" ".join(f"v{k % 40}" for k in range(12000)))  # so that the other two are the rarest words of their lines
    docs = documents(texts).select("doc_id", "text")
    lines = line_dedup.lines_of(line_dedup.marked(docs), line_dedup.rarity(docs))
    classes = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "place", "n", "bits", "prefix")).alias("c")).select("c.*")
    common = line_dedup.common_words(classes, 16)
    assert common.count() >= 2
    groups = [n for n, in line_dedup.dealt(classes, common).groupBy("token").count().select("count").collect()]
    assert max(groups) <= 32 < line_dedup.entries_of(classes).groupBy("token").count().agg(F.max("count")).first()[0]
    got = {i: [] for i in range(len(texts))}
    for r in line_dedup.removed_lines(docs, part=16).collect():
        got[r.doc_id].append(r.place >> 32)
    assert {i: sorted(x) for i, x in got.items()} == brute(list(enumerate(texts)))


def test_marks_of_texts_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MARK_MASK", 0xFF)  # so that many of 120 texts have one mark at first
    texts = [f"line {k} of {k * 7} stands {k * 13} here {k % 5}" for k in range(120)]
    docs = spark.createDataFrame([(5, t) for t in texts] + [(None, t) for t in texts[:60]] + [(1, texts[3])], "doc_id long, text string")
    rows = line_dedup.marked(docs).collect()
    assert len({(r.doc_id, r.mark) for r in rows}) == len({(r.doc_id, r.text) for r in rows}) == 181
    # no line stands twice under the ids but those of null ids (which come first) and of the hot id
    got = line_dedup.deduped(spark.createDataFrame([(1, "a b c d e f"), *((5, t) for t in texts)], "doc_id long, text string")).collect()
    assert sorted(r.text for r in got if r.doc_id == 5) == sorted(texts)


def test_other_columns_stay_whatever_their_names(spark):
    names = ["_removed", "_r_id", "removed", "mark", "own", "rest", "hash", "turn", "_hash", "_t_id"]
    docs = spark.createDataFrame([(1, "a b c d e\nx y"), (None, "q r s t u")], "doc_id long, text string").select("*", *(F.lit(n).alias(n) for n in names))
    got = {r.doc_id: r for r in line_dedup.deduped(docs).collect()}
    assert all(got[None][n] == n and got[1][n] == n for n in names) and got[1].removed_lines == []


def test_entries_are_shuffled_many_to_a_row(spark, documents):
    docs = line_dedup.marked(documents(made(11, 400, 3000)))
    lines = line_dedup.lines_of(docs, line_dedup.rarity(docs))
    classes = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "place", "n", "bits", "prefix")).alias("c")).select("c.*").coalesce(2).cache()
    rows = line_dedup.entries_of(classes).collect()
    n = len(rows)
    assert line_dedup.prefix_counts(classes).sum() == n > 2000
    packed = line_dedup.packed(classes, n)
    assert packed.count() <= 2 * line_dedup.LEAST_BUCKETS < n
    found = [line_dedup.entries_in(pa.table({c: pa.array([r[c]], pa.binary()) for c in line_dedup.ENTRY})).to_pylist() for r in packed.collect()]
    found = [tuple(e[c] for c in line_dedup.ENTRY) for entries in found for e in entries]
    assert sorted(found) == sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows)
    assert len({e[0] for e in found}) == sum(len(set(t)) for t in tokens_by_bucket(packed.collect()).values())  # words are whole in a bucket
    classes.unpersist()


def tokens_by_bucket(rows):
    out = {}
    for r in rows:
        out.setdefault(r.bucket, []).extend(np.frombuffer(r.token, dtype=np.int32).tolist())
    return out


def test_a_class_does_not_meet_itself_where_its_prefix_words_share_a_token():
    assert line_dedup._ranks(np.array([5, 3, 5, 3, 5]), np.array([1 << 32, 7, 2, 7, 1])).tolist() == [3, 0, 2, 0, 1]
    rows = {"n": np.array([9, 9, 9]), "room": np.array([9, 8, 9]), "bits": np.zeros((3, 2), dtype=np.uint64)}
    found = line_dedup._candidates(rows, np.array([0, 0, 1]), np.array([0]), np.array([3]), 0.5, 512)
    assert found.count.tolist() == [0, 0, 2]
