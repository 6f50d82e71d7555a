"""Phrase mining against brute force, in exact integers."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.llm import phrases

DOCS = "doc_id long, text string, lang string"


def brute(rows, most_words, least, keep, covering=80):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for n in range(1, most_words + 1):
                for i in range(len(w) - n + 1):
                    counts[lang, tuple(w[i : i + n])] += 1
    out = []
    for lang in totals:
        mine = {p: c for (x, p), c in counts.items() if x == lang and c >= least}
        found = []
        for p, a in mine.items():
            if len(p) < 2:
                continue
            if any(len(q) > len(p) and 100 * c >= covering * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in mine.items()):
                continue
            score, k = min((2_000_000 * a // (mine[p[:k]] + mine[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), mine[p[:k]], mine[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:keep], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = ["the", "The", "of", "é", "É", "a", "b", "new", "york", "city", "in", "x-y", "\xa0", "日本", "new york city in", "the b."]
    sep = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "\x0b", " ! "]
    return ["".join(rnd.choice(vocab) + rnd.choice(sep) for _ in range(rnd.choice([0, 1, 5, 60]))) for _ in range(n)]


@pytest.mark.parametrize("most_words, least, keep, slice_bytes, held", [(4, 3, 50, 1 << 20, 1 << 20), (4, 2, 1000, 7, 40), (3, 1, 1000, 30, 9), (2, 2, 5, 64, 100)])
def test_mined(spark, monkeypatch, most_words, least, keep, slice_bytes, held):
    monkeypatch.setattr(phrases, "SLICE", slice_bytes)
    monkeypatch.setattr(phrases, "HELD_KEYS", held)
    rows = [(t, random.Random(i).choice(["en", "de", None, "und"])) for i, t in enumerate(texts(most_words, 60))]
    rows += [(None, "en"), ("", None), (" ", "fr"), *rows[:7], ("new york city " * 400, "en"), ("z" * 5_000, "en")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).withColumn("phrase", F.lit("p")).withColumn("n", F.lit(1)).withColumn("key", F.lit(1))
    got = sorted(tuple(r) for r in phrases.mined(docs, most_words=most_words, least=least, keep=keep).collect())
    assert got == brute(rows, most_words, least, keep)


def test_empty_tables_and_no_phrases(spark):
    assert phrases.mined(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.mined(spark.createDataFrame([(1, None, None), (2, "one two", "en")], DOCS)).count() == 0
    with pytest.raises(ValueError):
        phrases.mined(spark.createDataFrame([], DOCS), most_words=1)


def test_scores_are_exact_beyond_64_bits(spark):
    huge = 4_000_000_000_000_000_003
    rows = [("en", 1, "a", huge), ("en", 1, "b", huge), ("en", 2, "a b", huge - 1), ("en", 1, "c", 7), ("en", 2, "b c", 7), ("en", 3, "a b c", 7)]
    got = {r.phrase: r for r in phrases.scored(spark.createDataFrame(rows, "lang string, n_words int, phrase string, f long")).collect()}
    assert got["a b"].score == 2_000_000 * (huge - 1) // (2 * huge) and got["b c"].score == 2_000_000 * 7 // (huge + 7)
    assert (got["a b c"].score, got["a b c"].l) == (0, huge)  # both cuts give 0: the first is taken


def test_filter_holds_every_key():
    import numpy as np

    keys = np.random.default_rng(0).integers(0, 1 << 64, 5_000, dtype=np.uint64)
    packed = np.zeros(1 << 13, dtype=np.uint8)
    for shift in (0, 32):
        at = (keys >> np.uint64(shift)) & np.uint64((1 << 16) - 1)
        np.bitwise_or.at(packed, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
    assert phrases.Filter(16, packed).has(keys).all()


def test_a_bitmap_reaches_the_driver_packed(spark, monkeypatch):
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    from loomtext.llm.common import bitmap

    brought = []
    for name in ("collect", "toPandas"):
        taken = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, taken=taken: brought.append(len(found := taken(self))) or found)
    for bits, n in ((22, 300_000), (10, 50), (6, 3)):
        at = np.unique(np.random.default_rng(bits).integers(0, 1 << bits, n))
        rows = spark.createDataFrame([(int(b),) for b in at], "b long")
        brought.clear()
        found = bitmap(rows.unionByName(rows), "b", bits)
        assert np.flatnonzero(np.unpackbits(found, bitorder="little")).tolist() == at.tolist() and len(found) == 1 << (bits - 3)
        assert sum(brought) <= max(1, (1 << bits) >> 16)  # one row of bytes for 65,536 bits, not one for 64
    assert not bitmap(rows.limit(0), "b", 8).any()
