import hashlib
import random

import numpy as np
import pytest

from loomtext.llm import bpe
from loomtext.llm.queries import tokenizer_path

PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", "😀", "'s", "'ll", "1", "23", "<|endoftext|>", "\u2028", "\x00", "ing", "the", "ﬀ", "_", "--", "İ", "aaaaaa", "<|endof", "\x1c", "\x85", "\xa0", "\xb2", "\xbd", "\xaa", "\xd7", "\xf7", "'re", "'ve", "'m", "'d"]
LATIN = [p for p in PIECES if all(ord(c) < 256 for c in p)]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_traversal_is_the_librarys_encoding(reference):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rnd.choice(LATIN) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["x" * 3000, " " * 700, ""]
    own = bpe.TrieBpe(bpe.read_spec(tokenizer_path()))
    for held in (10, 1_000_000):
        bpe.HELD_WORDS, before = held, bpe.HELD_WORDS
        got = [x for k in range(0, len(texts), 500) for x in own.encode(texts[k : k + 500])]
        bpe.HELD_WORDS = before
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in got] == [reference.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in got]


def test_digest(spark, documents, reference):
    texts = [None, "", "Hello world", "Hello world", "é\n\n\tx" * 2000]
    docs = documents(texts)
    got = {r.doc_id: r for r in bpe.digest(docs, tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        ids = np.array(reference.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    again = bpe.decoded(bpe.encoded(docs.withColumn("decoded", docs.lang), tokenizer_path()), tokenizer_path())
    assert [r.decoded for r in again.orderBy("doc_id").collect()] == [t or "" for t in texts]
    assert bpe.digest(documents([]), tokenizer_path()).count() == 0


def test_pairs_are_told_by_their_merges(monkeypatch):
    rnd = random.Random(3)
    own = bpe.TrieBpe(bpe.read_spec(tokenizer_path()))
    assert own.ordered
    merged, calls, ids = own.merged, [], [t for raw, t in own.ids.items() if len(raw) < 9]
    monkeypatch.setattr(own, "merged", lambda raw: calls.append(raw) or merged(raw))
    words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    own.encode(words)
    assert len(calls) == len(set(calls)) and set(calls) <= own.ids.keys()  # tokens alone; no pair is merged anew
    for left, right in [*((rnd.choice(ids), rnd.choice(ids)) for _ in range(3000)), *(((k >> 20) - 1, k & 0xFFFFF) for k in list(own.adjacent) if k >> 20)]:
        a, b = own.bytes_of[left], own.bytes_of[right]
        assert own.can_follow(left, right) == (merged(a + b) == [a, b])
