"""Byte-level BPE by prefix-sharing trie traversal.

In a batch of texts the distinct words (the pre-tokenizer's pieces) form a trie. It is walked depth-first in
sorted order, holding only the path from the root to the present word: each node's state is the last token of
its prefix's encoding and where that token starts. A prefix that words share is encoded once, and the encoding
of a word is read off its path backwards. The last token of a prefix is the one suffix whose token can follow
the last token of the rest: two tokens can stand side by side if merging their joined bytes gives them back. The tokens
that end a prefix are read off an automaton of all tokens, a step a byte; whether two can stand side by side is told by
undoing their merges, the latest first, down to their touching bytes: no merge across the border may come before one undone.

Nulls count as empty texts. Whole texts of any length are encoded; the state of a word is two integers a byte. Rows
that repeat get equal ids, null ids of documents stay, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import small_batches, tidy

#: The byte-level pre-tokenizer's pattern (a fixed value of the format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin-1 characters alone, with the classes written out, for the standard library's faster engine.
_LETTER, _DIGIT, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PIECES = rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Distinct words whose encodings a task holds, in each of two generations, and pairs of tokens (steps of the automaton) whose verdict it holds.
HELD_WORDS, HELD_PAIRS = 150_000, 300_000
#: Bytes of text that are encoded at a time.
SLICE = 1 << 20


def byte_letters() -> dict[str, int]:
    """The format's printable letter of each byte: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encodes and decodes with the vocabulary and merges of a tokenizers file."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        merges = [m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.ids = {raw(t): i for t, i in parsed["model"]["vocab"].items() if t not in self.special}
        self.ranks = {(raw(a), raw(b)): n for n, (a, b) in enumerate(merges)}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.learn_parts()
        self.grow_automaton()
        assert array("I").itemsize == 4 and sys.byteorder == "little"
        self.find_any, self.find_latin = regex.compile(PIECES).findall, re.compile(LATIN_PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.special_ids = {t: array("I", [i]).tobytes() for t, i in self.special.items()}
        self.adjacent: dict[int, bool] = {}
        self.moves: dict[int, int] = {}
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn_parts(self) -> None:
        """Of each token the merge that makes it (-1: none) and its two parts; `ordered` if there is one merge a token, behind those of its parts."""
        find = self.ids.get
        n = max(self.ids.values(), default=-1) + 1
        self.rank_of, self.head_of, self.tail_of = array("i", [-1]) * n, array("i", range(n)), array("i", range(n))
        self.pair_ranks: dict[int, int] = {}
        self.ordered = len({a + b for a, b in self.ranks}) == len(self.ranks)
        for (a, b), rank in self.ranks.items():
            head, tail, token = find(a), find(b), find(a + b)
            if head is None or tail is None or token is None:
                self.ordered = False
                continue
            self.ordered &= max(self.rank_of[head], self.rank_of[tail]) < rank and all(len(x) == 1 or self.rank_of[find(x)] >= 0 for x in (a, b))
            self.rank_of[token], self.head_of[token], self.tail_of[token] = rank, head, tail
            self.pair_ranks[head << 20 | tail] = rank

    def grow_automaton(self) -> None:
        """States are the beginnings of tokens. `endings`: the tokens that end a state's bytes, with their lengths, longest first."""
        self.steps: dict[int, int] = {}
        own, edges = [()], []
        for raw, token in self.ids.items():
            state = 0
            for depth, byte in enumerate(raw):
                key = state << 8 | byte
                state = self.steps.get(key, 0)
                if not state:
                    state = self.steps[key] = len(own)
                    own.append(())
                    edges.append((depth, key))
            own[state] = ((token, len(raw)),)
        self.shorter, self.endings = array("i", [0]) * len(own), own
        for depth, key in sorted(edges):
            state = self.steps[key]
            back = self.shorter[state] = self.move(self.shorter[key >> 8], key & 255) if depth else 0
            self.endings[state] = own[state] + self.endings[back] if own[state] else self.endings[back]

    def move(self, state: int, byte: int) -> int:
        """The longest beginning of a token that ends the state's bytes and this one."""
        while True:
            found = self.steps.get(state << 8 | byte)
            if found is not None or not state:
                return found or 0
            state = self.shorter[state]

    def forget(self) -> None:
        """Drop the words and pairs of the last task: the worker that holds them lives on."""
        self.held, self.older, self.adjacent, self.moves = {}, {}, {}, {}

    def merged(self, raw: bytes) -> list[bytes]:
        """Plain merging, lowest rank first: the definition that the traversal must agree with."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def can_follow(self, left: int, right: int) -> bool:
        """Whether token `right` can come after token `left`; at a word's start `left` is -1."""
        key = (left + 1) << 20 | right
        found = self.adjacent.get(key)
        if found is None:
            if len(self.adjacent) > HELD_PAIRS:
                self.adjacent.clear()
            if self.ordered and left >= 0:
                found = self.can_follow(-1, left) and self.can_follow(-1, right) and not self.crossed(left, right)
            else:
                a, b = self.bytes_of.get(left, b""), self.bytes_of[right]
                found = self.merged(a + b) == ([a, b] if a else [b])
            self.adjacent[key] = found
        return found

    def crossed(self, left: int, right: int) -> bool:
        """Whether a merge across the border of two tokens comes before one of theirs. Of equal merges the left one comes first."""
        rank_of, ranks, before = self.rank_of, self.pair_ranks.get, len(self.ranks)
        while True:
            if ranks(left << 20 | right, before) < before:
                return True
            if rank_of[left] > rank_of[right]:
                before, left = rank_of[left], self.tail_of[left]
            elif rank_of[right] >= 0:
                before, right = rank_of[right] + 1, self.head_of[right]
            else:
                return False

    def learn(self, words: list[str]) -> None:
        """Encode distinct words: a depth-first walk over the trie of their bytes."""
        if len(self.moves) > HELD_PAIRS:
            self.moves.clear()
        steps, moves, endings, adjacent = self.steps.get, self.moves.get, self.endings, self.adjacent.get
        path, starts, tokens, states = b"", [0], [-1], [0]  # state of each prefix of the present path: index = its length
        for raw, word in sorted([(w.encode(), w) for w in words]):
            shared, most = 0, min(len(raw), len(path))
            while shared < most and raw[shared] == path[shared]:
                shared += 1
            del starts[shared + 1 :], tokens[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for end in range(shared + 1, len(raw) + 1):
                key = state << 8 | raw[end - 1]
                state = steps(key) or moves(key)
                if state is None:
                    state = self.moves[key] = self.move(key >> 8, key & 255)
                states.append(state)
                for token, size in endings[state]:
                    left = tokens[end - size]
                    fits = adjacent((left + 1) << 20 | token)
                    if fits or fits is None and self.can_follow(left, token):
                        starts.append(end - size)
                        tokens.append(token)
                        break
            path, out, end = raw, [], len(raw)
            while end:
                out.append(tokens[end])
                end = starts[end]
            out.reverse()
            self.held[word] = array("I", out).tobytes()

    def find(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_latin(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = []
        for text in texts:
            if self.special and any(s in text for s in self.special):
                pieces.append([p for part in self.cut(text) for p in ([part] if part in self.special else self.find(part))])
            else:
                pieces.append(self.find(text))
        distinct = set().union(*pieces)
        if len(self.held) > HELD_WORDS:
            self.older, self.held = self.held, {}
        fresh = []
        for word in distinct - self.held.keys():
            ids = self.older.get(word) or self.special_ids.get(word)
            if ids is None:
                fresh.append(word)
            else:
                self.held[word] = ids
        self.learn(fresh)
        get = self.held.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, TrieBpe] = {}


def _tokenizer(spec: str) -> TrieBpe:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = TrieBpe(spec)
    return _LOADED[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _with(docs: DataFrame, path: str, source: str, added: dict[str, str], work) -> DataFrame:
    """`docs` with the columns `added` (name: type), which `work` makes of the tokenizer and some values of `source`.

    Batches are taken a slice of about a million bytes at a time, so a batch of long texts isn't held several times over.
    The vocabulary file is read once, by the driver, and sent to the tasks (its size does not grow with the data).
    """
    spec = small_batches(docs).sparkSession.sparkContext.broadcast(read_spec(path))
    kept = [c for c in docs.columns if c not in added]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema), *(f"`{c}` {kind}" for c, kind in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(source)), 0).to_numpy(zero_copy_only=False)
            run_of = np.cumsum(sizes, dtype=np.int64) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                made = work(bpe, part.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], [*kept, *added])
        bpe.forget()

    return docs.mapInArrow(tidy(run), schema)


def _encode(bpe: TrieBpe, texts: list[str | None]) -> list[bytes]:
    return bpe.encode([t or "" for t in texts])


def encoded(docs: DataFrame, path: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """`docs` with a binary column: the ids of the whole text as little-endian unsigned 32-bit integers."""
    return _with(docs, path, text, {into: "binary"}, lambda bpe, texts: [pa.array(_encode(bpe, texts), pa.binary())])


def decoded(docs: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """`docs` with the text that the ids of the binary column stand for; no ids, no characters."""
    return _with(docs, path, ids, {into: "string"}, lambda bpe, found: [pa.array([bpe.decode(x or b"") for x in found], pa.string())])


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """`docs` with both columns, `encoded` and `decoded` in one go."""

    def both(bpe: TrieBpe, texts: list[str | None]) -> list[pa.Array]:
        found = _encode(bpe, texts)
        return [pa.array(found, pa.binary()), pa.array([bpe.decode(x) for x in found], pa.string())]

    return _with(docs, path, text, {ids: "binary", into: "string"}, both)


def digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What query op1 returns; hashes are taken by the JVM."""
    found = round_trip(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path)
    return found.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
