"""Language identification of whole texts, with the spans of mixed ones.

The model holds, for each language, how likely the character trigrams and 4-grams of its words are (hashed into
a fixed number of buckets), and in which scripts its letters stand. To label a text, each word (a run of
letters) gets a score in every language whose scripts cover it; a Viterbi pass over the words, with a penalty
for each switch, gives the most likely sequence of languages, whose runs are the spans. The text's language is
the one with most letters in its spans, and its score the share of letters it has.

Null texts and texts without a letter are `und` with score 0 and no spans. With no rows to learn from, every text
with a letter is `und` too. Ties go to the language that sorts first. Rows that repeat get equal results. An empty table
gives an empty result. A very long text is scored whole, at about 100 bytes a character with four languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import blocks, released, remainder, small_batches, unused

#: Unicode ranges of scripts, by block (fixed values).
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("indic", ((0x980, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
)
BUCKETS = 1 << 17
#: Cost of a switch, in nats; smoothing of a bucket; texts, and characters, of each language that the model learns from (about).
SWITCH, SMOOTH, ROWS_PER_LANGUAGE, CHARS_PER_LANGUAGE = 12.0, 0.05, 1_000, 16_000_000


#: Of state numbers: languages aren't limited in number.
STATE = np.int32
#: Characters of a block times languages that a task scores at once, so that its memory doesn't grow with the languages.
SCORED = 4_000_000


class Model(NamedTuple):
    languages: list[str]
    likely: np.ndarray  # bucket x language, log likelihoods
    scripts: np.ndarray  # script x language, whether the language is written in it


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its script (0: no letter; the last number: a script not listed) and its lower case."""
    script = np.zeros(0x110000, dtype=np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    other = len(SCRIPTS) + 1
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            script[code] = other
            low = char.lower()
            if len(low) == 1:
                lower[code] = ord(low)
    for n, (_, ranges) in enumerate(SCRIPTS, 1):
        for first, last in ranges:
            part = script[first : last + 1]
            part[part > 0] = n
    return script, lower


class Words(NamedTuple):
    doc: np.ndarray  # of each word: its text's number,
    start: np.ndarray  # its first character in that text,
    size: np.ndarray  # its letters,
    script: np.ndarray  # and the script of its first letter
    gram_at: np.ndarray  # where its n-grams begin in grams
    grams: np.ndarray  # buckets


def words_of(texts: list[str]) -> Words:
    """The words of a block of texts and their n-grams; a gram ends at a letter or at the end of its word."""
    script_of, lower_of = letter_tables()
    codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    script = script_of[codes]
    letter = script > 0
    c = np.where(letter, lower_of[codes], 0).astype(np.uint64)
    before = np.zeros_like(letter)
    before[1:] = letter[:-1]
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(~letter & before)
    c1 = np.concatenate(([0], c[:-1])).astype(np.uint64)
    c2 = np.where(c1 == 0, 0, np.concatenate(([0, 0], c[:-2]))).astype(np.uint64)
    c3 = np.where(c2 == 0, 0, np.concatenate(([0, 0, 0], c[:-3]))).astype(np.uint64)
    here = np.flatnonzero(letter | before)
    c, c1, c2, c3 = c[here], c1[here], c2[here], c3[here]
    mix = np.uint64(0x9E3779B97F4A7C15)
    three = ((c2 << np.uint64(42)) ^ (c1 << np.uint64(21)) ^ c) * mix
    four = (three ^ (c3 + np.uint64(1))) * mix
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    grams = np.stack([three >> shift, four >> shift], axis=1).astype(np.int32)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(doc, starts - offsets[doc], ends - starts, script[starts], np.searchsorted(here, starts), grams)


def learned(texts: list[str], labels: list[str]) -> Model:
    """The model of labelled texts."""
    languages = sorted(set(labels))
    number = {x: n for n, x in enumerate(languages)}
    likely = np.empty((BUCKETS, len(languages)), dtype=np.float32)
    letters = np.zeros((len(SCRIPTS) + 2, len(languages)))
    own: dict[str, list[str]] = {}
    for t, x in zip(texts, labels):
        own.setdefault(x, []).append(t)
    for label in languages:
        counts = np.zeros(BUCKETS)
        for block in blocks(own[label]):
            words = words_of(block)
            counts += np.bincount(words.grams.ravel(), minlength=BUCKETS)
            letters[:, number[label]] += np.bincount(words.script, weights=words.size, minlength=len(SCRIPTS) + 2)
        likely[:, number[label]] = np.log((counts + SMOOTH) / (counts.sum() + SMOOTH * BUCKETS))
    return Model(languages, likely, letters > 0.02 * letters.sum(axis=0))


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """The best state of each word, for sequences that lie one after another in `scores` (words x states).

    A sequence that no run of words could pull away from its best single state, as the largest sum of gains over
    any run shows, has that state throughout. The others advance together, word by word.
    """
    n_words, n_states = scores.shape
    of = np.repeat(np.arange(len(sizes)), sizes)
    total = np.add.reduceat(scores, starts, axis=0) if len(starts) else np.zeros((0, n_states))
    state = total.argmax(axis=1)[of].astype(STATE)
    gain = scores.max(axis=1).astype(np.float64) - scores[np.arange(n_words), state]
    gain -= np.where(gain > 0, 0, 1e-9)
    loss = scores[np.arange(n_words), state] - np.where(np.arange(n_states) == state[:, None], -np.inf, scores).max(axis=1)
    run = np.cumsum(np.where(gain > 0, gain, -np.maximum(loss, 0)))
    fall = np.concatenate(([0.0], run[:-1])) - of * 1e7
    peak = np.maximum.reduceat(run - of * 1e7 - np.minimum.accumulate(fall), starts) if len(starts) else np.zeros(0)
    open_ = np.flatnonzero(peak > switch)
    if not len(open_):
        return state
    open_ = open_[np.argsort(-sizes[open_], kind="stable")]
    first, length = starts[open_], sizes[open_]
    back = np.zeros((n_words, n_states), dtype=STATE)
    best = scores[first].astype(np.float64)
    states = np.arange(n_states, dtype=STATE)
    live = len(open_)
    for t in range(1, length[0]):
        while length[live - 1] <= t:
            live -= 1
        v = best[:live]
        top = v.argmax(axis=1)
        moved = v[np.arange(live), top] - switch
        stay = v >= moved[:, None]
        at = first[:live] + t
        back[at] = np.where(stay, states, top[:, None])
        best[:live] = np.where(stay, v, moved[:, None]) + scores[at]
    now = best.argmax(axis=1)
    for t in range(length[0] - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, side="left"))
        at = first[:live] + t
        state[at] = now[:live]
        now[:live] = back[at, now[:live]]
    return state


def label_block(texts: list[str | None], model: Model) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text."""
    words = words_of([t or "" for t in texts])
    found: list[tuple[str, float, list[dict]]] = [("und", 0.0, [])] * len(texts)
    if not len(words.doc) or not model.languages:
        return found
    gathered = np.add.reduceat(model.likely[words.grams[:, 0]] + model.likely[words.grams[:, 1]], words.gram_at, axis=0)
    allowed = model.scripts[words.script]
    allowed = allowed | ~allowed.any(axis=1)[:, None]
    scores = np.where(allowed, gathered, -1e4).astype(np.float64)
    scores -= scores.max(axis=1)[:, None]
    docs, starts, sizes = np.unique(words.doc, return_index=True, return_counts=True)
    state = viterbi(scores, starts, sizes, SWITCH)
    k = len(model.languages)
    slot = np.repeat(np.arange(len(docs)), sizes)
    letters = np.bincount(slot * k + state, weights=words.size, minlength=len(docs) * k).reshape(-1, k)
    top = letters.argmax(axis=1)
    share = letters[np.arange(len(docs)), top] / letters.sum(axis=1)
    new = np.ones(len(state), dtype=bool)
    new[1:] = (state[1:] != state[:-1]) | (slot[1:] != slot[:-1])
    runs = np.flatnonzero(new)
    last = np.append(runs[1:], len(state)) - 1
    spans: dict[int, list[dict]] = {}
    for a, b in zip(runs.tolist(), last.tolist()):
        spans.setdefault(int(words.doc[a]), []).append({"lang": model.languages[state[a]], "start": int(words.start[a]), "end": int(words.start[b] + words.size[b])})
    for n, d in enumerate(docs.tolist()):
        found[d] = (model.languages[top[n]], float(share[n]), spans[d])
    return found


def sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE, text: str = "text", lang: str = "lang") -> DataFrame:
    """(text, lang): about `rows` distinct texts of each language (all, if fewer), of about `chars` characters, chosen by a hash
    of the text; ids have no part in it, so null or equal ids don't matter, and copies count once."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    hashed = F.xxhash64("text", F.lit("langid"))
    texts = known.select("lang", hashed.alias("mark"), F.length("text").cast("long").alias("size")).distinct()
    counted = texts.groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    shares = counted.select("lang", F.least(F.lit(1.0), rows / F.col("n"), chars / F.greatest(F.col("size"), F.lit(1))).alias("share"))
    dice = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    # broadcast: a row a language, which is nothing beside the model's 0.5 MB a language; texts aren't dealt by language
    return known.join(F.broadcast(shares), "lang").where(dice < F.col("share")).select("text", "lang").distinct()


def trained(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, text: str = "text", lang: str = "lang") -> Model:
    """A model of a sample: about `rows` texts of each language, whatever their number. It takes 0.5 MB a language."""
    found = sample(docs, rows, text=text, lang=lang).toPandas().sort_values(["lang", "text"])
    return learned(found["text"].tolist(), found["lang"].tolist())


def identified(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """`docs` with a struct column: lang, score and spans (lang, start, end in characters) of the whole text."""
    held = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    most = SCORED // max(4, len(model.languages))
    kind = "lang string, score double, spans array<struct<lang: string, start: int, end: int>>"

    @F.pandas_udf(kind)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [r for block in blocks(texts, most) for r in label_block(block, held.value)]
            yield pd.DataFrame(rows, columns=["lang", "score", "spans"])
        released()

    # so that a filter on the labels and their use are one evaluation
    return docs.withColumn(into, label.asNondeterministic()(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    return remainder(doc_id, 4) == 2


def digest(docs: DataFrame) -> DataFrame:
    """What query op10 returns."""
    docs = docs.select("doc_id", "text", "lang")
    model = trained(docs.where(~held_out()))
    found = identified(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.size("language.spans").cast("long").alias("n_spans")
    )


def labelled(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """`docs` with the predicted language as `lang`, without those whose language can't be told (null texts, texts
    without a letter). Columns stay."""
    model = trained(docs.where(~held_out()))
    into = unused(docs, "language")[0]
    found = identified(docs, model, into=into).where(F.col(into)["lang"] != "und")
    return found.withColumn(lang, F.col(into)["lang"]).select(docs.columns)
