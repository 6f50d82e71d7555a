import json
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import align, follow
from loomtext.streaming import tail

POLL = "watch long, seq long, path string, typed long, size long, at long, data binary"
EVENT = "watch long, seq long, text string, title string, playing boolean"


def streamed(spark, tmp_path, make, frame, parts, by="seq"):
    """The rows that a stream gives when its input comes in several batches, the query stopped and started between them."""
    last = max(r[by] for r in frame.select(by).collect())
    got = []
    for k in range(parts):
        low, high = (last + 1) * k // parts, (last + 1) * (k + 1) // parts
        frame.where((F.col(by) >= low) & (F.col(by) < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
    return got


def line(rng, n):
    if rng.random() < 0.1:
        return b"{broken \xff\n"
    text = rng.choice(["", " ", f"text {n} – ü", f"more {n}"])
    content = rng.choice([text, [{"type": "text", "text": text}, {"type": "tool_use", "text": "x"}]])
    uuid = rng.choice([f"u{n}", f"u{n // 3}", "", None])
    return json.dumps({"type": rng.choice(["assistant", "assistant", "user"]), "uuid": uuid, "message": {"content": content}}, ensure_ascii=False).encode() + b"\n"


def files(seed):
    """Polls of two files of each watch: they grow, stop within a line, are cut and replaced."""
    rng, rows = random.Random(seed), []
    for w in range(8):
        content, read = [b"", b""], [0, 0]
        for seq in range(12):
            for f in range(2):
                if rng.random() < 0.15:
                    content[f] = b"".join(line(rng, rng.randrange(90)) for _ in range(rng.randrange(3)))
                content[f] += b"".join(line(rng, seq * 9 + k) for k in range(rng.randrange(4)))
                if rng.random() < 0.4:
                    content[f] = content[f][: max(content[f].rfind(b"\n") + 1, len(content[f]) - rng.randrange(30))] + line(rng, 80)[: rng.randrange(1, 30)].replace(b"\n", b"")
                elif content[f] and not content[f].endswith(b"\n"):
                    content[f] += b'"\n'
                at = 0 if len(content[f]) < read[f] or rng.random() < 0.5 else read[f]
                at = content[f].rfind(b"\n", 0, at) + 1 if at else 0
                rows.append((w, seq, f"f{f}", rng.choice([None, 1, 2]) if seq % 5 == 0 else f if w % 2 else 1, len(content[f]), at, bytearray(content[f][at:])))
                read[f] = content[f].rfind(b"\n") + 1
    return rows


def looked(rows, pinned, from_start):
    """`followed`, one poll after another."""
    out, state = [], {}
    looks = {}
    for r in rows:
        looks.setdefault((r[0], r[1]), []).append(r)
    for (w, seq), all_ in sorted(looks.items()):
        there = [r for r in all_ if r[2] == pinned] or sorted(all_, key=lambda r: (r[3] is None, -(r[3] or 0), r[2]))
        _, _, path, _, size, at, data = there[0]
        end = at + bytes(data).rfind(b"\n") + 1
        if w not in state or state[w][0] != path:
            start = 0 if from_start and w not in state else end
            heard = set()
        else:
            start, heard = state[w][1:]
            start = 0 if size < start else start
        n = 0
        for k in bytes(data)[max(0, start - at) : end - at].splitlines() if end > start or start == 0 else []:
            n += 1
            try:
                turn = json.loads(k.decode("utf-8", "replace"))
            except ValueError:
                continue
            if turn["type"] != "assistant" or (turn["uuid"] and turn["uuid"] in heard):
                continue
            heard.add(turn["uuid"])
            said = turn["message"]["content"]
            said = said if isinstance(said, str) else said[0]["text"]
            if said.strip():
                out.append((w, path, seq, n - 1, turn["uuid"], said))
        state[w] = (path, end, heard)
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,pinned,from_start", [(1, None, False), (2, None, True), (3, "f1", False)])
def test_followed_is_one_poll_after_another(spark, tmp_path, seed, pinned, from_start):
    rows = files(seed)
    frame = spark.createDataFrame(rows, POLL)
    want = looked(rows, pinned, from_start)
    batch = tail.followed(frame, None if pinned is None else F.lit(pinned), from_start).collect()
    assert sorted((tuple(r) for r in batch), key=str) == want and len(want) > 10
    got = streamed(spark, tmp_path, lambda s: tail.followed_stream(s, pinned, from_start), frame, 3)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_followed_cases(spark):
    turn = lambda u, t: json.dumps({"type": "assistant", "uuid": u, "message": {"content": t}}).encode() + b"\n"
    a, b, c = turn("a", "one"), turn("b", "two"), turn("c", "three")
    rows = [
        (1, 0, "f", 1, len(a), 0, a), (1, 1, "f", 1, len(a + b) - 5, 0, (a + b)[:-5]), (1, 2, "f", 1, len(a + b), len(a), b), (1, 3, "f", 1, len(c), 0, c),
        (1, 4, "f", 1, len(c), 0, None), (2, 0, "g", None, 0, 0, b""), (2, 1, "g", None, len(a), 0, a),
    ]
    got = tail.followed(spark.createDataFrame([(*r[:6], None if r[6] is None else bytearray(r[6])) for r in rows], POLL)).collect()
    assert sorted((r.watch, r.seq, r.text) for r in got) == [(1, 2, "two"), (1, 3, "three"), (2, 1, "one")]
    assert tail.followed(spark.createDataFrame([], POLL)).count() == 0


def test_flushed_stream_is_its_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(w, s, rng.choice([None, f"t{s}"]), rng.choice([None, "", f"T{s}"]), rng.choice([None, None, True, False])) for w in range(5) for s in range(40)]
    frame = spark.createDataFrame(rows, EVENT)
    want, held, title, on = [], {}, {}, {}
    for w, s, text, name, playing in sorted(rows, key=lambda r: r[:2]):
        on[w] = on.get(w, False) if playing is None else playing
        title[w] = name or title.get(w)
        held.setdefault(w, []).extend([text] if text is not None else [])
        if held[w] and not on[w]:
            want.append((w, s, "\n\n".join(held.pop(w)), title[w] or "Window"))
    assert sorted(tuple(r) for r in tail.flushed(frame).collect()) == want
    got = streamed(spark, tmp_path, tail.flushed_stream, frame, 3)
    assert sorted(tuple(r) for r in got) == want


def test_words_for_follows_rewritten_sentences():
    shown = "It rose by 125% , see https://example.com/a now . The cat sat . The dog ran off".split()
    said = ["It rose by 125 percent, see link to example.com now.", "The dog ran off", "Nothing of this is there", "", "the cat"]
    got = align.found(shown, said)
    assert [shown[k] for k in got[0]] == ["It", "rose", "by", "125%", "see", "https://example.com/a", "now"]
    # of two beginnings that pass all words the first counts, and what it steps over is covered
    assert [shown[k] for k in got[1]] == ["The", "cat", "sat", "The", "dog", "ran", "off"] and got[2:4] == [[], []] and [shown[k] for k in got[4]] == ["The", "cat"]
    assert align.found([], ["a"]) == [[]] and align.found(["--", None], ["a"]) == [[]] and align.found(["a"], [None]) == [[]]
    many = ["the"] * 100_000 + ["end"]
    assert len(align.found(many, ["the end"] * 50)) == 50


def test_words_for_is_a_plain_walk(spark):
    """Against a walk written out step by step, over random words of a small alphabet."""
    rng = random.Random(3)

    def plain(shown, said):
        lead = next((w for w in said[:3] if w in shown), None)
        best, most = [], 0
        for start in [k for k, w in enumerate(shown) if w == lead][:40]:
            run, i, j, bad = [], start, 0, 0
            while i < len(shown) and j < len(said) and bad <= 3:
                if shown[i] == said[j]:
                    run, i, j, bad = run + [i], i + 1, j + 1, 0
                elif shown[i] in said[j + 1 : j + 4]:
                    run, j, i, bad = run + [i], said.index(shown[i], j + 1) + 1, i + 1, 0
                elif said[j] in shown[i + 1 : i + 4]:
                    to = shown.index(said[j], i + 1)
                    run, i, bad = run + list(range(i, to)), to, 0
                else:
                    bad += 1
                    if bad <= 3:
                        run, i, j = run + [i], i + 1, j + 1
            if j > most:
                best, most = run, j
        return best if most >= max(1, len(said) // 2) else []

    rows = []
    for n in range(300):
        shown = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 60))]
        said = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 14))] for _ in range(4)]
        rows.append((n, shown, [" ".join(s) for s in said], [plain(shown, s) for s in said]))
    got = spark.createDataFrame(rows, "n int, shown array<string>, said array<string>, want array<array<int>>").withColumn("got", align.words_for(F.col("shown"), F.col("said")))
    assert got.where("got = want").count() == 300
    nulls = spark.createDataFrame([(None, ["a"]), (["a"], None)], "shown array<string>, said array<string>").select(align.words_for(F.col("shown"), F.col("said")).alias("g"))
    assert [r.g for r in nulls.collect()] == [None, None]


def test_read_on(spark):
    """A chain of 1,000 pages, a circle entered from outside, a page that leads to itself, a diamond, an untrusted link."""
    links = [(f"c{k}", f"c{k + 1}#top", False) for k in range(1000)] + [("in", "r0", False), ("r0", "r1", False), ("r1", "r2#x", False), ("r2", "r0", False), ("self", "self", False)]
    links += [("top", "left", False), ("top", "right", False), ("left", "end", False), ("right", "end", False), ("doubt", "c0", True), ("none", None, False), (None, "x", False), ("n", "c0", None)]
    starts = ["c0", "c990#y", "in", "r1", "self", "top", "right", "doubt", "none", "n", "nowhere"]
    frame = spark.createDataFrame(links, "url string, next_url string, confirm boolean")
    rows = follow.read_on(spark.createDataFrame([*enumerate(starts), (0, "c0"), (99, None), (None, "c0")], "session long, url string"), frame).orderBy("session", "step").collect()
    to = {}
    for a, b, doubt in links:
        if doubt is False and a and b:
            to[a] = min(to.get(a, "~"), b.split("#")[0])
    want = []
    for k, page in enumerate(starts):
        page, seen = page.split("#")[0], []
        while page and page not in seen:
            want.append((k, len(seen), page))
            seen.append(page)
            page = to.get(page)
    assert [tuple(r) for r in rows] == want and len(want) > 1000
    assert follow.read_on(spark.createDataFrame([], "session long, url string"), frame).count() == 0
