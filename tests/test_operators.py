import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loomtext.functions import identity, pronounce, speech
from loomtext.operators import anchors, history, layout, pages


def located(spark, before, index, after, changed=False):
    old = spark.createDataFrame([(1, i, t) for i, t in enumerate(before)], "uri int, idx int, text string")
    new = spark.createDataFrame([(1, i, t) for i, t in enumerate(after)], "uri int, idx int, text string")
    at = spark.createDataFrame([(1, index)], "uri int, index int")
    r = anchors.located(anchors.created(old, at).withColumn("rules_changed", F.lit(changed)), new).first()
    return r["index"], r["how"], r["verified"]


def test_anchor_ladder(spark):
    text = ["One little cat sat.", "The quick brown fox jumped over it.", "And then it slept well.", "One little cat sat."]
    assert located(spark, text, 1, ["New.", *text]) == (2, "exact", True)
    assert located(spark, text, 1, ["New.", *text], changed=True) == (2, "exact", False)
    assert located(spark, text, 3, text) == (3, "ambiguous", False)
    assert located(spark, text, 1, ["x", "The quick brown fox jumped over it. And then it slept well.", "y"]) == (1, "boundary", False)
    assert located(spark, text, 1, ["x", "y", "A quick brown fox leapt over it."]) == (2, "fuzzy", False)
    assert located(spark, text, 1, ["x", "y"]) == (1, "hint", False)
    assert located(spark, text, 9, ["only"]) == (0, "hint", False)


def test_anchor_ladder_offsets(spark):
    text = ["One little cat sat.", "The quick brown fox jumped over it.", "And then it slept well.", "One little cat sat."]

    def find(index, after, stamp="a", now="a"):
        rows = lambda t: spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "uri int, idx int, text string")
        made = anchors.created_offsets(rows(text), spark.createDataFrame([(1, index)], "uri int, index int"))
        made = made.withColumns({"stamp": F.lit(stamp).cast("string"), "current_stamp": F.lit(now).cast("string")})
        return tuple(anchors.located_offsets(made, rows(after)).first())[1:]

    assert find(1, ["New.", *text]) == (2, "exact", True, False)
    assert find(1, ["New.", "the quick brown fox, jumped over it"], None) == (1, "exact", False, False)
    assert find(1, text, "a", "b") == (1, "exact", False, True)
    assert find(3, text) == (3, "ambiguous", False, False)
    assert find(1, ["x", "The quick brown fox jumped over it. And then it slept."]) == (1, "boundary", False, False)
    assert find(1, ["x", "y", "A quick brown fox jumps over it!"]) == (2, "fuzzy", False, False)
    assert find(3, ["x", "y"]) == (1, "hint", False, False)


def test_bigram_similarity_by_brute_force(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("aab c\nß😀𝔸X") for _ in range(n))
    rows = [(word(rnd.choice([0, 1, 2, 5, 60])), word(rnd.choice([0, 1, 3, 60]))) for _ in range(150)] + [("a" * 20_000, "a" * 15_000), ("", ""), ("a", "b")]
    done = spark.createDataFrame(rows, "a string, b string").select("a", "b", identity.bigram_similarity(F.col("a"), F.col("b")).alias("dice"))
    assert "array_position" not in done._jdf.queryExecution().optimizedPlan().toString()  # which would take the square of a text's length
    for r in done.collect():
        x, y = (Counter(zip(t, t[1:])) for t in (re.sub("[ \n]+", " ", s.lower()).strip(" ") for s in (r.a, r.b)))
        assert r.dice == (1.0 if r.a == r.b else 2 * (x & y).total() / (x.total() + y.total()) if x and y else 0.0)


def test_running_heads(spark):
    book = [(1, p, f"My Book\ntext of page {p}\nmore\nand more\nstill\n{p + 1}") for p in range(5)] + [(2, 0, "My Book\na"), (2, 1, "My Book\nb")]
    frame = spark.createDataFrame(book, "doc int, page int, text string")
    got = {(r.doc, r.page): r.text for r in pages.without_furniture(frame).collect()}
    assert got[1, 0] == "text of page 0\nmore\nand more" and got[2, 0] == "My Book\na"
    offsets = {(r.doc, r.page): r.text for r in pages.without_furniture(frame, "offsets").collect()}
    assert offsets[1, 3] == "more\nand more"


ITEMS = "page int, str string, x double, y double, width double, height double"


def read_lines(spark, items, width=None):
    frame = spark.createDataFrame([(1, t, float(x), float(y), float(w), float(h)) for t, x, y, w, h in items], ITEMS)
    return layout.lines(layout.columns(frame, width) if width else frame)


def test_layout_lines(spark):
    def texts(*items):
        return [r.text for r in read_lines(spark, items).orderBy("col", "row").collect()]

    assert texts(("world", 50, 700.5, 30, 10), ("Hello", 10, 700, 30, 10), ("next", 10, 680, 30, 10), ("  ", 90, 680, 5, 10)) == ["Hello world", "next"]
    assert texts(("third", 50, 100, 100, 10), ("first", 50, 300, 100, 10), ("second", 50, 200, 100, 10)) == ["first", "second", "third"]
    assert texts(("text", 50, 200, 20, 10), ("1", 71, 203, 4, 6)) == ["text1"]
    assert texts(("to", 50, 200, 10, 10), ("day", 60, 200, 15, 10)) == ["today"]
    assert texts(("to", 50, 200, 10, 10), ("day", 75, 200, 15, 10)) == ["to day"]
    assert read_lines(spark, [("  ", 1, 1, 1, 1)]).count() == 0


def test_layout_columns(spark):
    numbers = ("one", "two", "three", "four")
    both = [(f"{side} {n}", x, 300 - 20 * k, 150, 10) for k, n in enumerate(numbers) for side, x in (("Left", 50), ("Right", 320))]
    got = [r.text for r in read_lines(spark, both, 600.0).orderBy("col", "row").collect()]
    assert got == [f"{side} {n}" for side in ("Left", "Right") for n in numbers]
    single = [(n, 50, 300 - 20 * k, 500, 10) for k, n in enumerate("abcdefgh")]
    note = [(n * 40, 50, 300 - 20 * k, 400, 10) for k, n in enumerate("abcdefgh")] + [("note", 520, 300, 30, 10)]
    assert {r.col for r in read_lines(spark, single, 600.0).collect()} == {r.col for r in read_lines(spark, note, 600.0).collect()} == {0}


def corridor(items, width=600.0):
    """Brute force: where a page of (x, width, characters) is parted, or None."""
    at = [width * (0.25 + 0.01 * k) for k in range(51)]
    free = [k for k in range(51) if not any(x < at[k] < x + w for x, w, _ in items)]
    if len(items) < 8 or not free or (free[-1] - free[0]) * 0.01 < 0.06:
        return None
    split, total = at[free[len(free) // 2]], sum(n for *_, n in items)
    least = min(sum(n for x, w, n in items if x + w <= split), sum(n for x, _, n in items if x >= split))
    return split if least >= 0.15 * total and least > 0 else None


def test_layout_columns_by_brute_force(spark):
    rnd = random.Random(4)
    made = [(p, "x" * rnd.randint(1, 9), float(rnd.choice([50, 150, 300, 306, 330, 400])), 700.0 - 20 * k, float(rnd.choice([30, 90, 150, 156])), 10.0) for p in range(60) for k in range(rnd.choice([3, 7, 8, 12]))]
    frame = spark.createDataFrame(made + [(None, *m[1:]) for m in made if m[0] == 1], ITEMS)
    done = layout.columns(frame, 600.0)
    got = sorted((r.page, r.y, r.x, r.col) for r in done.collect() if r.page is not None)
    split = {p: corridor([(m[2], m[4], len(m[1])) for m in made if m[0] == p]) for p in range(60)}
    assert got == sorted((p, y, x, int(split[p] is not None and x >= split[p])) for p, _, x, y, _, _ in made)
    assert 5 < sum(s is not None for s in split.values()) < 55
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("bit_or(") == 1  # the corridor is settled once a page, not for each item


def test_layout_texts(spark):
    def text(*lines):
        return layout.texts(read_lines(spark, [(t, 50, y, 100, 10) for t, y in lines])).first().text

    assert text(("some inter-", 300), ("national text", 285)) == "some international text"
    assert text(("a well-", 300), ("Known name", 285)) == "a well- Known name"
    assert text(("first para", 300), ("continues here", 285), ("second para", 230)) == "first para continues here\n\nsecond para"


def test_layout_texts_shuffle_once(spark):
    made = [(p, f"{side}{k}", x, 700.0 - 20 * k, 150.0, 10.0) for p in range(5) for k in range(6) for side, x in (("l", 50.0), ("r", 320.0))]
    done = layout.texts(layout.lines(layout.columns(spark.createDataFrame(made, ITEMS), 600.0)))
    plan = done._jdf.queryExecution().executedPlan().toString()  # before it runs: later it has the final plan as well
    assert plan.count("Exchange hashpartitioning(page") == 1 and "Join" not in plan
    assert {r.text for r in done.collect()} == {" ".join(f"{s}{k}" for s in "lr" for k in range(6))}


def test_pages_keep_their_blank_lines(spark):
    book = [(1, p, f"My Book\n\ntext {p}\n\n{n}") for p, n in enumerate(["1", "Page3", "4 / 9"])] + [(1, 3, "My Book\n12")]
    got = {r.page: r.text for r in pages.without_furniture(spark.createDataFrame(book, "doc int, page int, text string")).collect()}
    assert got == {0: "\ntext 0\n", 1: "\ntext 1\n", 2: "\ntext 2\n", 3: ""}


def test_pronunciation_rules(spark):
    def said(text, user=(), dialect="offsets"):
        rules = pronounce.read_rules(pronounce.overridden(pronounce.table(spark, pronounce.SHIPPED), pronounce.table(spark, user)))
        return spark.range(1).select(pronounce.pronounced(F.lit(text), rules, dialect)).first()[0]

    assert said("The GIF loaded. gif Gif") == "The jiff loaded. jiff jiff" and said("Run nginx now.") == "Run engine ex now."
    assert said("The GUI appeared.") == "The gooey appeared." and said("environmental") == "environmental" and said(None) is None
    assert said("The GIF loaded.", [pronounce.Rule("gif", "gif")]) == "The gif loaded."
    assert said("Acme Corporation ships.", [pronounce.Rule("Acme", "ack me"), pronounce.Rule("Acme Corporation", "ack me corp")]) == "ack me corp ships."
    assert said("one cat", [pronounce.Rule("cat", "cat cat")]) == "one cat cat" and said("a us b", [pronounce.Rule("us", "x", enabled=False)]) == "a us b"
    assert said("Dr. Chen", [pronounce.Rule(r"\bDr\.", "Doctor", regex=True)]) == "Doctor Chen"
    assert said("this is ok", [pronounce.Rule("([unclosed", "x", regex=True), pronounce.Rule("ok", "fine $1\\")]) == "this is fine $1\\"
    assert said("IT it", [pronounce.Rule("IT", "I T", match_case=True)]) == "I T it"
    assert said("url_x URL", dialect="blocktext") == "url_x U R L" and said("url_x", dialect="offsets") == "U R L_x"


def test_history(spark):
    rows = [(1, "a", 1.0, 2, 9, 5.0, False, "T"), (2, "a", 3.0, 4, 9, -1.0, True, None), (3, "b", 2.0, 0, 3, 1.0, False, None)]
    events = spark.createDataFrame(rows, "event_id int, uri string, ts double, last_index int, total int, seconds double, finished boolean, title string")
    got = {r.uri: r for r in history.accumulated(events).collect()}
    assert (got["a"].seconds, got["a"].last_index, got["a"].finished, got["a"].title, got["a"].first_read) == (5.0, 4, True, "T", 1.0)
    assert history.unfinished(history.accumulated(events)).count() == 0


def test_identity(spark):
    def one(column, **values):
        return spark.range(1).select(column).first()[0]

    lit = F.lit
    assert one(identity.canonical_url(lit("http://x.org/a?utm_source=1&q=2&REF=3#z"))) == "http://x.org/a?q=2"
    assert one(identity.canonical_url(lit("http://x.org/a?fbclid=1"))) == "http://x.org/a"
    assert one(identity.next_page_url(lit("http://x.org/list?page=09"))) == "http://x.org/list?page=10"
    assert one(identity.next_page_url(lit("http://x.org/list"))) is None
    assert one(identity.host(lit("https://WWW.Example.com:80/a"))) == "example.com:80"
    assert one(identity.title(lit("\n  \n Hello "))) == "Hello" and one(identity.title(lit(" "))) == "Untitled"
    assert one(identity.bigram_similarity(lit("abcab"), lit("abd"))) == 2 * 1 / 6
    assert one(identity.is_gibberish(lit("O O O O")))
    assert not one(identity.is_gibberish(lit("plain words here")))


def test_speech(spark):
    docs = spark.createDataFrame([(1, "I have read the lead, Łódź close."), (2, None)], "doc_id int, text string")
    lexicon = spark.createDataFrame([("the", "DH AH0"), ("have", "HH AE1 V"), ("i", "AY1")], "word string, phones string")
    got = {r.doc_id: r for r in speech.phonemized(docs, lexicon).collect()}
    assert got[1].ipa == "ˈaɪ hˈæv ɹˈɛd ðə lˈɛd, ˈlɑdz ˈklɑs." and got[1].misses == 2
    ids = [1] * 300 + [16] + [2] * 400
    parts = spark.range(1).select(speech.chunks(F.array(*map(F.lit, ids)))).first()[0]
    assert [len(p) for p in parts] == [300, 401] and sum(parts, []) == ids and parts[1][0] == 16
    assert spark.range(1).select(speech.voice_rate(F.lit(2.0))).first()[0] == 6


def test_samples_are_a_plain_sum(spark, tmp_path):
    from loomtext.plans import registry

    spark.range(1000).selectExpr("id AS event_id", "id % 2 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.queries()["k17_samples"](spark, str(tmp_path))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    expected = {u: round(sum((i * 977 % 65536 - 32768) / 32768 for i in range(u, 1000, 2)), 6) for u in (0, 1)}
    assert {r.user_id: r.total for r in found.collect()} == expected


def test_ranked_choice_of_documents_without_text(spark, tmp_path):
    from loomtext.operators import capture
    from loomtext.plans import registry

    rows = [(0, "a b"), (1, ""), (2, "  "), (3, None), (4, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc: (r.source, r.notes) for r in registry.queries()["a16_ranked_choice"](spark, str(tmp_path)).collect()}
    expected = [("rung3", "no 1; no 2"), ("rung2", "no 1; no 3"), ("rung1", "no 2; no 3")]  # as its SQL has it
    assert got == {i: expected[i % 3] for i, _ in rows}
    given = spark.createDataFrame([(1, 1, "a", " ", "x"), (1, 2, "b", "t", None), (2, 1, "a", None, "x")], "doc int, rung int, source string, text string, note string")
    assert {tuple(r) for r in capture.ranked_choice(given).collect()} == {(1, "b", "x"), (2, None, "x")}
