"""Scalar operators over the tables: identity, titles, addresses, capture predicates, pronunciation, token arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import identity as I
from loomtext.functions import rules, speech
from loomtext.operators.pages import PAGE_NUMBER
from loomtext.plans.text_queries import DECORATED_SQL, decorated, literal

QUERIES = {}
ORACLE_SQL = {}

_WS = "E' \\t\\n\\r\\f\\v'"
_FLAT = r"trim(regexp_replace({}, '[ \t\n\r\f\v]+', ' ', 'g'))"


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


_add(
    "a05_looks_scanned",
    lambda s, d: _docs(s, d).select("doc_id", I.looks_scanned(F.col("text"), F.pmod("doc_id", F.lit(50))).alias("scanned")),
    f"SELECT doc_id, length(trim(text, {_WS})) < greatest(16, (doc_id % 50) * 8) AS scanned FROM documents",
)
_add(
    "a15_document_identity",
    lambda s, d: _docs(s, d).select("doc_id", I.title(F.col("text")).alias("title"), I.content_uri(F.col("text"), F.col("source")).alias("uri"), I.snippet(F.col("text")).alias("snippet")),
    f"""SELECT doc_id,
      CASE WHEN line IS NULL THEN 'Untitled' WHEN length(line) > 80 THEN left(line, 80) || '…' ELSE line END AS title,
      'doc:' || source || '/' || left(sha1(text), 16) AS uri, left({_FLAT.format("text")}, 200) AS snippet
      FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '')[1] AS line FROM documents)""",
)
_add(
    "a22_capture_minimum",
    lambda s, d: _docs(s, d).where(F.length(I.strip(F.col("text"))) >= 12).select("doc_id"),
    f"SELECT doc_id FROM documents WHERE length(trim(text, {_WS})) >= 12",
)
_add(
    "a32_pdf_url",
    lambda s, d: _pages(s, d).select("page_id", I.is_pdf_url(F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF?x=1").otherwise(""))).alias("pdf")),
    "SELECT page_id, regexp_matches(url || CASE WHEN page_id % 3 = 0 THEN '.PDF?x=1' ELSE '' END, '(?i)^(https?|file):.*\\.pdf($|[?#])') AS pdf FROM pages",
)
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


def _lines(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


_GIBBERISH = f"""SELECT doc_id, pos, line, length(inner_) = 0 OR length(regexp_replace(inner_, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(inner_) < 0.4
   OR (len(toks) >= 3 AND len(list_filter(toks, lambda t: length(trim(t, '.,;:!?-')) <= 1)) / len(toks) > 0.6) AS gibberish
   FROM (SELECT *, trim(line, {_WS}) AS inner_, regexp_extract_all(trim(line, {_WS}), '\\S+') AS toks FROM ({_LINES}))"""
_add(
    "b01_gibberish",
    lambda s, d: _lines(s, d).select("doc_id", "pos", I.is_gibberish(F.col("line")).alias("gibberish")),
    f"SELECT doc_id, pos::INT AS pos, gibberish FROM ({_GIBBERISH})",
)
_add(
    "b02_clean",
    lambda s, d: _docs(s, d).select("doc_id", F.md5(I.without_gibberish(F.col("text")).cast("binary")).alias("digest")),
    f"SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gibberish), '')) AS digest FROM ({_GIBBERISH}) GROUP BY doc_id",
)
#: Lines that every third line of a document gives way to, and whether they are a window's furniture.
NOISE_CASES = [("Back", True), (" New Tab ", True), ("Customize and control Google Chrome", True), ("https://a.b/c?d", True), ("x", True), ("  ", True), ("Address field", True), ("backwards", False), ("see https://a.b", False), ("ok", False)]
_noisy = lambda s, d: _lines(s, d).withColumn("line", F.when(F.col("pos") % 3 == 0, F.get(F.array(*(F.lit(x) for x, _ in NOISE_CASES)), F.pmod("doc_id", F.lit(len(NOISE_CASES))).cast("int"))).otherwise(F.concat(F.lit("a "), "line")))
_add(
    "b03_noise",
    lambda s, d: _noisy(s, d).select("doc_id", "pos", I.is_noise(F.col("line")).alias("noise")),
    f"SELECT doc_id, pos::INT AS pos, pos % 3 = 0 AND [{', '.join(str(x).lower() for _, x in NOISE_CASES)}][(doc_id % {len(NOISE_CASES)} + 1)::INT] AS noise FROM ({_LINES})",
)
_add(
    "b06_prose_score",
    lambda s, d: _docs(s, d).select("doc_id", I.prose_score(F.col("text")).alias("score")),
    f"SELECT doc_id, coalesce(sum(length(line)) FILTER (length(trim(line, {_WS})) > 80), 0)::INT AS score FROM ({_LINES}) GROUP BY doc_id",
)
_add(
    "b07_leading_chrome",
    lambda s, d: _docs(s, d).select("doc_id", F.length(I.without_leading_chrome(F.concat(F.repeat(F.lit("menu\n"), F.pmod("doc_id", F.lit(12)).cast("int")), "text"))).alias("n")),
    f"""SELECT doc_id, CASE WHEN first_ > 8 THEN length(array_to_string(ls[first_:], chr(10))) ELSE length(t) END AS n FROM (
      SELECT doc_id, t, ls, coalesce(list_position(list_transform(ls, lambda x: length(trim(x, {_WS})) > 80), true), 0) AS first_
      FROM (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM (SELECT doc_id, repeat('menu' || chr(10), (doc_id % 12)::INT) || text AS t FROM documents)))""",
)
_add(
    "b14_exact",
    lambda s, d: decorated(s, d).select("doc_id", (F.translate("text", "“”’", "\"\"'") == F.col("text")).alias("exact")),
    f"WITH t AS ({DECORATED_SQL}) SELECT doc_id, translate(text, '“”’', '\"\"''') = text AS exact FROM t",
)
_add(
    "b16_progress",
    lambda s, d: _docs(s, d).select("doc_id", I.progress(F.pmod("doc_id", F.lit(7)), F.pmod("doc_id", F.lit(5)) * 3).alias("progress")),
    "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 7) / ((doc_id % 5) * 3) ELSE 0.0 END AS progress FROM documents",
)
#: Lines and whether they are only a page number.
NUMBER_CASES = [("12", True), (" Page 3 ", True), ("Page3", True), ("12 / 300", True), ("PAGE 7/9", True), ("12345", False), ("3 of 9", False), ("p. 3", False), ("Page", False), ("3.", False)]
_add(
    "b17_page_numbers",
    lambda s, d: _docs(s, d).select("doc_id", F.concat(F.get(F.array(*(F.lit(x) for x, _ in NUMBER_CASES)), F.pmod("doc_id", F.lit(len(NUMBER_CASES))).cast("int")), F.lit("\n"), "text").alias("t")).select("doc_id", F.size(F.filter(F.split("t", "\n"), lambda x: x.rlike(PAGE_NUMBER["blocktext"]))).cast("long").alias("n")),
    f"SELECT doc_id, [{', '.join(str(int(x)) for _, x in NUMBER_CASES)}][(doc_id % {len(NUMBER_CASES)} + 1)::INT]::BIGINT + len(list_filter(string_split(text, chr(10)), lambda x: try_cast(trim(x) AS INT) BETWEEN 0 AND 9999)) AS n FROM documents",
)
_add(
    "j03_padded_words",
    lambda s, d: _lines(s, d).select("doc_id", "pos", I.padded_words(F.col("line")).alias("padded"), I.substantial(I.padded_words(F.col("line"))).alias("substantial")),
    f"""SELECT doc_id, pos::INT AS pos, padded, len(regexp_extract_all(padded, '\\S+')) >= 4 AND length(trim(padded)) >= 12 AS substantial
      FROM (SELECT *, ' ' || {_FLAT.format("lower(regexp_replace(line, '[^\\p{L}\\p{N}_\\s]+', ' ', 'g'))")} || ' ' AS padded FROM ({_LINES}))""",
)
_add(
    "j08_canonical_url",
    lambda s, d: _pages(s, d).select("page_id", I.canonical_url(F.concat("url", F.when(F.col("page_id") % 2 == 0, "?utm_source=a&q=1&fbclid=z#top").otherwise(""))).alias("url")),
    """SELECT page_id, CASE WHEN len(kept) > 0 THEN path || '?' || array_to_string(kept, '&') ELSE path END AS url FROM (
      SELECT page_id, regexp_extract(base, '^([^?]*)', 1) AS path,
        list_filter(string_split(regexp_extract(base, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|mc_[^=]*|ref|source)(=|$)')) AS kept
      FROM (SELECT page_id, split_part(url || CASE WHEN page_id % 2 = 0 THEN '?utm_source=a&q=1&fbclid=z#top' ELSE '' END, '#', 1) AS base FROM pages))""",
)
_add(
    "j09_next_page_url",
    lambda s, d: _pages(s, d).select("page_id", I.next_page_url(F.concat("url", F.when(F.col("page_id") % 4 == 0, "&page=009").otherwise(""))).alias("next")),
    r"""SELECT page_id, CASE WHEN regexp_matches(u, p) THEN regexp_extract(u, p, 1) || CASE WHEN length(hi) < length(dg) THEN lpad(hi, length(dg)::INT, '0') ELSE hi END || regexp_extract(u, p, 3) END AS next FROM (
      SELECT *, regexp_extract(u, p, 2) AS dg, (try_cast(regexp_extract(u, p, 2) AS HUGEINT) + 1)::VARCHAR AS hi FROM (
        SELECT page_id, url || CASE WHEN page_id % 4 = 0 THEN '&page=009' ELSE '' END AS u, '^(.*?[/?&](?:page|p|pg)=?)(\d+)(.*)$' AS p FROM pages))""",
)
#: Ages in seconds, and how the three lists say them ("": the day, which the SQL writes itself).
AGES = [(0, "just now", "0s ago", "just now"), (59, "just now", "59s ago", "just now"), (61, "1 min ago", "1m ago", "1 minutes ago"), (3599, "59 min ago", "59m ago", "59 minutes ago"), (5399, "1 h ago", "1h ago", "89 minutes ago"), (5400, "1 h ago", "1h ago", "1 hours ago"), (86399, "23 h ago", "23h ago", "23 hours ago"), (129599, "1 d ago", "1d ago", "35 hours ago"), (129600, "1 d ago", "1d ago", "1 days ago"), (604799, "6 d ago", "6d ago", "6 days ago"), (604800, "7 d ago", "", "7 days ago")]
_age = lambda: F.get(F.array(*(F.lit(a) for a, *_ in AGES)), F.pmod("event_id", F.lit(len(AGES))).cast("int"))
_said = lambda k: "[" + ", ".join(f"'{a[k]}'" for a in AGES) + f"][(event_id % {len(AGES)} + 1)::INT]"
_add(
    "j12_age_labels",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", I.age_label(_age()).alias("age"), I.short_age(_age(), F.when(F.col("event_id") % 5 > 0, F.col("ts"))).alias("short_age"), I.typed_age(F.when(F.col("event_id") % 4 > 0, _age())).alias("typed_age")),
    f"SELECT event_id, {_said(1)} AS age, CASE WHEN event_id % 5 = 0 THEN '' WHEN {_said(2)} = '' THEN strftime(ts, '%d %b') ELSE {_said(2)} END AS short_age, CASE WHEN event_id % 4 = 0 THEN 'no one has typed in it' ELSE {_said(3)} END AS typed_age FROM events",
)
_add(
    "j13_short_titles",
    lambda s, d: _docs(s, d).select("doc_id", I.short_title(F.col("text")).alias("title")),
    f"""SELECT doc_id, CASE WHEN length(line) <= 52 THEN line ELSE regexp_replace(CASE WHEN contains(head, ' ') THEN regexp_replace(head, '\\s+\\S*$', '') ELSE head END, '[ ,.;:-]+$', '') || '…' END AS title
      FROM (SELECT doc_id, line, left(line, 52) AS head FROM (SELECT doc_id, {_FLAT.format("text")} AS line FROM documents))""",
)
_add(
    "j14_project_names",
    lambda s, d: _docs(s, d).select("doc_id", I.project_slug(F.concat(F.lit("C:\\work/"), "source")).alias("slug"), I.project_name(I.project_slug(F.concat(F.lit("C:\\work/"), "source"))).alias("name")),
    "SELECT doc_id, slug, list_filter(string_split(slug, '-'), lambda p: p <> '')[-1] AS name FROM (SELECT doc_id, translate('C:\\work/' || source, ':\\/', '---') AS slug FROM documents)",
)
_add(
    "j15_previews",
    lambda s, d: _docs(s, d).select("doc_id", I.preview(F.col("text")).alias("preview"), F.md5(I.letters_key(F.col("text")).cast("binary")).alias("key")),
    f"SELECT doc_id, CASE WHEN length(f) > 90 THEN left(f, 90) || '...' ELSE f END AS preview, md5(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS key FROM (SELECT *, {_FLAT.format('text')} AS f FROM documents)",
)
_add(
    "j16_hosts",
    lambda s, d: _pages(s, d).select("page_id", I.host(F.col("url")).alias("host")),
    r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), '^www\.', '') AS host FROM pages",
)
_add("d04_overlap", lambda s, d: _docs(s, d).select("doc_id", I.overlap(F.lower("text"), F.lit("the and of la le de der die und el que")).alias("overlap")),
    """SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_intersect(w, ['the', 'and', 'of', 'la', 'le', 'de', 'der', 'die', 'und', 'el', 'que'])) / len(w) END AS overlap
      FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[^\\s]+')) AS w FROM documents)""")  # fmt: skip
_TITLE = f"""SELECT doc_id, lower({_FLAT.format("CASE WHEN line IS NULL THEN 'Untitled' WHEN length(line) > 80 THEN left(line, 80) || '…' ELSE line END")}) AS t, 'the cat sat ' || lang || ' ' || source || ' que la de in' AS u
  FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '')[1] AS line FROM documents)"""
_add(
    "d05_similarity",
    lambda s, d: _docs(s, d).select("doc_id", F.round(I.bigram_similarity(I.title(F.col("text")), F.concat(F.lit("the cat sat "), "lang", F.lit(" "), "source", F.lit(" que la de in"))), 9).alias("dice")),
    f"""WITH l AS ({_TITLE}),
      g AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(length(t), 1)), lambda i: substr(t, i, 2))) AS g FROM l) GROUP BY ALL),
      q AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length(u)), lambda i: substr(u, i, 2))) AS g FROM l) GROUP BY ALL),
      shared AS (SELECT doc_id, sum(least(g.n, q.n)) AS n FROM g JOIN q USING (doc_id, g) GROUP BY doc_id)
      SELECT l.doc_id, round(CASE WHEN length(t) < 2 THEN 0.0 ELSE 2 * coalesce(s.n, 0) / (length(t) - 1 + length(u) - 1) END, 9) AS dice FROM l LEFT JOIN shared s USING (doc_id)""",
)


def _words(s, d):
    """Distinct words of the documents with their counts: the table that pronouncing works on."""
    w = _docs(s, d).select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.count("*").alias("n"))


_WORDS = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY word"
_SPELL = "|".join(a for a, _ in rules.SPELLINGS)
_SPELL_MAP = "MAP {" + ", ".join(f"{literal(a)}: {literal(b)}" for a, b in rules.SPELLINGS) + "}"
_add(
    "k06_letter_sounds",
    lambda s, d: _words(s, d).select("word", "n", speech.letter_sounds(F.col("word")).alias("ipa")),
    f"""SELECT word, n, CASE WHEN len(p) > 0 THEN 'ˈ' || array_to_string(list_transform(p, lambda x: ({_SPELL_MAP})[x]), '') ELSE '' END AS ipa
      FROM (SELECT word, n, regexp_extract_all(CASE WHEN length(word) > 3 THEN regexp_replace(word, 'e$', chr(4)) ELSE word END, '{_SPELL}') AS p FROM ({_WORDS}))""",
)
_add(
    "k08_ligatures",
    lambda s, d: _words(s, d).select("word", speech.ligatures(F.concat(F.lit("dʒ"), "word", F.lit("tʃa"))).alias("ipa")),
    f"SELECT word, {'replace(' * len(rules.LIGATURES)}'dʒ' || word || 'tʃa'{''.join(f', {literal(a)}, {literal(b)})' for a, b in rules.LIGATURES)} AS ipa FROM ({_WORDS})",
)
_VOCABULARY = {c: n for n, c in enumerate("abcdefghijklmnopqrstuvwxyz", 43)} | {" ": 16, ",": 3, ".": 4}
_VOCABULARY_SQL = "MAP {" + ", ".join(f"{literal(c)}: {n}" for c, n in _VOCABULARY.items()) + "}"


def _ids(s, d):
    return _docs(s, d).select("doc_id", speech.token_ids(F.lower("text"), _VOCABULARY).alias("ids"))


_IDS = f"SELECT doc_id, list_filter(list_transform(string_split(lower(text), ''), lambda c: ({_VOCABULARY_SQL})[c]), lambda x: x IS NOT NULL) AS ids FROM documents"
_add(
    "k09_token_ids",
    lambda s, d: _ids(s, d).select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")),
    f"SELECT doc_id, len(ids)::INT AS n, coalesce(list_sum(ids), 0)::BIGINT AS total FROM ({_IDS})",
)
_add("k10_chunks", lambda s, d: _ids(s, d).select("doc_id", F.posexplode(speech.chunks(F.col("ids"))).alias("chunk", "part")).select("doc_id", "chunk", F.size("part").alias("n_ids")))
_add(
    "k11_bounded",
    lambda s, d: _ids(s, d).select("doc_id", F.size(speech.bounded(F.col("ids"))).alias("n"), speech.style_row(F.size("ids"), 510).alias("row"), speech.style_row(F.size("ids"), 510, "offsets").alias("row_offsets")),
    f"SELECT doc_id, (len(ids) + 2)::INT AS n, (least(greatest(len(ids), 1), 510) - 1)::INT AS row, greatest(0, least(len(ids), 509))::INT AS row_offsets FROM ({_IDS})",
)
_add(
    "k12_padded_ids",
    lambda s, d: _ids(s, d).select("doc_id", F.size(speech.padded_ids(F.col("ids"))).alias("n")),
    f"SELECT doc_id, (2 * len(ids) + 2)::INT AS n FROM ({_IDS})",
)
_add(
    "k13_speeds",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", speech.voice_rate(F.abs("value") / 10 + 0.1).alias("rate"), F.round(speech.clamped_speed(F.abs("value") / 10), 6).alias("speed")),
    "SELECT event_id, greatest(-10, least(10, round_even(ln(abs(value) / 10 + 0.1) / ln(1.1176), 0)))::INT AS rate, round(round_even(greatest(0.5, least(4.0, abs(value) / 10)) * 20, 0) / 20, 6) AS speed FROM events",
)
_add(
    "k18_stamps",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", speech.stamp_seconds(F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("seconds")),
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch(date_trunc('second', ts))::BIGINT END AS seconds FROM events",
)
_add("k07_phonemized", lambda s, d: speech.phonemized(_docs(s, d)).select("doc_id", "misses", F.md5(F.col("ipa").cast("binary")).alias("digest")))
_PHONES = "['K', 'AH0', 'L', 'OW1', 'Z', 'IY2', 'UW0']"
_add(
    "k05_ipa",
    lambda s, d: _docs(s, d).select("doc_id", speech.to_ipa(F.slice(F.array(*map(F.lit, ["K", "AH0", "L", "OW1", "Z", "IY2", "UW0"])), 1, (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))).alias("ipa")),
    f"SELECT doc_id, array_to_string((['k', 'ə', 'l', 'ˈoʊ', 'z', 'ˌiː', 'u'])[1:(doc_id % 7 + 1)], '') AS ipa FROM documents",
)
_add(
    "k04_readings",
    lambda s, d: _docs(s, d).select("doc_id", F.explode(F.array(*map(F.lit, ["read", "lead", "live", "use", "other"]))).alias("word"), F.element_at(F.array(*map(F.lit, ["the", "to", "have", "red"])), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("prev")).select("doc_id", "word", speech.reading(F.col("word"), F.col("prev")).alias("phones")),
    """SELECT doc_id, word, CASE WHEN word = 'read' THEN CASE prev WHEN 'have' THEN 'R EH1 D' WHEN 'to' THEN 'R IY1 D' END
        WHEN word = 'live' THEN CASE WHEN prev = 'the' THEN 'L AY1 V' ELSE 'L IH1 V' END
        WHEN word = 'lead' THEN CASE prev WHEN 'the' THEN 'L EH1 D' WHEN 'to' THEN 'L IY1 D' END
        WHEN word = 'use' THEN CASE prev WHEN 'the' THEN 'Y UW1 S' WHEN 'to' THEN 'Y UW1 Z' END END AS phones
      FROM (SELECT doc_id, unnest(['read', 'lead', 'live', 'use', 'other']) AS word, (['the', 'to', 'have', 'red'])[doc_id % 4 + 1] AS prev FROM documents)""",
)
