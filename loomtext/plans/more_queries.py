"""Further operators over the tables: sessions, patches, frames, alphabets, boundaries, geometry, sample arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import identity as I
from loomtext.functions import rules
from loomtext.operators import anchors
from loomtext.plans.table_queries import _EVENTS, _SEGMENTS, _positions, _read, _segments, _turns, changed_segments, parsed_turns, reading_events, transcript_lines
from loomtext.plans.text_queries import DECORATED_SQL, decorated, literal

QUERIES = {}
ORACLE_SQL = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_add("a11_newest_sessions", lambda s, d: _turns(s, d).groupBy("conv_id").agg(F.max("turn").alias("modified")).orderBy(F.desc("modified"), "conv_id").limit(40), "SELECT conv_id, max(turn) AS modified FROM conversations GROUP BY conv_id ORDER BY modified DESC, conv_id LIMIT 40")
_add(
    "a18_local_paths",
    lambda s, d: _read(s, d, "pages").select("page_id", F.when(F.lit("file:///") == F.substring(u := F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("file:///tmp/a%20b"), F.col("page_id").cast("string"))).otherwise(F.col("url")), 1, 8), F.url_decode(F.substring(u, 8, 1 << 20))).alias("path")),
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/tmp/a b' || page_id END AS path FROM pages",
)
_add(
    "a20_best_region",
    lambda s, d: _read(s, d, "documents").select("source", "doc_id", I.prose_score(F.col("text")).alias("score")).groupBy("source").agg(F.min_by("doc_id", F.struct((-F.col("score")).alias("s"), F.col("doc_id"))).alias("doc_id")),
    f"SELECT source, arg_min(doc_id, (-score, doc_id)) AS doc_id FROM (SELECT d.source, d.doc_id, coalesce(sum(length(s.text)) FILTER (length(trim(s.text, E' \\t\\n\\r\\f\\v')) > 80), 0) AS score FROM documents d JOIN ({_SEGMENTS}) s ON s.uri = d.doc_id GROUP BY ALL) GROUP BY source",
)
_add("b08_typed_turns", lambda s, d: parsed_turns(transcript_lines(s, d)).where("role = 'user' and tools = 0").select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE turn % 7 <> 6 AND role = 'user' AND trim(text) <> ''")
_add(
    "b09_speakable",
    lambda s, d: _turns(s, d).select("conv_id", "turn", F.md5(F.concat_ws("\n\n", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Thinking. "), F.col("role"))), "text").cast("binary")).alias("digest")),
    "SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), CASE WHEN turn % 2 = 0 THEN 'Thinking. ' || role END, text)) AS digest FROM conversations",
)
_add("c10_index_join", lambda s, d: _read(s, d, "documents").select("doc_id", "lang").join(_read(s, d, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"]), "doc_id"), "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN (SELECT DISTINCT ON (doc_id) doc_id, quality FROM labels) l USING (doc_id)")


def zipped(s: SparkSession, d: str) -> DataFrame:
    """Each segment's customers by key, zipped with the same by balance; groups whose counts differ would be left out."""
    c = _read(s, d, "customer").select(F.col("c_mktsegment").alias("n"), F.col("c_custkey").alias("left_key"))
    u = _read(s, d, "customer").select(F.col("c_mktsegment").alias("n"), F.col("c_custkey").alias("right_key"), "c_acctbal")
    place = lambda *k: F.row_number().over(Window.partitionBy("n").orderBy(*k)).alias("i")
    total = lambda: F.count("*").over(Window.partitionBy("n")).alias("total")
    a, b = c.select("n", "left_key", place("left_key"), total()), u.select("n", "right_key", place("c_acctbal", "right_key"), total())
    return a.join(b, ["n", "i", "total"]).select("n", "left_key", "right_key")


_add("c14_zip_join", zipped, """WITH a AS (SELECT c_mktsegment AS n, c_custkey AS left_key, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM customer),
  b AS (SELECT c_mktsegment AS n, c_custkey AS right_key, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS i FROM customer)
  SELECT a.n, left_key, right_key FROM a JOIN b USING (n, i)""")  # fmt: skip


def patched(s: SparkSession, d: str) -> DataFrame:
    """The state that coalescing patches leave: the last value of each field that isn't null, sums for amounts."""
    e = reading_events(s, d)
    order = F.struct("ts", "event_id")
    last = lambda c, when: F.max_by(c, F.when(when, order))
    return e.groupBy("uri").agg(last("title", F.col("title").isNotNull()).alias("title"), F.max_by("last_index", order).alias("last_index"), F.round(F.sum("seconds"), 4).alias("seconds"))


_add("d08_patched", patched, f"SELECT uri, arg_max(title, CASE WHEN title IS NOT NULL THEN (ts, event_id) END) AS title, arg_max(last_index, (ts, event_id)) AS last_index, round(sum(seconds), 4) AS seconds FROM ({_EVENTS}) GROUP BY uri")
_add(
    "d09_described_sessions",
    lambda s, d: _turns(s, d).groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_typed"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("t")).select("conv_id", "last_typed", F.substring(I.flat(F.coalesce("t", F.lit("Untitled"))), 1, 60).alias("title")),
    r"SELECT conv_id, last_typed, left(trim(regexp_replace(coalesce(t, 'Untitled'), '[ \t\n\r\f\v]+', ' ', 'g')), 60) AS title FROM (SELECT conv_id, max(turn) FILTER (role = 'user') AS last_typed, arg_min(text, turn) FILTER (role = 'user') AS t FROM conversations GROUP BY conv_id)",
)
_ALPHABET = "abcdefghijklmnopqrstuvwxyz .,"
_add(
    "d13_foreign_symbols",
    lambda s, d: _read(s, d, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("c")).groupBy("c").agg(F.count("*").alias("n_documents")).where((F.col("c") != "") & ~F.lit(_ALPHABET).contains(F.col("c"))),
    f"SELECT c, count(*) AS n_documents FROM (SELECT unnest(list_distinct(string_split(lower(text), ''))) AS c FROM documents) WHERE c <> '' AND NOT contains('{_ALPHABET}', c) GROUP BY c",
)
_add("d16_growth", lambda s, d: _segments(s, d).groupBy("uri").agg(F.sum(F.length("text")).alias("n_chars")).where("n_chars >= 120"), f"SELECT uri, sum(length(text))::BIGINT AS n_chars FROM ({_SEGMENTS}) GROUP BY uri HAVING sum(length(text)) >= 120")
_add(
    "e02_anchor_frames",
    lambda s, d: _segments(s, d).select("uri", "idx", F.size(F.collect_list("text").over(w := Window.partitionBy("uri").orderBy("idx").rowsBetween(-2, -1))).alias("n_before"), F.size(F.collect_list("text").over(Window.partitionBy("uri").orderBy("idx").rowsBetween(1, 2))).alias("n_after")),
    f"SELECT uri, idx, count(*) OVER (PARTITION BY uri ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)::INT AS n_before, count(*) OVER (PARTITION BY uri ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)::INT AS n_after FROM ({_SEGMENTS})",
)
_add(
    "e09_highlight_shares",
    lambda s, d: _segments(s, d).select("uri", "idx", F.greatest(F.lit(40), F.floor(30 * 1000 * F.greatest(F.lit(1), F.length("text")) / F.sum(F.greatest(F.lit(1), F.length("text"))).over(Window.partitionBy("uri")))).cast("int").alias("ms")),
    f"SELECT uri, idx, greatest(40, floor(30 * 1000 * greatest(1, length(text)) / sum(greatest(1, length(text))) OVER (PARTITION BY uri)))::INT AS ms FROM ({_SEGMENTS})",
)
_add(
    "e10_prefetch_frame",
    lambda s, d: _segments(s, d).join(_positions(s, d), "uri").where(F.col("idx").between(F.col("index") - 1, F.col("index") + 4)).select("uri", "idx"),
    f"SELECT uri, idx FROM ({_SEGMENTS}) WHERE idx BETWEEN (uri % 6)::INT - 1 AND (uri % 6)::INT + 4",
)
_add("f05_last_turns", lambda s, d: _turns(s, d).withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r <= 3").select("conv_id", "turn"), "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
_add(
    "f11_listed_sessions",
    lambda s, d: _turns(s, d).groupBy("conv_id").agg(F.max("turn").alias("modified"), F.count_if(F.col("role") == "user").alias("typed")).orderBy(F.desc("modified"), "conv_id").limit(25).withColumn("target", F.col("conv_id") == 7).withColumn("agent", F.col("typed") == 0).drop("typed"),
    "SELECT conv_id, max(turn) AS modified, conv_id = 7 AS target, count(*) FILTER (role = 'user') = 0 AS agent FROM conversations GROUP BY conv_id ORDER BY modified DESC, conv_id LIMIT 25",
)
_ABBREVIATIONS = "(VALUES " + ", ".join(f"({literal(k)}, {literal(a)})" for k, words in rules.ABBREVIATIONS.items() for a in words) + ") t(category, word)"


def _abbreviation_rows(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(k, a) for k, words in rules.ABBREVIATIONS.items() for a in words], "category string, word string")


_add("g01_abbreviations", lambda s, d: _abbreviation_rows(s).select(F.lower(F.btrim("word", F.lit("."))).alias("word")).distinct(), f"SELECT DISTINCT lower(trim(word, '.')) AS word FROM {_ABBREVIATIONS}")
_add("g02_never_maybe", lambda s, d: _abbreviation_rows(s).groupBy(F.lower("word").alias("word")).agg(F.max(F.col("category").isin("titles", "military")).alias("never")), f"SELECT lower(word) AS word, max(category IN ('titles', 'military')) AS never FROM {_ABBREVIATIONS} GROUP BY lower(word)")
_add(
    "i09_sentence_starts",
    lambda s, d: _segments(s, d).select("uri", "idx", F.col("text").rlike("^\\s*[\"'“‘(\\[]?[A-ZÀ-Þ0-9]").alias("starts")),
    f"SELECT uri, idx, regexp_matches(text, '^\\s*[\"''“‘(\\[]?[A-ZÀ-Þ0-9]') AS starts FROM ({_SEGMENTS})",
)
_add(
    "i08_period_words",
    lambda s, d: decorated(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z][A-Za-z.]*)\."), 1)).alias("w")).groupBy(F.lower("w").isin(rules.abbreviations()).alias("known")).agg(F.count("*").alias("n")),
    f"WITH t AS ({DECORATED_SQL}) SELECT lower(w) IN ({', '.join(map(literal, rules.abbreviations()))}) AS known, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([A-Za-z][A-Za-z.]*)\\.', 1)) AS w FROM t) GROUP BY known",
)
_add("j06_anchor_json", lambda s, d: anchors.created(_segments(s, d), _positions(s, d)).select("uri", F.from_json(F.to_json(F.struct("exact", "index_hint")), "exact string, index_hint int, prefix string").alias("a")).select("uri", F.length("a.exact").alias("n"), "a.index_hint", F.coalesce("a.prefix", F.lit("")).alias("prefix")), f"SELECT uri, length(text)::INT AS n, idx AS index_hint, '' AS prefix FROM (SELECT *, max(idx) OVER (PARTITION BY uri) AS last FROM ({_SEGMENTS})) WHERE idx = greatest(0, least((uri % 6)::INT, last))")


def resumed(s: SparkSession, d: str) -> DataFrame:
    """Resuming: anchors of one version found again in the next, clamped, with what the reader is told."""
    a = anchors.created(_segments(s, d), _positions(s, d)).withColumn("rules_changed", F.col("uri") % 3 == 0)
    found = anchors.located(a, changed_segments(s, d))
    return found.select("uri", "index", "how", anchors.message(F.col("how"), F.col("uri") % 3 == 0).alias("message"))


_add("j11_resumed", resumed)
_add("j02_located_offsets", lambda s, d: anchors.located_offsets(anchors.created_offsets(_segments(s, d), _positions(s, d)).withColumns({"stamp": F.lit("a"), "current_stamp": F.when(F.col("uri") % 3 == 0, "b").otherwise("a")}), changed_segments(s, d)))
_HOW = "(['exact', 'ambiguous', 'boundary', 'fuzzy', 'hint'])[event_id % 5 + 1]"
_add(
    "j07_messages",
    lambda s, d: _read(s, d, "events").select("event_id", anchors.message(F.element_at(F.array(*map(F.lit, ["exact", "ambiguous", "boundary", "fuzzy", "hint"])), (F.col("event_id") % 5 + 1).cast("int")), F.col("event_id") % 2 == 0).alias("message")),
    f"SELECT event_id, CASE {_HOW} WHEN 'exact' THEN '' WHEN 'ambiguous' THEN 'This sentence appears more than once.' WHEN 'boundary' THEN 'The sentence here has changed.' WHEN 'fuzzy' THEN CASE WHEN event_id % 2 = 0 THEN 'The reading rules have changed since.' ELSE 'The text here has changed.' END ELSE 'The place was not found.' END AS message FROM events",
)
_add("j17_clamped", lambda s, d: _segments(s, d).groupBy("uri").agg(F.greatest(F.lit(0), F.least(F.max("idx"), F.pmod("uri", F.lit(9)).cast("int"))).alias("start")), f"SELECT uri, greatest(0, least(max(idx), (uri % 9)::INT)) AS start FROM ({_SEGMENTS}) GROUP BY uri")
_add(
    "k15_screen_points",
    lambda s, d: _read(s, d, "events").select("event_id", F.bround(F.col("event_id") * 1.25 + 7).cast("int").alias("x"), F.greatest(F.lit(1), F.bround(F.col("event_id") % 3 * 0.4)).cast("int").alias("width")),
    "SELECT event_id, round_even(event_id * 1.25 + 7, 0)::INT AS x, greatest(1, round_even(event_id % 3 * 0.4, 0))::INT AS width FROM events",
)
_add(
    "k17_samples",
    lambda s, d: _read(s, d, "events").groupBy("user_id").agg(F.round(F.sum((F.col("event_id") * 977 % 65536 - 32768) / 32768), 6).alias("total")),
    "SELECT user_id, round(sum(((event_id * 977) % 65536 - 32768) / 32768), 6) AS total FROM events GROUP BY user_id",
)
_add("l04_batched_replies", lambda s, d: _turns(s, d).where("role = 'assistant'").groupBy((F.floor(F.col("conv_id") / 5)).alias("poll")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars")), "SELECT conv_id // 5 AS poll, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM conversations WHERE role = 'assistant' GROUP BY poll")
_add("l05_incremental_sessions", lambda s, d: _turns(s, d).withColumn("so_far", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "turn", "so_far"), "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM conversations")
_add("d14_dictionary_misses", lambda s, d: _read(s, d, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))).alias("word")).where("word <> ''").join(_read(s, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).distinct(), "word", "left_anti").groupBy("word").agg(F.count("*").alias("n")), "WITH b AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark) SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS word FROM documents) WHERE word <> '' AND word NOT IN (SELECT word FROM b) GROUP BY word")
