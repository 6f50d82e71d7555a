"""DataFrame operators over the tables: pages and furniture, history, transcripts, anchors, joins, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import identity as I
from loomtext.operators import anchors, history, pages
from loomtext.streaming import watch

QUERIES = {}
ORACLE_SQL = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def doc_pages(s: SparkSession, d: str) -> DataFrame:
    """Documents as pages of books: ten documents a book, with a running head, a blank line, a chapter line and a page number;
    a tenth of the pages have nothing else."""
    docs = _read(s, d, "documents")
    doc, page = F.floor(F.col("doc_id") / 10).alias("doc"), F.pmod("doc_id", F.lit(10)).alias("page")
    number = F.concat(F.get(F.array(F.lit(" "), F.lit("Page "), F.lit("page")), (page % 3).cast("int")), (page + 1).cast("string"), F.when(page % 3 == 0, " / 300").otherwise(""))
    body = F.when(F.col("doc_id") % 10 == 7, "").otherwise(F.concat(F.lit("\n"), "text", F.lit("\nChapter "), page.cast("string"), F.lit(" notes")))
    return docs.select(doc, page, F.concat(F.lit("Book "), doc.cast("string"), F.lit("\n"), body, F.lit("\n"), number).alias("text"))


_PAGES = """SELECT doc_id // 10 AS doc, doc_id % 10 AS page, 'Book ' || (doc_id // 10) || chr(10) || CASE WHEN doc_id % 10 = 7 THEN '' ELSE chr(10) || text || chr(10) || 'Chapter ' || (doc_id % 10) || ' notes' END
  || chr(10) || [' ', 'Page ', 'page'][(doc_id % 10 % 3 + 1)::INT] || (doc_id % 10 + 1) || CASE WHEN doc_id % 10 % 3 = 0 THEN ' / 300' ELSE '' END AS text FROM documents"""
_PAGE_LINES = f"""lines AS (SELECT doc, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM ({_PAGES})),
  placed AS (SELECT *, CASE WHEN trim(line) <> '' THEN sum((trim(line) <> '')::INT) OVER (PARTITION BY doc, page ORDER BY pos) END AS place, sum((trim(line) <> '')::INT) OVER (PARTITION BY doc, page) AS n_lines FROM lines),
  n_pages AS (SELECT doc, count(DISTINCT page) AS n_pages FROM ({_PAGES}) GROUP BY doc)"""


def _furniture_sql(key, most, edge, least, number):
    """number: what else goes, of a line."""
    return f"""WITH {_PAGE_LINES}, keyed AS (SELECT p.*, {key} AS key, n_pages FROM placed p JOIN n_pages USING (doc)),
      heads AS (SELECT doc, key FROM keyed WHERE n_pages >= 3 AND (place <= {edge} OR place > n_lines - {edge}) AND {most} GROUP BY doc, key, n_pages HAVING count(DISTINCT page) >= {least})
      SELECT k.doc, k.page, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (h.key IS NULL AND NOT coalesce({number}, false)), '')) AS digest
      FROM keyed k LEFT JOIN heads h ON h.doc = k.doc AND h.key = k.key GROUP BY k.doc, k.page"""


_digest = lambda df: df.select("doc", "page", F.md5(F.col("text").cast("binary")).alias("digest"))
_add("d01_furniture", lambda s, d: _digest(pages.without_furniture(doc_pages(s, d))), _furniture_sql("trim(line)", "length(key) <= 90", "2", "greatest(2, floor(n_pages * 0.6))", "trim(line) <> '' AND (try_cast(trim(line) AS INT) BETWEEN 0 AND 9999 OR regexp_matches(lower(trim(line)), '^page *[0-9]{1,4}$') OR regexp_matches(trim(line), '^[0-9]{1,4} */ *[0-9]{1,4}$'))"))
_add("d02_furniture_offsets", lambda s, d: _digest(pages.without_furniture(doc_pages(s, d), "offsets")), _furniture_sql("regexp_replace(trim(line), '[0-9]+', '#', 'g')", "length(line) <= 80 AND length(key) >= 2", "(CASE WHEN n_lines > 5 THEN 2 ELSE 1 END)", "greatest(3, ceil(n_pages * 0.5))", "n_pages >= 3 AND regexp_matches(trim(line), '^[0-9]{1,4}$')"))


def reading_events(s: SparkSession, d: str) -> DataFrame:
    """The events table as reading events of documents."""
    e = _read(s, d, "events")
    return e.select(
        "event_id", F.concat(F.lit("doc/"), F.col("user_id").cast("string")).alias("uri"), "ts", (F.col("value") - 5).alias("seconds"), F.pmod("event_id", F.lit(40)).alias("last_index"),
        F.lit(40).alias("total"), (F.col("event_type") == "purchase").alias("finished"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("title"),
    )


_EVENTS = "SELECT event_id, 'doc/' || user_id AS uri, ts, value - 5 AS seconds, event_id % 40 AS last_index, 40 AS total, event_type = 'purchase' AS finished, CASE WHEN event_id % 3 = 0 THEN event_type END AS title FROM events"
_HISTORY = f"""SELECT uri, min(ts) AS first_read, max(ts) AS last_read, sum(greatest(0, seconds)) AS seconds, arg_max(last_index, (ts, event_id)) AS last_index,
  arg_max(total, (ts, event_id)) AS total, arg_max(finished, (ts, event_id)) AS finished, arg_max(title, CASE WHEN title IS NOT NULL THEN (ts, event_id) END) AS title FROM ({_EVENTS}) GROUP BY uri"""
_hist = lambda s, d: history.accumulated(reading_events(s, d))
_add("d07_history", lambda s, d: _hist(s, d).withColumn("seconds", F.round("seconds", 4)), f"SELECT * REPLACE (round(seconds, 4) AS seconds) FROM ({_HISTORY})")
_add("f01_recent", lambda s, d: history.recent(_hist(s, d), 20).select("uri", "last_read"), f"SELECT uri, last_read FROM ({_HISTORY}) ORDER BY last_read DESC, uri LIMIT 20")
_add("b15_unfinished", lambda s, d: history.unfinished(_hist(s, d)).select("uri", "last_index"), f"SELECT uri, last_index FROM ({_HISTORY}) WHERE NOT finished AND last_index > 0")
_add("f03_pruned", lambda s, d: history.pruned(_hist(s, d), 50, F.lit("2024-01-05").cast("timestamp_ntz")).select("uri"), f"SELECT uri FROM ({_HISTORY}) WHERE last_read >= TIMESTAMP '2024-01-05' ORDER BY last_read DESC, uri LIMIT 50")
_add("m07_history_removed", lambda s, d: history.without(_hist(s, d), _hist(s, d).where("last_index % 2 = 0").select("uri")).select("uri"), f"SELECT uri FROM ({_HISTORY}) WHERE last_index % 2 <> 0")
_add(
    "f10_history_list",
    lambda s, d: history.recent(_hist(s, d)).select("uri", F.floor(I.progress(F.col("last_index"), F.col("total")) * 100).cast("int").alias("percent"), F.when(F.col("seconds") < 60, "<1 min").otherwise(F.concat(F.floor(F.col("seconds") / 60).cast("string"), F.lit(" min"))).alias("time")),
    f"SELECT uri, floor(last_index / total * 100)::INT AS percent, CASE WHEN seconds < 60 THEN '<1 min' ELSE floor(seconds / 60)::BIGINT || ' min' END AS time FROM ({_HISTORY}) ORDER BY last_read DESC, uri LIMIT 100",
)
_add(
    "e14_elapsed",
    lambda s, d: reading_events(s, d).select("event_id", F.least((F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(Window.partitionBy("uri").orderBy("ts", "event_id"))), F.lit(120.0)).alias("s")).select("event_id", F.round("s", 3).alias("elapsed")),
    f"SELECT event_id, round(least(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY uri ORDER BY ts, event_id), 120.0), 3) AS elapsed FROM ({_EVENTS})",
)
_turns = lambda s, d: _read(s, d, "conversations")
_add("a14_last_turns", lambda s, d: history.last_turns(_turns(s, d), 2).select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest")), "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'assistant') WHERE r <= 2 GROUP BY conv_id")
_add("a13_tail_window", lambda s, d: history.tail_window(_turns(s, d), 3000).select("conv_id", "turn"), "SELECT conv_id, turn FROM (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total FROM conversations) WHERE total <= 3000")


def transcript_lines(s: SparkSession, d: str) -> DataFrame:
    """Conversations as transcript lines: JSON whose content is a string for users, typed blocks for assistants; some broken."""
    text = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit("x").alias("text")))
    blocks = F.to_json(F.struct(F.col("role").alias("type"), F.struct(block.alias("content")).alias("message")))
    line = F.when(F.col("turn") % 7 == 6, "{broken").when(F.col("role") == "assistant", blocks).otherwise(text)
    return _turns(s, d).select("conv_id", "turn", line.alias("line"))


def parsed_turns(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, tools): lines that aren't JSON go, as do turns without text; content is text or blocks."""
    content = F.get_json_object("line", "$.message.content")
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    spoken = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    rows = lines.select("conv_id", "turn", F.get_json_object("line", "$.type").alias("role"), F.coalesce(spoken, content).alias("text"), F.coalesce(F.size(F.filter(blocks, lambda b: b["type"] == "tool_use")), F.lit(0)).alias("tools"))
    return rows.where(F.col("role").isin("assistant", "user") & (F.trim("text") != ""))


_add("a09_transcripts", lambda s, d: parsed_turns(transcript_lines(s, d)), "SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END::INT AS tools FROM conversations WHERE turn % 7 <> 6 AND role IN ('assistant', 'user') AND trim(text) <> ''")
_add(
    "f04_sessions",
    lambda s, d: _turns(s, d).groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_typed"), F.max("turn").alias("modified")).orderBy(F.desc_nulls_last("last_typed"), F.desc("modified"), "conv_id").limit(25),
    "SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS last_typed, max(turn) AS modified FROM conversations GROUP BY conv_id ORDER BY last_typed DESC NULLS LAST, modified DESC, conv_id LIMIT 25",
)
_add("g06_batched_turns", lambda s, d: history.last_turns(_turns(s, d), 1 << 30, "user").select("conv_id", F.length("text").alias("n")), "SELECT conv_id, sum(length(text)) + 2 * (count(*) - 1) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id")
_segments = lambda s, d: _read(s, d, "documents").select(F.col("doc_id").alias("uri"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
_SEGMENTS = "SELECT doc_id AS uri, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS idx FROM documents"
_positions = lambda s, d: _read(s, d, "documents").select(F.col("doc_id").alias("uri"), F.pmod("doc_id", F.lit(6)).cast("int").alias("index"))
_ANCHORS = f"""SELECT uri, text AS exact, right(before_, 48) AS prefix, left(after_, 48) AS suffix, idx AS index_hint FROM (
  SELECT *, concat_ws(' ', lag(text, 2) OVER w, lag(text, 1) OVER w) AS before_, concat_ws(' ', lead(text, 1) OVER w, lead(text, 2) OVER w) AS after_, max(idx) OVER (PARTITION BY uri) AS last
  FROM ({_SEGMENTS}) WINDOW w AS (PARTITION BY uri ORDER BY idx)) WHERE idx = greatest(0, least((uri % 6)::INT, last))"""
_add("e01_anchors", lambda s, d: anchors.created(_segments(s, d), _positions(s, d)), _ANCHORS)


def changed_segments(s: SparkSession, d: str) -> DataFrame:
    """The segments of a later version: a line inserted in front of some documents, lines cut or reworded in others."""
    rows = _segments(s, d)
    text = F.when((F.col("uri") % 5 == 1) & (F.length("text") > 60), F.regexp_replace(F.substring("text", 1, 50), r"\S*$", "")).when(F.col("uri") % 5 == 2, F.regexp_replace("text", r"^\S+ ", "Reworded ")).otherwise(F.col("text"))
    added = _read(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("uri"), F.lit(-1).alias("idx"), F.lit("A new first line.").alias("text"))
    all_ = rows.select("uri", "idx", text.alias("text")).unionByName(added)
    return all_.select("uri", (F.row_number().over(Window.partitionBy("uri").orderBy("idx")) - 1).alias("idx"), "text")


_add("j01_located", lambda s, d: anchors.located(anchors.created(_segments(s, d), _positions(s, d)).withColumn("rules_changed", F.col("uri") % 3 == 0), changed_segments(s, d)))
_add("e07_numbering", lambda s, d: _segments(s, d).where(F.length("text") > 40).select("uri", "idx", (F.row_number().over(Window.partitionBy("uri").orderBy("idx")) - 1).alias("n")), f"SELECT uri, idx, row_number() OVER (PARTITION BY uri ORDER BY idx) - 1 AS n FROM ({_SEGMENTS}) WHERE length(text) > 40")
_share = lambda: F.sum(F.greatest(F.lit(1), F.length("text")))
_add(
    "e08_timings",
    lambda s, d: _segments(s, d).select("uri", "idx", F.round(F.coalesce(_share().over(Window.partitionBy("uri").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / _share().over(Window.partitionBy("uri")) * 60, 6).alias("start")),
    f"SELECT uri, idx, round(coalesce(sum(greatest(1, length(text))) OVER (PARTITION BY uri ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(greatest(1, length(text))) OVER (PARTITION BY uri) * 60, 6) AS start FROM ({_SEGMENTS})",
)
_add("e05_tie_band", lambda s, d: _segments(s, d).withColumn("best", F.max(F.length("text")).over(Window.partitionBy("uri"))).where(F.length("text") >= F.col("best") - 5).select("uri", "idx"), f"SELECT uri, idx FROM (SELECT *, max(length(text)) OVER (PARTITION BY uri) AS best FROM ({_SEGMENTS})) WHERE length(text) >= best - 5")
_add("g03_first_lines", lambda s, d: history.first_seen(_segments(s, d).withColumn("k", F.lower("text")), F.col("k"), ["uri"], ["idx"]).select("uri", "idx"), f"SELECT uri, idx FROM (SELECT *, row_number() OVER (PARTITION BY uri, lower(text) ORDER BY idx) AS r FROM ({_SEGMENTS})) WHERE r = 1")
_add("d06_percentiles", lambda s, d: _segments(s, d).groupBy("uri").agg(F.percentile(F.length("text"), 0.25).alias("p25"), F.percentile(F.length("text"), 0.5).alias("median")), f"SELECT uri, quantile_cont(length(text), 0.25) AS p25, quantile_cont(length(text), 0.5) AS median FROM ({_SEGMENTS}) GROUP BY uri")
_add("d15_word_counts", lambda s, d: _read(s, d, "documents").groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0b]+"))).alias("n_words")), "SELECT source, sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')))::BIGINT AS n_words FROM documents GROUP BY source")
_add(
    "d12_rule_fingerprint",
    lambda s, d: _read(s, d, "nation").groupBy("n_regionkey").agg(F.sha1(F.array_join(F.sort_array(F.collect_list(F.concat("n_name", F.lit("="), F.col("n_nationkey").cast("string")))), "|").cast("binary")).alias("fingerprint")),
    "SELECT n_regionkey, sha1(string_agg(n_name || '=' || n_nationkey, '|' ORDER BY n_name || '=' || n_nationkey)) AS fingerprint FROM nation GROUP BY n_regionkey",
)
_add("d18_rollup", lambda s, d: _read(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")), "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n, grouping(l_returnflag, l_linestatus)::INT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")


def site_preferences(s, d):
    p = _read(s, d, "pages").select("page_id", I.host(F.col("url")).alias("host"))
    prefs = p.groupBy("host").agg((F.min("page_id") % 4 / 2 + 0.5).alias("speed")).where("speed > 0.5")
    return p.join(prefs, "host", "left").select("page_id", "host", F.coalesce("speed", F.lit(1.0)).alias("speed"))


_HOSTS = "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages"
_add("c06_site_preferences", site_preferences, f"WITH p AS ({_HOSTS}), f AS (SELECT host, min(page_id) % 4 / 2 + 0.5 AS speed FROM p GROUP BY host HAVING min(page_id) % 4 / 2 + 0.5 > 0.5) SELECT page_id, p.host, coalesce(speed, 1.0) AS speed FROM p LEFT JOIN f USING (host)")


def longest_domain(s, d):
    """The longest rule domain of each page's host, by exploded suffixes and an equi-join."""
    p = _read(s, d, "pages").select("page_id", I.host(F.col("url")).alias("host")).withColumn("labels", F.split("host", r"\."))
    suffix = F.transform(F.sequence(F.lit(1), F.greatest(F.size("labels") - 1, F.lit(1))), lambda i: F.array_join(F.slice("labels", i, 99), "."))
    rows = p.select("page_id", F.explode(suffix).alias("domain"))
    rule_rows = s.createDataFrame([("example.com",), ("m.ththth.example.net",), ("example.net",)], "domain string")
    hit = rows.join(F.broadcast(rule_rows), "domain").groupBy("page_id").agg(F.max_by("domain", F.length("domain")).alias("rule"))
    return p.select("page_id").join(hit, "page_id", "left")


_add("a29_site_rules", longest_domain, f"""WITH p AS ({_HOSTS}), r(domain) AS (VALUES ('example.com'), ('m.ththth.example.net'), ('example.net'))
  SELECT page_id, arg_max(domain, length(domain)) AS rule FROM p LEFT JOIN r ON p.host = domain OR ends_with(p.host, '.' || domain) GROUP BY page_id""")  # fmt: skip


def fresh_lines(s, d):
    """Lines not shown before, in the snapshots that an hour of documents makes; the first snapshot only primes."""
    rows = _segments(s, d).select(F.floor(F.col("uri") / 100).alias("watch"), F.pmod("uri", F.lit(100)).alias("seq"), "idx", "text").where("trim(text) <> ''")
    first = rows.groupBy("watch", F.lower("text")).agg(F.min(F.struct("seq", "idx", F.length("text").alias("n"))).alias("f"))
    return first.where("f.seq > 0 and f.n >= 24").select("watch", "f.seq", "f.idx")


_add("l06_window_watch", fresh_lines, f"""WITH r AS (SELECT uri // 100 AS watch, uri % 100 AS seq, idx, text FROM ({_SEGMENTS}) WHERE trim(text) <> '')
  SELECT watch, seq, idx FROM (SELECT *, row_number() OVER (PARTITION BY watch, lower(text) ORDER BY seq, idx) AS n FROM r) WHERE n = 1 AND seq > 0 AND length(text) >= 24""")  # fmt: skip
_by_lang = lambda s, d: _read(s, d, "documents").select("lang", F.col("doc_id").alias("uri"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
_add(
    "c11_unseen",
    lambda s, d: _by_lang(s, d).where("lang <> 'en'").join(_by_lang(s, d).where("lang = 'en'").select(F.lower("text").alias("seen")), F.lower("text") == F.col("seen"), "left_anti").select("uri", "idx"),
    f"WITH r AS (SELECT s.*, d.lang FROM ({_SEGMENTS}) s JOIN documents d ON d.doc_id = s.uri) SELECT uri, idx FROM r WHERE lang <> 'en' AND lower(text) NOT IN (SELECT lower(text) FROM r WHERE lang = 'en')",
)
_add(
    "l09_clipboard",
    lambda s, d: _read(s, d, "events").withColumn("last", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("last is not null and last <> event_type").select("event_id"),
    "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS NOT NULL AND last <> event_type",
)
_add(
    "l11_growth_bursts",
    lambda s, d: watch.growth_bursts(_read(s, d, "events").select(F.col("user_id").alias("page"), F.length("props").cast("long").alias("n_chars"), F.col("ts").cast("timestamp").alias("ts")), "30 minutes", 20).drop("ts"),
    """WITH g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
        SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
      SELECT user_id AS page, sum(length(props))::BIGINT AS n_chars FROM g GROUP BY user_id, burst HAVING sum(length(props)) >= 20""",
)
_add("l14_saved_positions", lambda s, d: reading_events(s, d).where("last_index % 10 = 0").select("event_id", "uri"), f"SELECT event_id, uri FROM ({_EVENTS}) WHERE last_index % 10 = 0")
_add("l18_windows", lambda s, d: watch.event_counts(_read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", F.col("count").alias("n")), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")


def as_of(s, d):
    """Each order with the customer's order before it: an as-of join as a window, without a range join."""
    o = _read(s, d, "orders")
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", F.lag("o_orderkey").over(before).alias("before"))


_add("c20_as_of", as_of, "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
_add("c20_joins", lambda s, d: _read(s, d, "orders").join(_read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total")), "SELECT n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_add("e15_ranks", lambda s, d: _read(s, d, "customer").select("c_custkey", F.rank().over(w := Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))).alias("rank"), F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("quarter")), "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rank, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS quarter FROM customer")
_add("g08_sets", lambda s, d: _read(s, d, "orders").select(F.col("o_custkey").alias("k")).intersect(_read(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))).exceptAll(_read(s, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("k"))), "(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey = 3")


def rule_frames(s, d):
    n = _read(s, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("match"), F.lit("built in").alias("say"))
    u = _read(s, d, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("match"), F.lit("mine").alias("say"))
    return n, u.unionByName(s.createDataFrame([(100, "Own", "new")], "pos int, match string, say string"))


_add("c07_merged_rules", lambda s, d: history.merged_rules(*rule_frames(s, d)).select("match", "say"), "SELECT CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS match, CASE WHEN n_nationkey % 4 = 0 THEN 'mine' ELSE 'built in' END AS say FROM nation UNION ALL SELECT 'Own', 'new'")
_add("g07_seeded_rules", lambda s, d: history.seeded(*reversed(rule_frames(s, d))).select("match", "say"), "SELECT CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS match, CASE WHEN n_nationkey % 4 = 0 THEN 'mine' ELSE 'built in' END AS say FROM nation UNION ALL SELECT 'Own', 'new'")
