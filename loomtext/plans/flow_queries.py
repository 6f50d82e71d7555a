"""Alignment, growing files, held passages and pages read on: inputs are made from the tables, so the results are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import fingerprint, segment
from loomtext.operators import align, follow, ranges
from loomtext.sources import html, tables
from loomtext.streaming import tail

QUERIES = {}
ORACLE_SQL = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def aligned(s: SparkSession, d: str) -> DataFrame:
    """Each text's words, told apart by their places, are the screen; ten words a sentence are spoken, without the third
    and with another word behind the sixth. The place of the first and the last word that each sentence covers."""
    docs = tables.spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r\f\x0b]+"), 0)
    plain = F.transform(words, lambda w, i: F.concat(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""), F.lit("x"), i.cast("string")))
    rows = docs.select("doc_id", plain.alias("words")).where(F.size("words") > 0)

    def sentence(k):
        ten = F.slice("words", k * 10 + 1, 10)
        return F.concat_ws(" ", F.slice(ten, 1, 2), F.slice(ten, 4, 3), F.when(F.size(ten) > 6, F.lit("percent")), F.slice(ten, 7, 4))

    said = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 10).cast("int")), sentence)
    runs = rows.select("doc_id", F.posexplode(align.words_for(F.col("words"), said)).alias("idx", "run"))
    return runs.select("doc_id", "idx", F.array_min("run").alias("first"), F.array_max("run").alias("last"), F.size("run").alias("n"))


_add("c17_aligned", aligned, r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+')) AS total FROM documents),
  k AS (SELECT doc_id, total, unnest(range((total + 9) // 10))::INT AS idx FROM w WHERE total > 0),
  n AS (SELECT doc_id, idx, least(10, total - 10 * idx)::INT AS n FROM k)
  SELECT doc_id, idx, 10 * idx AS first, 10 * idx + n - 1 - (n = 3)::INT AS last, n - (n = 3)::INT AS n FROM n""")  # fmt: skip


def polls(s: SparkSession, d: str) -> DataFrame:
    """Each conversation as a file that grows by two turns a poll; two turns of a role share a uuid, blank ones are written
    as well. One watch a conversation; every poll begins one turn earlier than it has to, with the second turn seen last."""
    t = s.read.parquet(f"{d}/conversations.parquet").where("conv_id is not null and turn is not null")
    uuid = F.concat_ws("-", "conv_id", "role", F.floor(F.col("turn") / 4).cast("string"))
    line = F.concat(F.to_json(F.struct(F.col("role").alias("type"), uuid.alias("uuid"), F.struct(F.col("text").alias("content")).alias("message"))), F.lit("\n"))
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.select("conv_id", "turn", line.alias("line")).withColumn("end", F.sum(F.octet_length("line")).over(by))
    rows = rows.withColumns({"begin": F.col("end") - F.octet_length("line"), "poll": F.floor(F.col("turn") / 2)})
    again = rows.where("turn % 2 = 1").withColumn("poll", F.col("poll") + 1)
    ends = rows.groupBy("conv_id", "poll").agg(F.max("end").alias("size"))
    parts = rows.unionByName(again).groupBy("conv_id", "poll").agg(F.min("begin").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "").alias("data"))
    looks = parts.join(ends, ["conv_id", "poll"])
    return looks.select(F.col("conv_id").alias("watch"), F.col("poll").alias("seq"), F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("path"), F.lit(0).alias("typed"), "size", "at", F.col("data").cast("binary").alias("data"))


_add("l01_tailed", lambda s, d: tail.followed(polls(s, d)).select("watch", "seq", "uuid", F.md5(F.col("text").cast("binary")).alias("digest")), """WITH t AS (
    SELECT conv_id AS watch, turn // 2 AS seq, turn, text, concat_ws('-', conv_id, role, turn // 4) AS uuid,
      min(turn // 2) OVER (PARTITION BY conv_id) AS joined FROM conversations WHERE role = 'assistant' OR turn IS NOT NULL),
  a AS (SELECT *, row_number() OVER (PARTITION BY watch, uuid ORDER BY turn) AS again FROM t WHERE seq > joined AND contains(uuid, 'assistant'))
  SELECT watch, seq, uuid, md5(text) AS digest FROM a WHERE again = 1 AND trim(text) <> ''""")  # fmt: skip


def watched(s: SparkSession, d: str) -> DataFrame:
    """Events of users as passages of windows: errors start playing, purchases and views stop it, every third row has a text."""
    e = s.read.parquet(f"{d}/events.parquet")
    playing = F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "view", False)
    return e.select(F.col("user_id").alias("watch"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("text"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("W"), F.col("event_id").cast("string"))).alias("title"), playing.alias("playing"))


_add("l10_flushed", lambda s, d: tail.flushed(watched(s, d)), """WITH e AS (
    SELECT user_id AS watch, event_id AS seq, CASE WHEN event_id % 3 <> 0 THEN props END AS text, CASE WHEN event_id % 5 = 0 THEN 'W' || event_id END AS title,
      CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 0 END AS playing FROM events),
  f AS (SELECT *, coalesce(last_value(playing IGNORE NULLS) OVER w, 0) AS on_, last_value(title IGNORE NULLS) OVER w AS heard FROM e WINDOW w AS (PARTITION BY watch ORDER BY seq)),
  idle AS (SELECT watch, seq, heard FROM f WHERE on_ = 0)
  SELECT f.watch, idle.seq, string_agg(f.text, chr(10) || chr(10) ORDER BY f.seq) AS text, coalesce(any_value(idle.heard), 'Window') AS title
  FROM f ASOF JOIN idle ON f.watch = idle.watch AND f.seq <= idle.seq WHERE f.text IS NOT NULL GROUP BY f.watch, idle.seq""")  # fmt: skip


def series(s: SparkSession, d: str) -> DataFrame:
    """Pages that name the page with the next id as their next one; some lead back, some name it by a word alone."""
    p, k = s.read.parquet(f"{d}/pages.parquet"), F.col("page_id")
    to = F.concat(F.lit("/p"), F.when(k % 50 == 49, k - 7).otherwise(k + 1).cast("string"))
    link = F.when(k % 31 == 30, F.concat(F.lit('<a href="'), to, F.lit('">next</a>'))).otherwise(F.concat(F.lit('<link rel="next" href="'), to, F.lit('#top">')))
    return p.select("page_id", F.concat(F.lit("https://series.test/p"), k.cast("string")).alias("url"), F.concat("html", link).alias("html"))


def read_on(s: SparkSession, d: str) -> DataFrame:
    """Every tenth page begins a session."""
    pages = series(s, d)
    found = html.next_pages(html.nodes(pages), pages)
    links = pages.select("page_id", "url").join(found.select("page_id", "next_url", "confirm"), "page_id")
    return follow.read_on(pages.where("page_id % 10 = 0").select(F.col("page_id").alias("session"), "url"), links)


_add("l15_read_on", read_on, """WITH RECURSIVE n AS (SELECT page_id, CASE WHEN page_id % 31 <> 30 THEN CASE WHEN page_id % 50 = 49 THEN page_id - 7 ELSE page_id + 1 END END AS next FROM pages),
  r AS (SELECT page_id AS session, 0::BIGINT AS step, page_id AS page, [page_id] AS seen FROM pages WHERE page_id % 10 = 0
    UNION ALL SELECT r.session, r.step + 1, n.next, list_append(r.seen, n.next) FROM r JOIN n ON n.page_id = r.page WHERE n.next IS NOT NULL AND NOT list_contains(r.seen, n.next))
  SELECT session, step, 'https://series.test/p' || page AS url FROM r""")  # fmt: skip


def marked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each page behind a passage of its own, with ragged white space and a tag inside; its nodes, and that passage as root."""
    k = F.col("page_id")
    spaces = lambda n: F.repeat(F.lit(" "), n.cast("int"))
    head = F.concat(F.lit('<section id="case"><p>'), spaces(k % 4), F.lit("Page "), k.cast("string"), F.repeat(F.lit("\n"), (k % 3 + 1).cast("int")), F.lit("begins.<b> It</b>"), spaces(k % 3 + 1), F.lit("goes on.  </p></section>"))
    found = html.nodes(s.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(head, F.coalesce("html", F.lit(""))).alias("html")))
    roots = found.where("element_id = 'case'").groupBy("page_id").agg(F.min("node").alias("root"))
    return found, roots


def marked_ranges(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The passage's pieces, and the ranges of its sentences in them."""
    found, roots = marked(s, d)
    parts = ranges.pieces(found, roots)
    blocks = html.blocks(found, roots).select(F.struct("page_id", "block").alias("key"), "text")
    spans = segment.sentences_offsets(blocks, "key").select("key.page_id", "key.block", F.col("seg_idx").alias("idx"), "start", "end")
    return parts, ranges.node_ranges(spans, parts)


def ranged(s: SparkSession, d: str) -> DataFrame:
    """Sentences of the passage as raw texts and offsets in them."""
    parts, found = marked_ranges(s, d)
    raw = lambda n: parts.select("page_id", F.col("node").alias(f"{n}_node"), F.col("raw").alias(f"{n}_raw"))
    return found.join(raw("start"), ["page_id", "start_node"]).join(raw("end"), ["page_id", "end_node"]).select("page_id", "idx", "start_raw", "start_offset", "end_raw", "end_offset")


_PASSAGE = """SELECT page_id, (page_id % 4)::INT AS k, (page_id % 3 + 1)::INT AS m, length(page_id::VARCHAR)::INT AS l,
  repeat(' ', (page_id % 4)::INT) || 'Page ' || page_id || repeat(chr(10), (page_id % 3 + 1)::INT) || 'begins.' AS a, repeat(' ', (page_id % 3 + 1)::INT) || 'goes on.  ' AS c FROM pages"""
_add("i12_node_ranges", ranged, f"""SELECT page_id, 0::BIGINT AS idx, a AS start_raw, k AS start_offset, a AS end_raw, length(a)::INT AS end_offset FROM ({_PASSAGE})
  UNION ALL SELECT page_id, 1, ' It', 1, c, m + 8 FROM ({_PASSAGE})""")  # fmt: skip


def pointed(s: SparkSession, d: str) -> DataFrame:
    """Each piece of the passage is pointed at before its first and behind its last character."""
    parts, found = marked_ranges(s, d)
    ends = parts.select("page_id", "node", F.explode(F.array(F.lit(0), F.length("raw"))).alias("offset"), "start")
    points = ends.select(F.struct("page_id", "start", (F.col("offset") > 0).alias("behind")).alias("point"), "page_id", "node", "offset")
    at = ranges.sentences_at(found.withColumn("sentence", F.col("idx")), points)
    return at.select("point.page_id", F.col("point.start").alias("piece"), "point.behind", "sentence")


_add("i13_pointed", pointed, f"""WITH p AS ({_PASSAGE}) SELECT page_id, piece::BIGINT AS piece, behind, sentence::BIGINT AS sentence FROM (
  SELECT page_id, 0 AS piece, false AS behind, CASE WHEN k = 0 THEN 0 ELSE -1 END AS sentence FROM p UNION ALL SELECT page_id, 0, true, 0 FROM p
  UNION ALL SELECT page_id, 14 + l, false, -1 FROM p UNION ALL SELECT page_id, 14 + l, true, 1 FROM p
  UNION ALL SELECT page_id, 17 + l, false, 1 FROM p UNION ALL SELECT page_id, 17 + l, true, -1 FROM p)""")  # fmt: skip


def rule_files(s: SparkSession, d: str) -> DataFrame:
    """Events as rule files (event_type, name, fingerprint): odd ones are spelt another way, with notes, and mean the same."""
    e = s.read.parquet(f"{d}/events.parquet")
    number, props = F.col("event_id").cast("string"), F.col("props")
    plain = F.concat(F.lit('{"id":'), number, F.lit(',"props":'), F.regexp_replace(props, " ", ""), F.lit("}"))
    other = F.concat(F.lit('{ "_note" : {"x": 1},\n "props" : '), F.regexp_replace(props, r"\{", '{"_c": [1, 2], '), F.lit(', "id" : '), number, F.lit(".0 }"))
    return e.select("event_type", F.lpad(number, 12, "0").alias("name"), F.when(F.col("event_id") % 2 == 1, other).otherwise(plain).alias("rules")).select("event_type", "name", fingerprint.fingerprint(F.col("rules"))["fingerprint"].alias("fingerprint"))


_FILES = """SELECT event_type, lpad(event_id::VARCHAR, 12, '0') AS name, 'sha256:' || left(sha256('{"id":' || event_id || ',"props":' || replace(props, ' ', '') || '}'), 16) AS fingerprint FROM events"""
_add("d11_fingerprints", rule_files, _FILES)
_add("d11_combined", lambda s, d: fingerprint.combined(rule_files(s, d).withColumn("set", F.substring("name", 1, 9)), ["set", "event_type"]), f"SELECT left(name, 9) AS set, event_type, 'sha256:' || left(sha256(string_agg(name || ':' || fingerprint, chr(10) ORDER BY name)), 16) AS combined, count(*) AS n FROM ({_FILES}) GROUP BY ALL")
