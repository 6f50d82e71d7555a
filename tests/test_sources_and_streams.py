import io
import zipfile

from pyspark.sql import functions as F

from loomtext.sources import files, html
from loomtext.streaming import watch


def run(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_changed_captures(spark, tmp_path):
    page = ["First line of text here.", "Second line of text here.", "Third line of text here.", "Fourth line of text."]
    rows = [(1, 0, "\n".join(page[:3])), (1, 1, "\n".join(page[:3]) + "!"), (1, 2, "\n".join(page[1:])), (1, 3, "Something else altogether now."), (2, 0, "short")]
    got = run(watch.changed_captures(source(spark, tmp_path, rows, "watch long, seq long, text string")), "captures")
    assert sorted((r.watch, r.seq, r.text, r.continues) for r in got) == [(1, 0, rows[0][2], False), (1, 2, page[3], True), (1, 3, rows[3][2], False)]


def test_changed_values(spark, tmp_path):
    rows = [(1, 0, "was there before"), (1, 1, "was there before"), (1, 2, "a new value"), (1, 3, "tiny"), (1, 4, "another value")]
    got = run(watch.changed_values(source(spark, tmp_path, rows, "watch long, seq long, text string")), "values")
    assert sorted(r.seq for r in got) == [2, 4]


def test_fresh_lines_and_turns(spark, tmp_path):
    rows = [(1, 0, "The first line that was there.", 1), (1, 1, "THE FIRST line that was there.", 2), (1, 1, "A second line that is fresh.", 2), (1, 1, "short", 2)]
    stream = source(spark, tmp_path, rows, "watch long, seq long, line string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.line for r in run(watch.fresh_lines(stream), "lines")] == ["A second line that is fresh."]
    lines = [('{"uuid": "a", "type": "assistant", "text": "hi"}', 1), ('{"uuid": "a", "type": "assistant", "text": "hi"}', 2), ("{broken", 3), ('{"uuid": "b", "type": "user", "text": "x"}', 4)]
    (tmp_path / "b").mkdir()
    turns = source(spark, tmp_path / "b", lines, "value string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.uuid for r in run(watch.new_turns(turns), "turns")] == ["a"]


def test_growth_bursts(spark):
    rows = [(1, 100, 0.0), (1, 50, 0.3), (1, 60, 2.0), (2, 500, 1.0)]
    frame = spark.createDataFrame(rows, "page long, n_chars long, s double").withColumn("ts", F.expr("timestamp_millis(cast(s * 1000 as bigint))"))
    assert sorted((r.page, r.n_chars) for r in watch.growth_bursts(frame).collect()) == [(1, 150), (2, 500)]


def test_article(spark):
    long_ = "A sentence that is long enough to be an article's own text. " * 3
    page = f"<html><body><nav><a href=x>Home</a></nav><div class='sidebar'><p>{long_}<a>x</a></p></div><div id=content><h1>Title</h1><p>{long_}<b>bold<p>{long_}</b><script>var a='</p>'</script><pre>code</pre></div><a>Next page</a></body></html>"
    found = html.nodes(spark.createDataFrame([(1, page), (2, None), (3, "<p>x")], "page_id long, html string"))
    got = html.blocks(found, html.article_roots(found)).orderBy("block").collect()
    assert [(r.role, r.text[:10]) for r in got if r.page_id == 1] == [("heading", "Title"), ("paragraph", long_[:10]), ("paragraph", long_[:10]), ("code", "code")]
    own = spark.createDataFrame([(1, "https://x.test/a?page=1")], "page_id long, url string")
    assert html.next_pages(found, own).count() == 1
    assert {r.role for r in html.blocks(found, html.article_roots(found), "skip").collect()} == {"heading", "paragraph"}


def test_files(spark, tmp_path):
    def archive(name, members):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
        (tmp_path / name).write_bytes(data.getvalue())

    archive("a.epub", {
        "META-INF/container.xml": "<container xmlns='u'><rootfiles><rootfile full-path='o/p.opf'/></rootfiles></container>",
        "o/p.opf": "<package xmlns='u'><manifest><item id='b' href='b.html'/><item id='a' href='a%20x.html'/></manifest><spine><itemref idref='a'/><itemref idref='gone'/><itemref idref='b'/></spine></package>",
        "o/a x.html": "<h1>One</h1><p>first &amp; text</p><script>no</script>", "o/b.html": "<p>second</p>",
    })
    w = "xmlns:w='w'"
    archive("d.docx", {"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    (tmp_path / "u.txt").write_bytes("cafés".encode("cp1252"))
    (tmp_path / "x.epub").write_bytes(b"broken")
    (tmp_path / "x.bin").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read(spark, str(tmp_path)).collect()}
    assert got == {"a.epub": ("One\nfirst & text\n\nsecond", None), "d.docx": ("Hello\n\na, b", None), "u.txt": ("cafés", None), "x.epub": (None, "Cannot read")}
