"""Parsers, archives, pages and streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from tessera.sources import captions, files, sinks, web
from tessera.streaming import events as S


def parsed(spark, *named):
    rows = spark.createDataFrame([(f"/in/{n}", bytearray(d)) for n, d in named], "path string, content binary")
    return {r.member: r for r in files.parse(rows, {"image": lambda n, d: "seen"}).collect()}


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in members.items():
            z.writestr(n.replace("__", "/").replace("_dot_", "."), d)
    return out.getvalue()


def test_formats(spark):
    docx = zipped(word__document_dot_xml="<w:document xmlns:w='u'><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>")
    xlsx = zipped(xl__workbook_dot_xml="<w><sheets><sheet name='S'/></sheets></w>", xl__sharedStrings_dot_xml="<s><si><t>hi</t></si></s>", xl__worksheets__sheet1_dot_xml="<w><row><c t='s'><v>0</v></c><c><v>4</v></c></row></w>")
    pptx = zipped(ppt__slides__slide1_dot_xml="<a><p><t>title</t></p></a>")
    got = parsed(
        spark, ("a.csv", b"name, score\nalice ,9\n"), ("b.jsonl", b'{"a":1}\nbad\n'), ("c.xml", b"<x> <y>t</y></x>"), ("d.html", b"<p>a</p><script>no</script><p>b</p>"), ("e.srt", b"1\n00:00:01,000 --> 00:00:02,000\nhello\n"),
        ("f.docx", docx), ("g.xlsx", xlsx), ("h.pptx", pptx), ("i.png", b"\x89"), ("j.pdf", b"%PDF"), ("k.json", b"{"), ("l.txt", "é".encode("latin-1")),
    )
    assert got["a.csv"].text == "name, score\nalice, 9"
    assert got["b.jsonl"].text == '{"a": 1}\nbad'
    assert got["c.xml"].text == "t"
    assert got["d.html"].text == "a\nb"
    assert got["e.srt"].text == "hello"
    assert got["f.docx"].text == "one\ntwo"
    assert got["g.xlsx"].text == "# Sheet: S\nhi, 4"
    assert got["h.pptx"].text == "# Slide 1\ntitle"
    assert got["i.png"].text == "seen"
    assert got["j.pdf"].status == "error" and got["k.json"].status == "error"
    assert got["l.txt"].text == "é"


def test_archives(spark):
    inner = zipped(a_dot_txt="x")
    got = parsed(spark, ("z.zip", zipped(one_dot_txt="1", empty_dot_txt="", two_dot_bin="2", in_dot_zip=inner)))
    assert {k: r.text for k, r in got.items()} == {"one.txt": "1"}
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(101):
            z.writestr(f"{i}.txt", "x")
    got = parsed(spark, ("m.zip", many.getvalue()))
    assert sum(r.status == "success" for r in got.values()) == 100 and sum(r.status == "error" for r in got.values()) == 1


def test_vtt_needs_header(spark):
    docs = spark.createDataFrame([(1, "WEBVTT\n\n1\n00:01.000 --> 00:02.500\nAnn: hello\n\n00:03.000 --> 00:04.000\nplain"), (2, "00:01.000 --> 00:02.500\nx")], "doc_id long, text string")
    got = [(r.doc_id, r.idx, r.start_s, r.end_s, r.speaker, r.text) for r in captions.parse(docs).orderBy("idx").collect()]
    assert got == [(1, 1, 1.0, 2.5, "Ann", "hello"), (1, 2, 3.0, 4.0, None, "plain")]


def test_crawl_stays_on_host(spark):
    body = "word " * 20
    pages = spark.createDataFrame([(1, "http://a.b/", f'<a class="x" href="/two">t</a><a href="http://c.d/">o</a>{body}'), (2, "http://a.b/two", f'<a href="/three#f">t</a>{body}'), (3, "http://a.b/three", body), (4, "http://c.d/", body)], "page_id long, url string, html string")
    start = pages.where("page_id = 1").select("url")
    assert sorted((r.page_id, r.depth) for r in web.crawl(pages, start).collect()) == [(1, 0), (2, 1)]
    assert sorted(r.page_id for r in web.crawl(pages, start, 2).collect()) == [1, 2, 3]


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, "plain")], "i int, t string")
    sinks.write_csv(df, str(tmp_path / "out"), one_file=True)
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text.startswith("i,t\n1,") and text.endswith("2,plain\n")
    sinks.write_csv(df, str(tmp_path / "gz"), gzip=True)
    assert list((tmp_path / "gz").glob("*.csv.gz"))


def test_fetch_gives_errors_as_rows(spark):
    def get(i):
        if i == "bad":
            raise ValueError("no")
        return i.encode()

    got = {r.id: r for r in sinks.fetch(spark, spark.createDataFrame([("a",), ("bad",)], "id string"), get).collect()}
    assert bytes(got["a"].content) == b"a" and got["bad"].error == "ValueError: no"
    assert [x["k"] for x in sinks.pages_of(lambda s: ([{"k": s}], s < 2))] == [0, 1, 2]


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, "ab"[i % 2], i * 40) for i in range(40)], "event_id long, user_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    rows = rows.union(rows.limit(5))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: S.files(spark, str(tmp_path / "in"), rows)
    once = S.run_available(S.once(stream(), ["event_id"]), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert once.count() == S.once(rows, ["event_id"]).count() == 40
    out = []
    q = S.latest_status(stream()).writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).foreachBatch(lambda d, i: out.append(sorted(map(tuple, d.collect())))).start()
    q.awaitTermination()
    assert out[-1] == sorted(map(tuple, S.latest_status(rows).collect()))


def test_deltas_resume_after_last_turn(spark, tmp_path):
    src = tmp_path / "in"
    first = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "conv_id long, turn long, text string")
    first.write.parquet(str(src))
    run = lambda: S.run_available(S.deltas(S.files(spark, str(src), first)), str(tmp_path / "out"), str(tmp_path / "c"))
    assert run().count() == 2
    spark.createDataFrame([(1, 1, "b"), (1, 2, "c")], first.schema).write.mode("append").parquet(str(src))
    assert sorted(r.text for r in run().collect()) == ["a", "b", "c"]
    assert json.loads(S.as_event("done", doc=1)) == {"type": "done", "doc": 1}
