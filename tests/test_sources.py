import json

from pyspark.sql import functions as F

from lexspan.operators import report
from lexspan.sources import pages, requests, sinks


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>small</p>")
    (tmp_path / "b.html").write_bytes(b"x" * 200)
    (tmp_path / "t.txt").write_text("one\ntwo")
    (tmp_path / "s.json").write_text('"just text"')
    (tmp_path / "o.json").write_text('{"content": "inside"}')
    assert [r.length for r in pages.read_pages(spark, str(tmp_path), largest=100).collect()] == [12]
    assert pages.read_texts(spark, str(tmp_path)).first().text == "one\ntwo"
    assert {r.text for r in pages.read_json_texts(spark, str(tmp_path)).collect()} == {"just text", "inside"}


def test_decodings(spark):
    greek = "Απόφαση του δικαστηρίου"
    rows = [(1, greek.encode("cp1253")), (2, greek.encode("utf-8")), (3, b"plain"), (4, None), (5, b"")]
    got = {r.k: (r.charset, r.penalty, r.text) for r in pages.best_decoding(spark.createDataFrame(rows, "k int, b binary"), ["k"], "b", ("utf-8", "windows-1253")).collect()}
    assert got == {1: ("windows-1253", 0, greek), 2: ("utf-8", 0, greek), 3: ("utf-8", 0, "plain"), 4: (None, None, None), 5: ("utf-8", 0, "")}


def test_hosts_and_charsets(spark):
    df = spark.createDataFrame([("https://a.example/x",), ("http://a.example/x",), ("https://evil.example/a.example",), ("not a url",), (None,)], "u string")
    assert [r[0] for r in df.select(pages.allowed_host(F.col("u"), ["a.example"])).collect()] == [True, False, False, False, False]
    c = spark.createDataFrame([("WINDOWS-1253", ""), (None, '<meta charset="greek">'), (" ", "x"), ("latin1", "")], "h string, t string")
    assert [r[0] for r in c.select(pages.declared_charset(F.col("h"), F.col("t"))).collect()] == ["windows-1253", "iso-8859-7", "utf-8", "windows-1252"]


def test_links(spark):
    html = '<a href="/b?hl=x&p=1">1</a><a HREF=c.html>2</a><a href="https://other.example/z">3</a><a href="/b?hl=y&p=1">again</a><a href="//a.example/d">4</a>'
    df = spark.createDataFrame([(1, "https://a.example/dir/i.html", html), (2, "https://a.example/", None)], "k int, u string, h string")
    got = [(r.position, r.link) for r in pages.links(df, "k", "u", "h", ["a.example"], drop_parameter="hl").orderBy("position").collect()]
    assert got == [(1, "https://a.example/b&p=1"), (2, "https://a.example/dir/c.html"), (3, "https://a.example/d")]
    rows = pages.links(df, "k", "u", "h", ["a.example"], wanted="/19\\d\\d/", fallback="/dir/").collect()
    assert [r.link for r in rows] == ["https://a.example/dir/c.html"]


def test_bodies(spark):
    rows = [(1, '{"a": 1}'), (2, "[1]"), (3, "{"), (4, None), (5, json.dumps({"a": "x" * 100})), (6, '{"a": "no number"}')]
    got = {r.k: (r.error, r.parsed.a if r.parsed else None) for r in requests.parse_bodies(spark.createDataFrame(rows, "k int, b string"), "b", "a int", 60).collect()}
    assert got == {1: (None, 1), 2: ("not_object", None), 3: ("not_json", None), 4: ("not_json", None), 5: ("too_large", None), 6: (None, None)}


def test_order_statistics(spark):
    import random

    sizes = [random.Random(1).randrange(50) for _ in range(333)]
    got = report.length_diagnostics(spark.createDataFrame([("k", s) for s in sizes], "k string, n int"), "k", F.col("n"), 45).first()
    s = sorted(sizes)
    assert (got.median, got.p90, got.p99, got.maximum) == (s[int(332 * 0.5)], s[int(332 * 0.9)], s[int(332 * 0.99)], s[-1])
    assert got.n_at_max == sum(x >= 45 for x in s) and got.passage_chars == sum(s)


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "position int, line string")
    sinks.write_report(lines, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).first().value == "a\nb\nc\n"
    counted, seen = sinks.counted(spark.createDataFrame([('{"a": 1}',), ('{"a": 2}',)], "record string"), "audit", longest=F.max(F.length("record")))
    sinks.write_records(counted, str(tmp_path / "j"))
    assert sorted(r.a for r in spark.read.json(str(tmp_path / "j")).collect()) == [1, 2] and seen.get == {"rows": 2, "longest": 8}
