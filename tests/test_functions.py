import io
import struct
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, ranks, text, urls
from millrace.operators import access, admin, crawling, dictionary, ingest, links
from millrace.plans import query
from millrace.sources import connector, formats, html
from millrace.streaming import flows

HOST = "example.com"


@pytest.mark.parametrize("url, expected", [
    (f"http://www.{HOST}/File.html", None), (f"http://sub.{HOST}/File.html", None), (f"http://www.{HOST}", f"http://www.{HOST}/"), (f"http://{HOST}/", f"http://www.{HOST}/"),
    (f"http://{HOST}", f"http://www.{HOST}/"), (f"http://{HOST}/File.html", f"http://www.{HOST}/File.html"), (f"http://www.{HOST}:80/", f"http://www.{HOST}/"),
    (f"http://www.{HOST}:80/File.html", f"http://www.{HOST}/File.html"), (f"http://www.{HOST}?a=b", f"http://www.{HOST}/?a=b"), ("HTTP://www.Example.coM/File.html", f"http://www.{HOST}/File.html"),
    (f"http://www.{HOST}/side.html#august", f"http://www.{HOST}/side.html"), (f"http://www.{HOST}index.html?a=b", f"http://www.{HOST}/index.html?a=b"),
])
def test_url_normalised(url, expected):
    assert urls.normalised(url) == (expected or url)


@pytest.mark.parametrize("url", [f"http://www.{HOST}/div/javascript:openchild('x');", f"http://www.{HOST}/div/JavaScript:openchild('x');", f"http://www.{HOST}/a/b/a/b/a/b/x", "nowhere", None, ""])
def test_url_rejected(url):
    assert urls.normalised(url) is None


def test_short_rank(spark):
    got = spark.createDataFrame([(r,) for r in (0, 1, 10, 100, 1000, 100000)], "r long").select(ranks.short_rank(F.col("r"))).collect()
    assert [r[0] for r in got] == [0, 0, 53, 106, 159, 255]


@pytest.mark.parametrize("a, b, d", [("ab", "ba", 1), ("kitten", "sitting", 3), ("ca", "abc", 3), ("", "abc", 3), ("same", "same", 0)])
def test_osa(a, b, d):
    assert dictionary.osa_distance(a, b) == d


@pytest.mark.parametrize("principals, allow, deny, seen", [(["u", "g"], ["g"], [], True), (["u", "g"], ["u"], ["g"], False), (["u", "g"], ["u"], ["u"], False), (["u", "g"], [], [], False), (["u"], ["u"], None, True), (["u"], None, [], False)])
def test_access(spark, principals, allow, deny, seen):
    d = spark.createDataFrame([(allow, deny)], "a array<string>, d array<string>")
    assert d.select(access.visible(principals, F.col("a"), F.col("d"))).first()[0] is seen


def test_windows_acl(spark):
    t = "REVISION:1,OWNER:x,GROUP:y,ACL:S-1-5-32-544:0/16/0x001f01ff,ACL:S-1-5-1:0/16/0x001200a9,ACL:S-1-5-2:1/0/0x00120089,ACL:S-1-5-3:0/0/0x00000001"
    a = spark.createDataFrame([(t,)], "t string").select(access.windows_acl(F.col("t")).alias("a")).first()["a"]
    assert (a["allow"], a["deny"]) == (["S-1-5-32-544", "S-1-5-1"], ["S-1-5-2"])


NOW = datetime(2014, 3, 17, 10, 30)


@pytest.mark.parametrize("phrase, start, end", [
    ("today", datetime(2014, 3, 17), datetime(2014, 3, 18)), ("yesterday", datetime(2014, 3, 16), datetime(2014, 3, 17)), ("last week", datetime(2014, 3, 10), datetime(2014, 3, 17)),
    ("this week", datetime(2014, 3, 17), datetime(2014, 3, 24)), ("last months", datetime(2014, 2, 1), datetime(2014, 3, 1)), ("this months", datetime(2014, 3, 1), datetime(2014, 4, 1)),
    ("this year", datetime(2014, 1, 1), datetime(2015, 1, 1)), ("last year", datetime(2013, 1, 1), datetime(2014, 1, 1)), ("two years plus", None, datetime(2013, 1, 1)), ("3 days ago", datetime(2014, 3, 14), datetime(2014, 3, 15)),
])
def test_date_range(phrase, start, end):
    assert dates.date_range(phrase, NOW) == (start, end)


def test_date_range_other():
    assert dates.date_range("1395059009", NOW)[1] is None
    with pytest.raises(ValueError):
        dates.date_range("someday", NOW)


def test_tokens(spark):
    t = "C++ and c# in 30% #hashtag don't O'Neil's ête_x 'q'"
    got = spark.createDataFrame([(t,), (None,)], "t string").select(text.tokens(F.col("t"))).collect()
    assert got[0][0] == ["c++", "and", "c#", "in", "30%", "#hashtag", "don't", "o'neil's", "ête_x", "q"] and got[1][0] == []
    assert list(query.words(t)) == got[0][0]


def test_query_strings():
    q = query.parse('The "to be or" -stop group:"Adobe PDF" lang:en sort:newest -"bad luck" "open end')
    assert q.phrases == [("the",), ("to", "be", "or"), ("open", "end")] and q.excluded == [("stop",), ("bad", "luck")]
    assert q.filters == {"group": ["Adobe PDF"], "lang": ["en"]} and q.order == "newest"
    assert query.with_attribute('fast attribute:"pages=8" search attribute:"creator=bob" solution') == "fast search solution"
    assert query.with_filter("a b", "lang", "en") == 'a b lang:"en"' and query.with_filter('a lang:"en" b', "lang", "en", remove=True) == "a b"


def test_attribute_filter(spark):
    d = spark.createDataFrame([(1, "the cat", {"k": ["v"]}), (2, "the dog", {"k": ["w"]})], "doc_id long, text string, attributes map<string,array<string>>")
    assert [r.doc_id for r in query.run_query(d, 'the attribute:"k=w"').collect()] == [2]


def test_highlight_and_snippet(spark):
    d = spark.createDataFrame([("the cat sat on the mat then left",)], "t string")
    assert d.select(text.highlight(F.col("t"), ["the"])).first()[0] == "<b>the</b> cat sat on <b>the</b> mat then left"
    assert d.select(text.snippet(F.col("t"), ["mat", "left"], 4)).first()[0] == "… the mat then left"


def test_minutes(spark):
    got = spark.createDataFrame([(m,) for m in (0, 1, 59, 60, 125, 1440, 3000)], "m long").select(ranks.minutes_text(F.col("m"))).collect()
    assert [r[0] for r in got] == ["now", "1 minute", "59 minutes", "1 hour", "2 hours", "1 day", "2 days"]


def test_html_units():
    page = '<title>A b</title><h1>Head</h1><p style="visibility:hidden">secret</p><a href="/x">go</a><p>text<script>no()</script>'
    got = [(u, f, t) for _, u, f, t in html.parse(page)]
    assert got == [("word", "title", "a"), ("word", "title", "b"), ("word", "h1", "head"), ("cloaked_word", "", "secret"), ("link", "", "/x"), ("linkword", "", "go"), ("word", "", "text")]
    assert html.parse(None) == [] and html.hidden("color:#fff;background:#fff") and not html.hidden("color:red")


def test_archives(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:t>One</w:t></w:p><w:p><w:t>two</w:t></w:p></w:d>')
        z.writestr("docProps/core.xml", '<c xmlns:d="d"><d:creator>Bob</d:creator></c>')
    d = spark.createDataFrame([("x", bytearray(b.getvalue())), ("bad", bytearray(b"no zip"))], "path string, content binary")
    names = {(r.path, r.name) for r in formats.exploded(d, "zip").collect()}
    assert ("x", "a.txt") in names and ("bad", None) in names
    office = {r.name: r.text for r in formats.exploded(d.where("path = 'x'"), "ooxml").collect()}
    assert office["creator"] == "Bob" and office["body"].split() == ["One", "two"]


def test_mail():
    raw = b"Subject: hi\r\nFrom: a@example.com\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\none\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>two</p>\r\n--b--\r\n"
    parts = formats.mail_parts(raw)
    assert parts[0][2] == "Subject: hi\nFrom: a@example.com" and [p[2].strip() for p in parts[1:]] == ["one", "<p>two</p>"]


def test_xml_batch(spark):
    add = "<add><documents><document><uri>u</uri><collection>c</collection><title>t</title><body>aGk=</body></document><document><uri>v</uri></document></documents></add>"
    gone = "<delete><collection>c</collection><uri>w</uri><uri>x</uri><document><uri>y</uri><collection>c</collection><title>t</title><body>aGk=</body></document></delete><delete><uri>z</uri></delete>"
    rest = "<close><collection>c</collection></close><create/><users><user>ann</user><user>bob</user></users><gcwhispers><collection>c</collection><notold>1</notold></gcwhispers><error>oops</error><unknown/>"
    rows = spark.createDataFrame([(f"<sddocument><version>1</version>{add}{gone}{rest}</sddocument>",), ("<broken",), (None,)], "xml string")
    got = [(r.op, r.collection, r.url, r.body, r.value, r.error is not None) for r in formats.read_batches(rows).collect()]
    assert got == [
        ("add", "c", "u", "hi", None, False), ("add", None, None, None, None, True), ("delete", "c", "w", None, None, False), ("delete", "c", "x", None, None, False), ("delete", None, None, None, None, True),
        ("close", "c", None, None, None, False), ("create", None, None, None, None, True), ("users", None, None, None, "ann", False), ("users", None, None, None, "bob", False), ("gcwhispers", "c", None, None, "notold=1", False),
        ("error", None, None, None, "oops", False), (None, None, None, None, None, True), (None, None, None, None, None, True),
    ]
    changes = [tuple(r) for r in formats.batch_changes(formats.read_batches(rows)).select("op", "url").collect()]
    assert changes == [("add", "u"), ("delete", "w"), ("delete", "x")]


def test_files_that_cannot_be_read(spark):
    """An unknown charset, an encrypted archive and one of an unknown method: no file ends the job."""
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    locked, odd = bytearray(b.getvalue()), bytearray(b.getvalue())
    for raw, at, mark in ((locked, 6, 1), (odd, 8, 99)):
        centre = raw.index(b"PK\1\2")
        raw[at] = raw[centre + at + 2] = mark
    d = spark.createDataFrame([("locked", locked), ("odd", odd), ("empty", bytearray()), ("null", None)], "path string, content binary")
    assert all(r.error and r.name is None for r in formats.exploded(d, "zip").collect()) and formats.exploded(d, "zip").count() == 4
    mail = b"Subject: x\r\nContent-Type: text/plain; charset=no-such\r\n\r\nbody"
    assert formats.mail_parts(mail)[1][2] == "body"
    with pytest.raises(ValueError, match="no such kind"):
        formats.exploded(d, "rar")


def test_packed_links(spark):
    raw = struct.pack(formats.PACKED, b"\1" * 20, b"http://a", b"text", b"\0\0", 7) + b"half"
    got = formats.found_links(spark.createDataFrame([(bytearray(raw),)], "content binary")).first()
    assert (got.url, got.anchor, got.src, got.sha1) == ("http://a", "text", 7, "01" * 20)


def test_connector(spark):
    spark.dataSource.register(connector.Connector)
    d = spark.read.format("millrace").option("crawler", "millrace.sources.connector:Numbers").option("parts", "3").load()
    assert d.count() == 9 and d.first().acl_allow == ["Everyone"]


def test_feed(spark):
    d = spark.createDataFrame([("a & b", "http://x", None)], "title string, url string, snippet string")
    assert "<title>a &amp; b</title>" in formats.feed(d, "q", 1, 1)


def test_redirects_and_ranks(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "src long, dst long")
    r = spark.createDataFrame([(1, 10), (2, 0), (3, 0)], "doc_id long, rank long")
    assert {x.doc_id: round(x.rank, 4) for x in links.link_rank(e, r, 1).collect()} == {1: 10.0, 2: 2.17, 3: 0.085}


def test_upsert_and_changes_stream(spark, tmp_path):
    schema = "collection string, url string, v long, ts timestamp, op string"
    base = spark.createDataFrame([("c", "u1", 1), ("c", "u2", 2)], "collection string, url string, v long")
    day = datetime(2024, 1, 1)
    src = tmp_path / "in"
    spark.createDataFrame([("c", "u1", 5, day, "add"), ("c", "u2", 0, day, "delete"), ("d", "u3", 3, day, "add")], schema).coalesce(1).write.json(str(src))
    stream = spark.readStream.schema(schema).json(str(src))
    q = flows.apply_changes(stream, str(tmp_path / "t"), lambda: base, str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/v0")).select("collection", "url", "v").collect())) == [("c", "u1", 5), ("d", "u3", 3)]


def test_progress_stream(spark, tmp_path):
    rows = [("j", datetime(2024, 1, 1, 0, k), v) for k, v in enumerate((3, 5, 4))]
    spark.createDataFrame(rows, "job string, ts timestamp, value long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("job string, ts timestamp, value long").parquet(str(tmp_path / "in"))
    q = flows.progress(s).writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.delta for r in spark.table("grown").collect()) == [-1, 2, 3]


def test_numbered_and_addresses(spark):
    d = spark.range(100).select((99 - F.col("id")).alias("v")).repartition(7)
    assert all(r.v == r.n for r in ingest.numbered(d, "v").collect())
    with pytest.raises(Exception, match="bad address range"):
        admin.addresses(spark.createDataFrame([(5, 1)], "first long, last long")).collect()


def test_next_run(spark):
    d = spark.createDataFrame([(100, 1, 200), (100, 0, 200), (0, 1, 9000)], "last long, rate long, now long")
    assert [r[0] for r in d.select(crawling.next_run(F.col("last"), F.col("rate"), F.col("now"))).collect()] == [3500, -1, 0]
