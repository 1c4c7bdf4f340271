import struct

import pytest
from pyspark.sql import functions as F

from millrace.operators import admin, records
from millrace.sources import media


def test_image_sizes():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 20)
    assert media.image_size(png) == ("png", 640, 480) and media.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("gif", 3, 4)
    assert media.image_size(jpg) == ("jpg", 20, 30) and media.image_size(b"BM" + bytes(16) + struct.pack("<ii", 5, -6)) == ("bmp", 5, 6)
    assert media.image_size(b"") is None and media.image_size(b"\xff\xd8\xff") is None


def test_sound_tags():
    frame = b"TIT2" + struct.pack(">I", 6) + b"\0\0" + b"\3Title"
    v2 = b"ID3\3\0\0" + bytes([0, 0, 0, len(frame) + 4]) + frame + bytes(10)
    v1 = b"x" * 50 + b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(30) + b"1999" + bytes(31)
    assert media.sound_tags(v2) == {"title": "Title"} and media.sound_tags(v1) == {"title": "Song", "artist": "Band", "year": "1999"}
    assert media.sound_tags(b"") == {}


def test_described(spark):
    d = spark.createDataFrame([("a.gif", bytearray(b"GIF89a\3\0\4\0")), ("b", bytearray(b"none"))], "path string, content binary")
    assert {r.path: r.attributes for r in media.described(d).collect()} == {"a.gif": {"format": "gif", "width": "3", "height": "4"}, "b": {}}


@pytest.mark.parametrize("how, level", [(("127.0.0.1",), "full"), (("10.0.0.9",), "none"), (("10.0.0.9", "k"), "full"), (("10.0.0.9", "x", "bob"), "limited")])
def test_access_level(how, level):
    assert records.access_level(*how, keys=["k"]) == level
    assert records.access_level("10.0.0.9", anonymous=True) == "limited"


def test_cached_pages(spark):
    d = spark.createDataFrame([(7, 1000)], "doc_id long, time long").withColumn("s", records.page_signature("x", F.col("doc_id"), F.col("time")))
    ok = lambda secret, now: d.select(records.may_fetch(secret, F.col("doc_id"), F.col("time"), F.col("s"), F.lit(now))).first()[0]
    assert ok("x", 4600) and not ok("x", 4601) and not ok("y", 1000)


def test_sids(spark):
    raw = bytes([1, 2, 0, 0, 0, 0, 0, 5]) + struct.pack("<II", 32, 544)
    d = spark.createDataFrame([(bytearray(raw),), (bytearray(raw[:-1]),)], "b binary")
    assert [r[0] for r in d.select(records.sid_text(F.col("b"))).collect()] == ["S-1-5-32-544", None]


def test_settings(spark, tmp_path):
    d = spark.createDataFrame([("a", 1)], "name string, value long")
    records.export_settings({"config": d}, str(tmp_path))
    assert records.import_settings(spark, str(tmp_path), {"config": "name string, value long"})["config"].collect() == d.collect()


def test_user_system(spark):
    d = records.user_system(spark, lambda: ["a", "b"], lambda u: [u, "all"])
    assert sorted(map(tuple, d.collect())) == [("a", "a"), ("a", "all"), ("b", "all"), ("b", "b")]


def test_languages(spark):
    d = spark.createDataFrame([("ENG", 1), ("swe", 11), ("xxx", 0), (None, 12)], "c string, n int")
    got = d.select(admin.language_number(F.col("c")), admin.language_code(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(1, "ENG"), (11, "SWE"), (0, None), (0, None)]
    assert [r[0] for r in spark.createDataFrame([("nb",), ("en_us",), ("de",)], "c string").select(admin.interface_language(F.col("c"))).collect()] == ["NBO", "ENG", "DE"]
