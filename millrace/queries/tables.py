"""The search engine's tables derived from the standard ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import TOKEN


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    return table


#: SQL of crc32 over a text's UTF-8 bytes, for engines that lack it
CRC32 = "xor(list_reduce(list_transform(range(0, strlen({0}) + 1), lambda i: case when i = 0 then 4294967295 else ('0x' || substr(hex(encode({0})), (2 * i - 1)::int, 2))::bigint end), lambda a, b: xor(a >> 8, " + str(_crc_table()) + "[((xor(a, b) & 255) + 1)::int])), 4294967295)"


def docs(spark, sf_dir: str) -> DataFrame:
    """documents as a collection with access lists: a source's own name, Everyone for every third, a language denied."""
    d = read(spark, sf_dir, "documents")
    allow = F.when(F.col("doc_id") % 3 == 0, F.array("source", F.lit("Everyone"))).otherwise(F.array("source"))
    deny = F.when(F.col("doc_id") % 7 == 0, F.array("lang")).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", "text", "lang", F.col("source").alias("collection"), F.col("n_chars").alias("rank"), allow.alias("acl_allow"), deny.alias("acl_denied"))


DOCS = """docs as (select doc_id, text, lang, source as collection, n_chars as rank, case when doc_id % 3 = 0 then [source, 'Everyone'] else [source] end as acl_allow,
    case when doc_id % 7 = 0 then [lang] else []::varchar[] end as acl_denied from documents)"""
PATTERN = "'" + TOKEN.replace("'", "''") + "'"
WORDS = f"words as (select doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), {PATTERN}) as w from documents)"
TOKENS = f"{WORDS}, tok as (select doc_id, lang, source, unnest(w) as term, generate_subscripts(w, 1) - 1 as pos from words)"


def edges(spark, sf_dir: str) -> DataFrame:
    """src, dst, link: a page's links, each leading to the page that a hash of its text names."""
    from millrace.functions.urls import links

    pages = read(spark, sf_dir, "pages")
    n = pages.agg(F.count("*").alias("n"))
    rows = pages.select(F.col("page_id").alias("src"), F.explode(links(F.col("html"))).alias("link"))
    # one row, the number of pages
    n = F.lit(n.first()["n"])
    return rows.select("src", (F.conv(F.substring(F.md5("link"), 1, 8), 16, 10).cast("long") % n).alias("dst"), "link")


LINKS = """'<a[^>]+href="([^"#]+)'"""
EDGES = f"""edges as (select page_id as src, (('0x' || substr(md5(link), 1, 8))::bigint % (select count(*) from pages)) as dst, link from (select page_id, unnest(regexp_extract_all(html, {LINKS}, 1)) as link from pages))"""


def log(spark, sf_dir: str) -> DataFrame:
    """events as a search log: time, query, user, seconds, hits."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("tid"), F.col("event_type").alias("query"), F.col("user_id").alias("user"), F.col("value").alias("seconds"), F.get_json_object("props", "$.k").cast("long").alias("hits"))


LOG = "log as (select event_id as id, ts as tid, event_type as query, user_id as user_, value as seconds, (props ->> '$.k')::bigint as hits from events)"
