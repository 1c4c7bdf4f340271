"""What comes in: batches, archives, packed links, connectors, media, settings, addresses."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import ranks
from millrace.operators import records
from millrace.sources import connector, formats, media
from millrace.storage import shared_folder

from .tables import CRC32, read


def xml_batch(spark, sf):
    """Customers as batches: every one adds a document, some lack a title, and every fifth deletes the one before."""
    k = F.col("c_custkey")
    title = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("<title>"), "c_name", F.lit("</title>")))
    add = F.concat(F.lit("<add><documents><document><uri>http://c/"), k.cast("string"), F.lit("</uri><collection>"), "c_mktsegment", F.lit("</collection>"), title, F.lit("<body>"), F.base64(F.col("c_name").cast("binary")), F.lit("</body></document></documents></add>"))
    gone = F.concat(F.lit("<delete><collection>"), "c_mktsegment", F.lit("</collection><uri>http://c/"), (k - 1).cast("string"), F.lit("</uri><document><title>no add</title></document></delete><close><collection>x</collection></close>"))
    xml = F.concat(F.lit("<sddocument><version>1</version>"), add, F.when(k % 5 == 0, gone).otherwise(""), F.lit("</sddocument>"))
    b = formats.read_batches(read(spark, sf, "customer").select(xml.alias("xml")))
    return b.select("op", "collection", "url", "title", "body", F.array_join("acl_allow", ",").alias("acl_allow"), "error")


def zip_explode(spark, sf):
    """Each conversation as an archive of its turns; every ninth archive is cut short."""

    def packed(batches):
        for batch in batches:
            out = []
            for conv, turns in zip(batch["conv_id"], batch["turns"], strict=True):
                b = io.BytesIO()
                with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
                    for t in turns:
                        z.writestr(zipfile.ZipInfo(f"{t['turn']}.txt"), t["text"] or "")
                out.append((conv, b.getvalue()[:9] if conv % 9 == 0 else b.getvalue()))
            yield pd.DataFrame(out, columns=["conv_id", "content"])

    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    x = formats.exploded(c.mapInPandas(packed, "conv_id long, content binary"), "zip", "conv_id")
    return x.select("conv_id", F.col("part").cast("long").alias("part"), "name", "text", F.col("error").isNotNull().alias("damaged"))


def packed_links(spark, sf):
    """Pages as records of found links, read back."""

    def pack(batches):
        for batch in batches:
            yield pd.DataFrame({"content": [b"".join(struct.pack(formats.PACKED, bytes(20), u.encode()[:199], b"text", b"", int(k)) for k, u in zip(batch["page_id"], batch["url"], strict=True)) + b"half"]})

    return formats.found_links(read(spark, sf, "pages").select("page_id", "url").mapInPandas(pack, "content binary")).select("url", "anchor", "src")


def image_sizes(spark, sf):
    """GIF headers of parts' sizes."""
    small = lambda c: F.unhex(F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0")))
    k = F.col("p_partkey")
    files = read(spark, sf, "part").select(k.cast("string").alias("path"), F.concat(F.lit(b"GIF89a"), small(k % 5000), small(F.col("p_size").cast("long"))).alias("content"))
    return media.described(files).select("path", F.col("attributes")["format"].alias("format"), F.col("attributes")["width"].cast("long").alias("width"), F.col("attributes")["height"].cast("long").alias("height"))


def connector_read(spark, sf):
    """A connector's documents: four parts of five."""
    spark.dataSource.register(connector.Connector)
    d = spark.read.format("millrace").option("crawler", "millrace.sources.connector:Numbers").option("parts", "4").option("size", "5").load()
    return d.select("url", "title", "body", "last_modified", F.array_join("acl_allow", ",").alias("acl_allow"))


def timeline_posts(spark, sf):
    """Conversations' turns as posts."""
    return formats.timeline(read(spark, sf, "conversations").select(F.col("role").alias("name"), "text")).groupBy("title").agg(F.count("*").alias("n"), F.min(F.length("body")).cast("long").alias("shortest"))


def settings_roundtrip(spark, sf):
    """Two tables of settings, written and read again."""
    path = f"{shared_folder(spark)}/settings-{uuid.uuid4().hex}"
    records.export_settings({"nation": read(spark, sf, "nation").select("n_nationkey", "n_name"), "region": read(spark, sf, "region").select("r_regionkey", "r_name")}, path)
    got = records.import_settings(spark, path, {"nation": "n_nationkey long, n_name string", "region": "r_regionkey long, r_name string"})
    return got["nation"].select(F.lit("nation").alias("table"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).union(got["region"].select(F.lit("region"), F.col("r_regionkey").cast("long"), "r_name"))


def result_elements(spark, sf):
    p = read(spark, sf, "pages").select("url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.lit("a & b").alias("snippet"), F.col("page_id").alias("rank"))
    return formats.result_xml(p).select("url", "value")


def page_signatures(spark, sf):
    """Signed addresses of stored pages: one in three is forged, and some are too old."""
    time = F.col("page_id") % 7200
    signed = records.page_signature("key", F.col("page_id"), time)
    p = read(spark, sf, "pages").select("page_id", records.may_fetch("key", F.col("page_id"), time, F.when(F.col("page_id") % 3 == 0, signed + 1).otherwise(signed), F.lit(7200)).alias("fetched"), signed.alias("signature"))
    return p


def verification_ids(spark, sf):
    c = read(spark, sf, "customer")
    return c.select("c_custkey", ranks.verification_id("salt", F.col("c_name"), F.col("c_custkey"), F.lit("10.0.0.1")).alias("id"))


def access_levels(spark, sf):
    """Who may ask, by address, key and user."""

    @F.pandas_udf("string")
    def level(address: pd.Series, key: pd.Series, user: pd.Series) -> pd.Series:
        return pd.Series([records.access_level(a, k, u, keys=("secret",)) for a, k, u in zip(address, key, user, strict=True)])

    k = F.col("c_custkey")
    address = F.concat(F.when(k % 5 == 0, "127.0.0.").otherwise("10.1.2."), (k % 200).cast("string"))
    c = read(spark, sf, "customer").select("c_custkey", level(address, F.when(k % 7 == 0, "secret"), F.when(k % 2 == 0, "user")).alias("level"))
    return c


def plugged_users(spark, sf):
    """A user system that is asked for each user's groups."""
    names = [r["n_name"] for r in read(spark, sf, "nation").select("n_name").collect()]  # a table of 25 rows
    return records.user_system(spark, lambda: names, lambda u: [u[0], str(len(u))])


QUERIES = {f.__name__: f for f in (xml_batch, zip_explode, packed_links, image_sizes, connector_read, timeline_posts, settings_roundtrip, result_elements, page_signatures, verification_ids, access_levels, plugged_users)}
_SAFE = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SQL = {
    "xml_batch": """select 'add' as op, case when c_custkey % 7 > 0 then c_mktsegment end as collection, case when c_custkey % 7 > 0 then 'http://c/' || c_custkey end as url, case when c_custkey % 7 > 0 then c_name end as title, case when c_custkey % 7 > 0 then c_name end as body,
        case when c_custkey % 7 > 0 then 'Everyone' end as acl_allow, case when c_custkey % 7 = 0 then 'http://c/' || c_custkey || ': no title' end as error from customer
        union all select 'delete', c_mktsegment, 'http://c/' || (c_custkey - 1), null, null, null, null from customer where c_custkey % 5 = 0 union all select 'close', 'x', null, null, null, null, null from customer where c_custkey % 5 = 0""",
    "zip_explode": """select conv_id, row_number() over (partition by conv_id order by turn, text) - 1 as part, turn || '.txt' as name, coalesce(text, '') as text, false as damaged from conversations where conv_id % 9 > 0
        union all select distinct conv_id, 0, null, null, true from conversations where conv_id % 9 = 0""",
    "packed_links": "select url, 'text' as anchor, page_id as src from pages",
    "image_sizes": "select p_partkey::varchar as path, 'gif' as format, p_partkey % 5000 as width, p_size::bigint as height from part",
    "connector_read": "select 'http://www.example.com/' || p || '/' || k as url, p || '.' || k as title, 'number ' || k as body, k as last_modified, 'Everyone' as acl_allow from (select unnest(range(4)) as p), (select unnest(range(5)) as k)",
    "timeline_posts": "select role || ': ' || substr(text, 1, 50) as title, count(*) as n, min(length(text)) as shortest from conversations group by 1",
    "settings_roundtrip": "select 'nation' as \"table\", n_nationkey::bigint as id, n_name as name from nation union all select 'region', r_regionkey::bigint, r_name from region",
    "result_elements": f"select url, '<RESULT><TITLE>' || {_SAFE.format('t')} || '</TITLE><URL>' || {_SAFE.format('url')} || '</URL><DESCRIPTION>a &amp; b</DESCRIPTION><RANK>' || page_id || '</RANK></RESULT>' as value from (select url, page_id, regexp_extract(html, '<title>([^<]*)', 1) as t from pages)",
    "page_signatures": f"select page_id, page_id % 3 > 0 and page_id % 7200 + 3600 >= 7200 as fetched, {CRC32.format("'key|' || page_id || '|' || (page_id % 7200)")} as signature from pages",
    "verification_ids": f"select c_custkey, {CRC32.format("'salt' || c_name || c_custkey || '10.0.0.1'")} || '-' || c_custkey as id from customer",
    "access_levels": "select c_custkey, case when c_custkey % 5 = 0 or c_custkey % 7 = 0 then 'full' when c_custkey % 2 = 0 then 'limited' else 'none' end as level from customer",
    "plugged_users": 'select n_name as "user", substr(n_name, 1, 1) as "group" from nation union all select n_name, length(n_name)::varchar from nation',
}
