"""Administration, crawl scheduling, versions and streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from millrace.functions import ranks
from millrace.functions.urls import host
from millrace.operators import access, admin, crawling, facets, ingest
from millrace.sources import formats
from millrace.storage import shared_folder
from millrace.streaming import flows

from .tables import log, read

NOW = "2024-02-01 12:00:00"
# What the connectors of these tables are called
CONNECTORS = [(1, "SMB"), (2, "Exchange"), (3, "SuperOffice"), (4, "SharePoint"), (5, "ODBC"), (6, "Intranet"), (7, "Push")]


def _shares(spark, sf):
    """A share for each supplier: connector, state, rate in minutes, last crawl."""
    k = F.col("s_suppkey")
    last = F.when(k % 9 == 0, None).otherwise(F.lit(NOW).cast("timestamp") - F.make_dt_interval(k % 3, k % 24, k % 60))
    return read(spark, sf, "supplier").select(k.alias("id"), F.concat(F.lit("src"), (k % 17).cast("string")).alias("collection"), (k % 6 + 1).cast("int").alias("connector"), F.when(k % 4 > 0, 1).otherwise(0).alias("active"), (k % 5 * 720).cast("int").alias("rate"), last.alias("last"))


def _connectors(spark):
    return spark.createDataFrame(CONNECTORS, "id int, name string")


def _users(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_name").alias("user"), F.col("c_mktsegment").alias("group"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))


def _mapping(spark, sf):
    """Every third customer has a mapping: a table of its own, as the operators take users with and without one."""
    return read(spark, sf, "customer").where(F.col("c_custkey") % 3 == 0).select(F.col("c_name").alias("secnd_usr"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("prim_usr"))


def unmapped_users(spark, sf):
    return admin.unmapped(_users(spark, sf).select("user"), _mapping(spark, sf), 20, 100)


def auto_map(spark, sf):
    u = _users(spark, sf)
    return admin.auto_mapped(u.where("nation < 12"), u.where("nation > 6"), _mapping(spark, sf))


def mapping_counts(spark, sf):
    one, none = F.lit(1), F.lit(0)
    rows = _users(spark, sf).select(one.alias("u"), none.alias("m")).union(_mapping(spark, sf).select(none, one))
    return rows.agg(F.sum("u").alias("n_users"), F.sum("m").alias("n_mapped")).select("n_users", "n_mapped", (F.col("n_users") - F.col("n_mapped")).alias("n_unmapped"))


def user_groups(spark, sf):
    u = _users(spark, sf)
    p = access.principals_of(u.select("user"), u.select("user", "group"))
    return p.select("user", F.array_join("principals", ",").alias("principals"))


def user_collections(spark, sf):
    """Users with the nations of their orders' customers' suppliers' regions as collections: distinct, in order."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("collection"))
    c = admin.collections_of_users(o.join(_users(spark, sf).select("id", "user"), "id"))
    return c.select("user", F.array_join("collections", ",").alias("collections"))


def group_collections(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("collection"))
    return o.join(_users(spark, sf).select("id", "group"), "id").groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("collection")), ",").alias("collections"), F.count("*").alias("n"))


def shares_join(spark, sf):
    return admin.shares_with_connectors(_shares(spark, sf), _connectors(spark), active=True).select("id", "collection", "connector_name")


def connectors_in_use(spark, sf):
    return admin.connectors_in_use(_shares(spark, sf), _connectors(spark))


def connector_nest(spark, sf):
    n = read(spark, sf, "documents").groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("n"))
    x = admin.nested(_connectors(spark), _shares(spark, sf).where("active = 1"), n)
    return x.select("id", "name", F.array_join(F.transform("collections", lambda s: F.concat_ws("=", s["collection"], s["n"].cast("string"))), ",").alias("collections"))


def pushed_collections(spark, sf):
    return admin.pushed(read(spark, sf, "documents").select(F.col("source").alias("collection")).distinct(), _shares(spark, sf))


def due_collections(spark, sf):
    return crawling.due(_shares(spark, sf), F.lit(NOW).cast("timestamp"), F.lit(False)).select("id", "collection", "turn")


def next_crawl_text(spark, sf):
    s = _shares(spark, sf).where("last is not null").withColumn("m", crawling.next_minutes(_shares(spark, sf), F.lit(NOW).cast("timestamp")))
    return s.select("id", "m", F.concat(F.when(F.col("m") < 0, "overdue by ").otherwise("in "), ranks.minutes_text(F.abs("m"))).alias("text"))


def table_gateway(spark, sf):
    return admin.where(read(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": "5-LOW"}, ["o_orderkey", "o_custkey"])


def mounts(spark, sf):
    p = read(spark, sf, "pages").select(F.concat(F.lit("/disk"), (F.col("page_id") % 3).cast("string"), F.lit("/lot/"), F.col("page_id").cast("string")).alias("path"), F.length("html").cast("long").alias("size"))
    m = spark.createDataFrame([("/",), ("/disk1",), ("/disk2/lot",)], "mount string")
    return admin.on_mounts(p, m).groupBy("mount").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def latest_version(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.lit(1).alias("version"), "lang")
    more = read(spark, sf, "documents").where(F.col("doc_id") % 4 == 0).select("doc_id", F.lit(2).alias("version"), F.upper("lang").alias("lang"))
    return ingest.latest(d.union(more)).select("doc_id", "version", "lang")


def compaction(spark, sf):
    log_ = read(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3)).alias("pointer"))
    pointers = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3).alias("pointer"))
    rows = ingest.live(log_, pointers).select(F.lit(1).alias("kept"), F.lit(0).alias("all")).union(log_.select(F.lit(0), F.lit(1)))
    return rows.agg(F.sum("kept").alias("kept"), F.sum("all").alias("all")).select("kept", (F.col("all") - F.col("kept")).alias("removed"))


def change_detect(spark, sf):
    p = read(spark, sf, "pages").select("url", (F.col("page_id") % 50).alias("last_modified"), F.length("html").alias("size"))
    stored = read(spark, sf, "pages").select("url", (F.col("page_id") % 50 + F.when(F.col("page_id") % 6 == 0, 1).otherwise(0)).alias("last_modified"), F.length("html").alias("size"))
    return ingest.changed(p, stored).select("url", "last_modified", F.col("size").cast("long").alias("size"))


def upsert_log(spark, sf):
    p = read(spark, sf, "pages")
    url, ts = F.col("url"), F.lit(NOW).cast("timestamp")
    stored = p.groupBy(url).agg(F.max("page_id").alias("v")).select(F.concat(F.lit("c"), (F.length("url") % 3).cast("string")).alias("collection"), "url", "v")
    day = lambda k: ts + F.make_dt_interval(F.lit(k))
    adds = stored.where("v % 5 = 0").select("collection", "url", (F.col("v") + 100000).alias("v"), day(2).alias("ts"), F.lit("add").alias("op"))
    gone = stored.where("v % 10 = 0").select("collection", "url", "v", day(3).alias("ts"), F.lit("delete").alias("op"))
    wipe = spark.range(1).select(F.lit("c1").alias("collection"), F.lit(None).cast("string").alias("url"), F.lit(0).cast("long").alias("v"), day(1).alias("ts"), F.lit("delete").alias("op"))
    return ingest.upsert(stored, adds.union(gone).union(wipe))


def first_wins(spark, sf):
    p = read(spark, sf, "pages").select(host(F.col("url")).alias("host"), "page_id", F.length("html").cast("long").alias("size"))
    return ingest.first_wins(p, "host", "page_id")


def interleave(spark, sf):
    a = read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return ingest.interleaved(a, read(spark, sf, "benchmark").select(F.col("item_id").alias("id")), "id")


def stale_documents(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", (F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.col("doc_id") % 3, F.lit(1))).alias("last_seen"), (F.col("source") == "src3").alias("keep"))
    return d.where(ingest.stale(d, F.lit(NOW).cast("timestamp"), F.col("keep"))).select("doc_id")


def old_client_urls(spark, sf):
    """Rows of old clients under one country."""
    return read(spark, sf, "pages").where((F.col("page_id") % 100 / 100 < 0.79) & F.col("url").contains(".org/")).select("page_id", "url")


def uncrawled(spark, sf):
    p = read(spark, sf, "pages").select((F.col("page_id") % 5).alias("response"))
    return p.agg(F.count_if(F.col("response") == 0).alias("uncrawled"), F.count_if(F.col("response") != 0).alias("crawled"))


def file_type_facet(spark, sf):
    e = F.concat(F.lit("x."), F.element_at(F.array(*map(F.lit, ["doc", "pdf", "xls", "zzz", "tapp", "html"])), (F.col("doc_id") % 6 + 1).cast("int")))
    g = read(spark, sf, "documents").select(facets.file_group(facets.extension(e)).alias("group"))
    return g.where(F.col("group") != "Application Data").groupBy("group").agg(F.count("*").alias("n"))


def name_buckets(spark, sf):
    return read(spark, sf, "documents").groupBy(ingest.bucket_of_name(F.col("text"), 2).alias("bucket"), ingest.lot(F.col("doc_id"), 400).alias("lot")).agg(F.count("*").alias("n"))


def acl_mask_parse(spark, sf):
    mask = F.when(F.col("c_custkey") % 3 == 0, "0x001f01ff").when(F.col("c_custkey") % 3 == 1, "0x00120089").otherwise("0x00020000")
    sid = F.concat(F.lit("S-1-5-"), F.col("c_custkey").cast("string"))
    t = F.concat(F.lit("REVISION:1,OWNER:"), sid, F.lit(",GROUP:x,ACL:"), sid, F.lit(":"), (F.col("c_custkey") % 2).cast("string"), F.lit("/16/"), mask, F.when(F.col("c_custkey") % 10 == 0, ",ACL:S-1-1-0:0/16/0x001f01ff").otherwise(""))
    a = read(spark, sf, "customer").select("c_custkey", access.windows_acl(t).alias("a"))
    return a.select("c_custkey", F.array_join("a.allow", ",").alias("allow"), F.array_join("a.deny", ",").alias("deny"))


def address_ranges(spark, sf):
    r = read(spark, sf, "nation").select((F.col("n_nationkey") * 10).cast("long").alias("first"), (F.col("n_nationkey") * 10 + F.col("n_nationkey") % 4).cast("long").alias("last"))
    return admin.addresses(r).select("address")


def _mails(spark, sf):
    c = read(spark, sf, "conversations")
    part = F.concat(F.lit("--b\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"), "text", F.lit("\r\n"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "").alias("body")).select("conv_id", F.concat(F.lit("Subject: talk "), F.col("conv_id").cast("string"), F.lit("\r\nFrom: a@example.com\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n"), "body", F.lit("--b--\r\n")).cast("binary").alias("content"))


def eml_explode(spark, sf):
    return formats.exploded(_mails(spark, sf), "eml", "conv_id")


def result_items(spark, sf):
    p = read(spark, sf, "pages").select("url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.lit("a < b").alias("snippet"))
    return formats.feed_items(p).select("url", "item")


def result_json(spark, sf):
    return formats.as_json(read(spark, sf, "nation").select("n_nationkey", "n_name"))


def stream_metrics(spark, sf):
    """The log as a stream, read to its end, in windows of an hour."""
    out = f"m{os.urandom(6).hex()}"
    stream = spark.readStream.schema(read(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = stream.select(F.col("ts").cast("timestamp").alias("tid"), F.col("event_type").alias("query"), F.col("value").alias("seconds"))
    at = shared_folder(spark)
    q = flows.metrics(rows, 60).writeStream.outputMode("complete").format("memory").queryName(out).option("checkpointLocation", f"{at}/{out}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(out).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "query", "n", "least", "most")


def batch_metrics(spark, sf):
    m = flows.metrics(log(spark, sf), 60)
    return m.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "query", "n", "least", "most")


QUERIES = {f.__name__: f for f in (unmapped_users, auto_map, mapping_counts, user_groups, user_collections, group_collections, shares_join, connectors_in_use, connector_nest, pushed_collections, due_collections, next_crawl_text, table_gateway, mounts, latest_version, compaction, change_detect, upsert_log, first_wins, interleave, stale_documents, old_client_urls, uncrawled, file_type_facet, name_buckets, acl_mask_parse, address_ranges, eml_explode, result_items, result_json, stream_metrics, batch_metrics)}

_C = "connectors(id, name) as (values " + ", ".join(f"({i}, '{n}')" for i, n in CONNECTORS) + ")"
_SHARES = f"""shares as (select s_suppkey as id, 'src' || (s_suppkey % 17) as collection, (s_suppkey % 6 + 1)::int as connector, (s_suppkey % 4 > 0)::int as active, (s_suppkey % 5 * 720)::int as rate,
    case when s_suppkey % 9 = 0 then null else timestamp '{NOW}' - to_days((s_suppkey % 3)::int) - to_hours(s_suppkey % 24) - to_minutes(s_suppkey % 60) end as last from supplier)"""
_METRICS = "select strftime(time_bucket(interval 60 minute, ts), '%Y-%m-%d %H:%M') as start, event_type as query, count(*) as n, min(value) as least, max(value) as most from events group by 1, 2"
_EFF = "case when rate > 0 then rate else 1440 end"
_M = f"({_EFF} - floor(epoch(timestamp '{NOW}' - last) / 60))::bigint"
SQL = {
    "unmapped_users": 'select c_name as "user" from customer where c_custkey % 3 <> 0 order by 1 limit 100 offset 20',
    "auto_map": 'select c_name as "user" from customer where c_nationkey < 12 and c_nationkey > 6 and c_custkey % 3 <> 0',
    "mapping_counts": "select count(*) as n_users, count(*) filter (where c_custkey % 3 = 0) as n_mapped, count(*) filter (where c_custkey % 3 <> 0) as n_unmapped from customer",
    "user_groups": "select c_name as \"user\", array_to_string(list_sort([c_name, c_mktsegment]), ',') as principals from customer",
    "user_collections": "select c_name as \"user\", string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as collections from orders join customer on o_custkey = c_custkey group by 1",
    "group_collections": "select c_mktsegment as \"group\", string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as collections, count(*) as n from orders join customer on o_custkey = c_custkey group by 1",
    "shares_join": f"with {_C}, {_SHARES} select s.id, collection, name as connector_name from shares s join connectors c on c.id = s.connector where active = 1",
    "connectors_in_use": f"with {_C}, {_SHARES} select name as connector_name, count(*) as n from shares s join connectors c on c.id = s.connector group by name",
    "connector_nest": f"""with {_C}, {_SHARES}, n as (select source, count(*) as n from documents group by source), own as (select connector, collection, coalesce(n, 0) as n from shares left join n on source = collection where active = 1),
        g as (select connector, string_agg(collection || '=' || n, ',' order by collection, n) as c from own group by connector) select id, name, coalesce(c, '') as collections from connectors left join g on id = connector""",
    "pushed_collections": f"with {_SHARES} select distinct source as collection from documents where source not in (select collection from shares)",
    "due_collections": f"with {_SHARES} select id, collection, case when last is null then 0 when rate <= 0 then 1 else 2 end as turn from shares where active = 1 and connector <> 14 and (last is null or last + to_minutes({_EFF}) <= timestamp '{NOW}') and {_EFF} < 1440",
    "next_crawl_text": f"""with {_SHARES}, x as (select id, {_M} as m from shares where last is not null), y as (select *, abs(m) as a, case when abs(m) < 60 then abs(m) when abs(m) < 1440 then abs(m) // 60 else abs(m) // 1440 end as v from x)
        select id, m, case when m < 0 then 'overdue by ' else 'in ' end || case when a < 1 then 'now' else v || case when a < 60 then ' minute' when a < 1440 then ' hour' else ' day' end || case when v = 1 then '' else 's' end end as text from y""",
    "table_gateway": "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '5-LOW'",
    "mounts": "select case page_id % 3 when 0 then '/' when 1 then '/disk1' else '/disk2/lot' end as mount, count(*) as n, sum(length(html))::bigint as size from pages group by 1",
    "latest_version": "select doc_id, case when doc_id % 4 = 0 then 2 else 1 end as version, case when doc_id % 4 = 0 then upper(lang) else lang end as lang from documents",
    "compaction": "select count(*) as kept, sum(doc_id % 3)::bigint as removed from documents",
    "change_detect": "select url, page_id % 50 as last_modified, length(html) as size from pages p where not exists (select 1 from pages s where s.url = p.url and s.page_id % 50 + (s.page_id % 6 = 0)::int = p.page_id % 50 and length(s.html) = length(p.html))",
    "upsert_log": """with s as (select 'c' || (length(url) % 3) as collection, url, max(page_id) as v from pages group by url) select collection, url, case when v % 5 = 0 then v + 100000 else v end as v from s where v % 10 <> 0 and (collection <> 'c1' or v % 5 = 0)""",
    "first_wins": "select host, page_id, size from (select lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) as host, page_id, length(html) as size, row_number() over (partition by lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) order by page_id) as p from pages) where p = 1",
    "interleave": """with r as (select greatest(1, (select count(*) from documents) // greatest(1, (select count(*) from benchmark))) as k) select doc_id as id, (row_number() over (order by doc_id) - 1) * 2 as place, 'large' as side from documents
        union all select item_id, row_number() over (order by item_id) * k * 2 - 1, 'small' from benchmark, r""",
    "stale_documents": "select doc_id from documents where doc_id % 3 > 0 and source <> 'src3'",
    "old_client_urls": "select page_id, url from pages where page_id % 100 / 100 < 0.79 and contains(url, '.org/')",
    "uncrawled": "select count(*) filter (where page_id % 5 = 0) as uncrawled, count(*) filter (where page_id % 5 <> 0) as crawled from pages",
    "file_type_facet": "select case doc_id % 6 when 0 then 'Word' when 1 then 'Adobe PDF' when 2 then 'Excel' when 3 then 'Other' else 'Webpage' end as \"group\", count(*) as n from documents where doc_id % 6 <> 4 group by 1",
    "name_buckets": "select regexp_replace(lower(substr(text, 1, 2)), '[^a-z0-9]', '_', 'g') as bucket, doc_id // 400 as lot, count(*) as n from documents group by 1, 2",
    "acl_mask_parse": """with c as (select c_custkey, 'S-1-5-' || c_custkey as sid, c_custkey % 3 as m, c_custkey % 2 as t, c_custkey % 10 = 0 as every from customer)
        select c_custkey, case when every then 'Everyone' when t = 0 and m < 2 then sid else '' end as allow, case when t = 1 and m < 2 then sid else '' end as deny from c""",
    "address_ranges": "select (n_nationkey * 10 + unnest(range(n_nationkey % 4 + 1)))::bigint as address from nation",
    "result_items": "select url, '<item><title>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><link>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</link><description>a &lt; b</description></item>' as item from (select url, regexp_extract(html, '<title>([^<]*)', 1) as t from pages)",
    "result_json": "select '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as value from nation",
    "eml_explode": """select conv_id, 0 as part, 'headers' as name, 'Subject: talk ' || conv_id || chr(10) || 'From: a@example.com' as text, null::varchar as error from conversations group by conv_id
        union all select conv_id, (row_number() over (partition by conv_id order by turn, text))::int, 'text/plain', text, null from conversations""",
    "stream_metrics": _METRICS,
    "batch_metrics": _METRICS,
}
