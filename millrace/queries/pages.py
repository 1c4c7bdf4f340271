"""Pages by field, document scans, display rules and other filters over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import ranks
from millrace.functions.urls import host
from millrace.operators import crawling, facets, search

from .search import _attributes
from .tables import LINKS, PATTERN, read

TERMS = ["the", "example", "de", "la"]


def _index(spark, sf):
    """A document index: pages with the language in their path, their response, and the address of their host."""
    p = read(spark, sf, "pages")
    code = F.when(F.col("page_id") % 10 == 0, 404).when(F.col("page_id") % 10 == 1, 301).otherwise(200)
    address = F.concat(F.lit("10.0."), (F.ascii(F.substring(host(F.col("url")), 1, 1)) % 8).cast("string"), F.lit("."), F.length(host(F.col("url"))).cast("string"))
    return p.select(F.col("page_id").alias("doc_id"), "url", code.alias("response"), F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("lang"), address.alias("ip"), F.length("html").cast("long").alias("size"))


def _anchors(spark, sf):
    p = read(spark, sf, "pages")
    n = p.count()
    both = lambda k: F.regexp_extract_all("html", F.lit(search.ANCHOR), F.lit(k))
    rows = p.select(F.explode(F.arrays_zip(both(1).alias("link"), both(2).alias("text"))).alias("a"))
    return rows.select((F.conv(F.substring(F.md5("a.link"), 1, 8), 16, 10).cast("long") % n).alias("doc_id"), F.col("a.text").alias("text"))


def ranked_fields(spark, sf):
    """Four words over all fields of the pages, with the points of each field."""
    f = search.page_fields(read(spark, sf, "pages"), _anchors(spark, sf), doc_id="page_id")
    return search.rank_fields(search.postings(f, TERMS, keep=("field",)).groupBy("term", "doc_id", "field").agg(F.flatten(F.collect_list("positions")).alias("positions")))


def document_scan(spark, sf):
    return search.document_scan(_index(spark, sf), 200, "fr", "com").select("doc_id", "url")


def address_projection(spark, sf):
    """Addresses by lot, in the lot's order."""
    return _index(spark, sf).select(F.floor(F.col("doc_id") / 100).alias("lot"), (F.col("doc_id") % 100).alias("place"), "ip")


def response_filter(spark, sf):
    return _index(spark, sf).where(F.col("response") == 200).groupBy("lang").agg(F.count("*").alias("n"))


def same_address_first(spark, sf):
    """The first page of each address."""
    return facets.first_of_equal(_index(spark, sf), "ip", F.col("size").desc(), F.col("doc_id")).select("ip", "doc_id", "size")


def same_description_first(spark, sf):
    d = read(spark, sf, "pages").select("page_id", F.md5(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("description"))
    return facets.first_of_equal(d, "description", F.col("page_id")).select("description", "page_id")


def domain_bounds(spark, sf):
    """Pages under given top-level domains whose host is short and has no two hyphens."""
    h = host(F.col("url"))
    return read(spark, sf, "pages").where(F.substring_index(h, ".", -1).isin("com", "org") & (F.length(h) <= 18) & (F.regexp_count(h, F.lit("-")) < 2)).select("page_id", h.alias("host"))


def rank_sorted(spark, sf):
    """Documents in order of their rank's bucket, with their place."""
    d = search.by_rank_bucket(read(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("rank")))
    return d.select("doc_id", "rank", "bucket")


def facet_rules(spark, sf):
    """A menu: languages by name under a heading, the three sources with most hits, sizes by a rule taken from another."""
    rules = [
        {"name": "menu", "select": "lang", "group": "Language", "sort": "alpha", "expanded": True, "show_max_sub": 3},
        {"select": "source", "sort": "hits", "show_max": 3, "hide": ["src1"]},
        {"import": "menu", "select": "siz/*", "group": "Size", "reverse": True},
        {"select": "size", "sort": "alpha", "reverse": True},
    ]
    counted = facets.counts(_attributes(spark, sf)).where("value is not null")
    return facets.navigation(counted, rules)


def facet_by_name(spark, sf):
    return facets.shown(facets.counts(_attributes(spark, sf)), 4, order="alpha").select("key", "value", "n", "place")


def file_types(spark, sf):
    """Every known extension and one that isn't, in both languages."""
    x = spark.createDataFrame([(e,) for e, *_ in facets.FILE_TYPES] + [("zzz",)], "ext string")
    eng, nbo = facets.file_type(F.col("ext")), facets.file_type(F.col("ext"), "nbo")
    return x.select("ext", eng["group"].alias("group"), eng["name"].alias("name"), eng["version"].alias("version"), eng["icon"].alias("icon"), nbo["group"].alias("group_nbo"), nbo["name"].alias("name_nbo"))


def blog_links(spark, sf):
    """Links of pages read as a blog's, some of them the blog's own."""
    h = F.regexp_replace("html", 'href="/t', 'href="/wp-t')
    return read(spark, sf, "pages").select("page_id", F.explode(crawling.blog_links(h)).alias("link"))


def redirect_links(spark, sf):
    x = _index(spark, sf).withColumn("body", F.concat(F.lit(" http://www.example.com/"), F.col("doc_id").cast("string")))
    return crawling.redirect_links(x)


def expired_results(spark, sf):
    x = read(spark, sf, "events").select("event_id", F.col("user_id").alias("modified"), (F.col("event_id") % 100).alias("rate"))
    return crawling.expired(x, F.lit(60)).select("event_id")


def next_runs(spark, sf):
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(k.alias("id"), crawling.next_run(k * 100, k % 4, F.lit(9000)).cast("long").alias("seconds"))


def collections_like(spark, sf):
    """Collections whose name holds a text, with their last document and their lots."""
    d = read(spark, sf, "documents").where(F.contains("source", F.lit("1")))
    return d.groupBy(F.col("source").alias("collection")).agg(F.max("doc_id").alias("last_doc"), F.countDistinct(F.floor(F.col("doc_id") / 100)).alias("n_lots"))


def pages_of_lots(spark, sf):
    """Pages whose lot belongs to one of two servers."""
    lots = spark.range(0, 1000, 2).select(F.col("id").alias("lot"))
    return search.of_lots(read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url"), lots, 50).select("doc_id", "lot")


def keys_without_space(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.substring("text", 1, 9).alias("key")).where(~F.contains("key", F.lit(" "))).select("item_id", "key")


def time_text(spark, sf):
    """Times as text, read back as seconds; -1 for text that is no time."""
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    read_ = lambda c: F.when(c.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.unix_timestamp(F.try_to_timestamp(c)))
    return read(spark, sf, "events").select("event_id", read_(F.when(F.col("event_id") % 9 == 0, F.lit("never")).otherwise(t)).alias("seconds")).fillna(-1, ["seconds"])


QUERIES = {f.__name__: f for f in (ranked_fields, document_scan, address_projection, response_filter, same_address_first, same_description_first, domain_bounds, rank_sorted, facet_rules, facet_by_name, file_types, blog_links, redirect_links, expired_results, next_runs, collections_like, pages_of_lots, keys_without_space, time_text)}

_H = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"
_INDEX = f"""idx as (select page_id as doc_id, url, case page_id % 10 when 0 then 404 when 1 then 301 else 200 end as response, regexp_extract(url, '/([a-z][a-z])/', 1) as lang,
    '10.0.' || (ascii(substr({_H}, 1, 1)) % 8) || '.' || length({_H}) as ip, length(html) as size from pages)"""
_ATTR = """attr as (select doc_id, 'lang' as key, lang as value from documents union all select doc_id, 'source', source from documents union all select doc_id, 'size', case when n_chars < 1000 then 'small' when n_chars < 5000 then 'medium' else 'large' end from documents),
    counted as (select key, value, count(*) as n from attr where value is not null group by key, value)"""
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_ANCHOR = search.ANCHOR.replace("'", "''")
_POINTS = {k: "[" + ", ".join(map(str, v)) + "]" for k, v in ranks.FIELD_POINTS.items()}
_BY_FIELD = " ".join(f"when '{k}' then list_extract({v}, least(n, {len(ranks.FIELD_POINTS[k])})::int)" for k, v in _POINTS.items())


def _typed(v: str | None) -> str:
    return "null" if v is None else "'" + v.replace("'", "''") + "'"


_TYPES = [(e, g, n, v, i or facets.GROUP_ICONS[g], facets.GROUPS_NBO.get(g, g), o) for e, g, n, o, v, i in facets.FILE_TYPES] + [("zzz", "Other", None, None, "default", "Annet", None)]
SQL = {
    "ranked_fields": f"""with f as (select page_id as doc_id, 'title' as field, {_TITLE} as t from pages
        union all select page_id, 'headline', array_to_string(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), ' ') from pages union all select page_id, 'url', url from pages
        union all select page_id, 'main_url', string_split({_H}, '.')[greatest(len(string_split({_H}, '.')) - 1, 1)] from pages
        union all select page_id, 'body', regexp_replace(regexp_replace(html, '(?is)<(?:script|style|title)[^>]*>.*?</(?:script|style|title)>', ' ', 'g'), '<[^>]*>', ' ', 'g') from pages
        union all select ('0x' || substr(md5(link), 1, 8))::bigint % (select count(*) from pages), 'anchor', t from (select unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) as link, unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) as t from pages)),
        w as (select doc_id, field, regexp_extract_all(lower(t), {PATTERN}) as w from f), tok as (select doc_id, field, unnest(w) as term, generate_subscripts(w, 1) - 1 as pos from w),
        hit as (select doc_id, field, term, count(*) as n, min(pos) as p from tok where term in ('the', 'example', 'de', 'la') group by 1, 2, 3)
        select doc_id, sum(case field {_BY_FIELD} when 'main_url' then {ranks.MAIN_URL_WORD} end + case when field = 'title' and p = 0 then {ranks.FIRST_TITLE_WORD} else 0 end)::bigint as score from hit group by doc_id""",
    "document_scan": f"with {_INDEX} select doc_id, url from idx where response = 200 and lang = 'fr' and string_split({_H}, '.')[-1] = 'com' and url <> ''",
    "address_projection": f"with {_INDEX} select doc_id // 100 as lot, doc_id % 100 as place, ip from idx",
    "response_filter": f"with {_INDEX} select lang, count(*) as n from idx where response = 200 group by lang",
    "same_address_first": f"with {_INDEX} select ip, doc_id, size from (select *, row_number() over (partition by ip order by size desc, doc_id) as k from idx) where k = 1",
    "same_description_first": f"select md5({_TITLE}) as description, min(page_id) as page_id from pages group by 1",
    "domain_bounds": f"select page_id, {_H} as host from pages where string_split({_H}, '.')[-1] in ('com', 'org') and length({_H}) <= 18 and length({_H}) - length(replace({_H}, '-', '')) < 2",
    "rank_sorted": "select doc_id, n_chars as rank, (case when n_chars <= 0 then 0 else ceil(ln(n_chars)) end)::bigint as bucket from documents order by bucket, doc_id",
    "facet_rules": f"""with {_ATTR}, one as (select value, n, row_number() over (order by value) as k from counted where key = 'lang'), two as (select value, n, row_number() over (order by n desc, value) as k from counted where key = 'source' and value <> 'src1'),
        three as (select value, n, row_number() over (order by value desc) as k from counted where key like 'siz%' and false)
        select 0 as place, 'Language' as "group", null as key, null as value, (sum(n))::bigint as n, true as expanded, 0 as level from one where k <= 3 union all select 0, 'Language', 'lang', value, n, true, 1 from one where k <= 3
        union all select 1, null, 'source', value, n, false, 0 from two where k <= 3 union all select 2, 'Size', 'size', value, n, true, 1 from three union all select 3, null, 'size', value, n, false, 0 from counted where key = 'size'""",
    "facet_by_name": f"with {_ATTR} select key, value, n, place from (select key, value, n, row_number() over (partition by key order by value) as place from counted) where place <= 4",
    "file_types": "select * from (values " + ", ".join("(" + ", ".join(map(_typed, t)) + ")" for t in _TYPES) + ') t(ext, "group", name, version, icon, group_nbo, name_nbo)',
    "blog_links": f"select page_id, link from (select page_id, unnest(regexp_extract_all(replace(html, 'href=\"/t', 'href=\"/wp-t'), {LINKS}, 1)) as link from pages) where not contains(link, 'wp-')",
    "redirect_links": "select url as src, 'http://www.example.com/' || page_id as dst from pages where page_id % 10 = 1",
    "expired_results": "select event_id from events where user_id + event_id % 100 < 60",
    "next_runs": "select s_suppkey as id, (case when s_suppkey % 4 = 0 then -1 else greatest(0, s_suppkey * 100 + s_suppkey % 4 * 3600 - 9000) end)::bigint as seconds from supplier",
    "collections_like": "select source as collection, max(doc_id) as last_doc, count(distinct doc_id // 100) as n_lots from documents where contains(source, '1') group by source",
    "pages_of_lots": "select page_id as doc_id, page_id // 50 as lot from pages where (page_id // 50) % 2 = 0 and page_id // 50 < 1000",
    "keys_without_space": "select item_id, substr(text, 1, 9) as key from benchmark where not contains(substr(text, 1, 9), ' ')",
    "time_text": "select event_id, case when event_id % 9 = 0 then -1 else epoch(date_trunc('second', ts))::bigint end as seconds from events",
}
