"""Logs and lists as rows, dictionaries, lots and other small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import ranks
from millrace.functions.text import tokens
from millrace.functions.urls import host
from millrace.operators import admin, ingest, records, search

from .search import _attributes
from .tables import CRC32, PATTERN, TOKENS, log, read


def index_log(spark, sf):
    k = F.col("o_orderkey").cast("string")
    line = F.concat(k, F.lit(" new="), (F.col("o_custkey") % 9).cast("string"), F.lit(",recrawled="), (F.col("o_custkey") % 5).cast("string"), F.when(F.col("o_orderkey") % 10 > 0, F.lit(",untouched=7")).otherwise(F.lit(" broken")))
    return records.index_runs(read(spark, sf, "orders").select(line.alias("value")))


def unknown_types(spark, sf):
    return records.counted_tails(read(spark, sf, "orders").select(F.concat(F.lit("unknown file type: "), "o_orderpriority").alias("value")))


def access_log_users(spark, sf):
    e = read(spark, sf, "events")
    return records.requests_by_user(e.select(F.concat(F.lit("GET /x "), F.when(F.col("event_type") == "error", F.lit("-")).otherwise(F.concat(F.lit("user="), F.col("user_id").cast("string"))), F.lit(" 200")).alias("value")))


def media_types(spark, sf):
    kinds = F.array(*map(F.lit, ["text/html; charset=utf-8", "application/PDF", "image/png", "x-own/thing"]))
    p = read(spark, sf, "pages").select(F.element_at(kinds, (F.col("page_id") % 4 + 1).cast("int")).alias("kind"))
    return p.groupBy(F.coalesce(records.media_extension(F.col("kind")), F.lit("?")).alias("extension")).agg(F.count("*").alias("n"))


def attribute_decode(spark, sf):
    a = _attributes(spark, sf)
    index = a.select("doc_id", "key", F.crc32("value").alias("crc32"))
    return records.decoded(index, records.value_dictionary(a)).groupBy("key", "value").agg(F.count("*").alias("n"))


def zone_domains(spark, sf):
    h = host(F.col("url"))
    lines = read(spark, sf, "pages").select(F.concat(F.upper(h), F.lit(". "), F.when(F.col("page_id") % 3 > 0, F.lit("ns")).otherwise(F.lit("A")), F.lit(" x.example.")).alias("value"))
    return records.registered_domains(lines)


def first_column(spark, sf):
    return records.first_columns(read(spark, sf, "benchmark").select(F.col("text").alias("value"))).groupBy("value").agg(F.count("*").alias("n"))


def small_lots(spark, sf):
    d = read(spark, sf, "documents").select(ingest.lot(F.col("doc_id"), 100).alias("lot"), F.octet_length("text").cast("long").alias("size"))
    return records.small_lots(d, 250_000)


def sizes_as_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", ranks.byte_size(F.col("n_chars") * 1000003).alias("size"))


def case_listing(spark, sf):
    return read(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.upper("c_name")).alias("name")).orderBy(F.lower("name"), "name")


def log_tail(spark, sf):
    return log(spark, sf).orderBy(F.desc("id")).limit(250).select("id", "query")


def merged_servers(spark, sf):
    """Four servers, each with the collections of its number, answer the same query; one list of twenty."""
    d = read(spark, sf, "documents")
    part = F.substring("source", 4, 10).cast("int") % 4
    own = [search.page(search.match_any(search.postings(d.where(part == k), ["the", "und"]), ["the", "und"]), 1, 20) for k in range(4)]
    return records.merged(own, 20)


def supported_languages(spark, sf):
    return read(spark, sf, "documents").groupBy(F.col("lang").isin(*records.LANGUAGES[:3]).alias("supported")).agg(F.count("*").alias("n"))


def redirect_resource(spark, sf):
    """Every page as a redirect, with the text length of the page it leads to."""
    p = read(spark, sf, "pages")
    r = p.select("page_id", F.floor(F.col("page_id") / 5).alias("to"))
    return r.join(p.select(F.col("page_id").alias("to"), F.length("html").cast("long").alias("size")), "to").select("page_id", "to", "size")


def posting_scan(spark, sf):
    """Document frequency and hits of chosen terms by language."""
    terms = ["the", "und", "les", "que"]
    p = search.postings(read(spark, sf, "documents"), terms, keep=("lang",))
    return p.groupBy("term", "lang").agg(F.countDistinct("doc_id").alias("n_docs"), F.max(F.element_at("positions", 1)).cast("long").alias("latest_first"))


def url_partitions(spark, sf):
    """URLs by their partition of 64, and how many share it."""
    p = read(spark, sf, "pages").select((F.crc32("url") % 64).alias("part"), "url")
    return p.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"))


def sid_list(spark, sf):
    raw = F.concat(F.lit(bytes([1, 2, 0, 0, 0, 0, 0, 5, 32, 0, 0, 0])), F.unhex(F.lpad(F.hex(F.col("c_custkey") % 256), 2, "0")), F.lit(bytes([2, 0, 0])))
    s = records.sid_text(raw)
    return read(spark, sf, "customer").select("c_custkey", s.alias("sid"), records.with_last_part(s, F.lit(500)).alias("administrator"))


def sound_alikes(spark, sf):
    """Words of the benchmark by their sound."""
    w = read(spark, sf, "benchmark").select(F.explode(tokens(F.col("text"))).alias("word"))
    return w.groupBy(F.soundex("word").alias("sound")).agg(F.countDistinct("word").alias("n"), F.min("word").alias("first"))


def group_names(spark, sf):
    s = read(spark, sf, "orders").select(F.lower("o_orderpriority").alias("user")).distinct()
    return s.select("user", F.array_join(admin.group_of(F.col("user")), ",").alias("groups"))


def synonym_list(spark, sf):
    """Comma-separated synonyms cleaned: trimmed, without blanks and repeats."""
    rows = spark.createDataFrame([(1, " car, auto ,, car"), (2, "big,large, huge"), (3, " , ")], "id int, words string")
    w = rows.select("id", F.explode(F.split("words", ",")).alias("word")).select("id", F.trim("word").alias("word")).where("word <> ''").distinct()
    return w.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("word")), ",").alias("words"))


QUERIES = {f.__name__: f for f in (index_log, unknown_types, access_log_users, media_types, attribute_decode, zone_domains, first_column, small_lots, sizes_as_text, case_listing, log_tail, merged_servers, supported_languages, redirect_resource, posting_scan, url_partitions, sid_list, sound_alikes, group_names, synonym_list)}
_SIZE = "case when n_chars < 1000 then 'small' when n_chars < 5000 then 'medium' else 'large' end"
_H = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"
_CODE = "translate(regexp_replace(upper({0}), '[^A-Z]', 'A', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
_RUNS = f"{_CODE.format('w[1]')} || replace({_CODE.format('substr(w, 2)')}, '7', '')"
for _d in range(7):
    _RUNS = f"regexp_replace({_RUNS}, '{_d}+', '{_d}', 'g')"
SQL = {
    "sound_alikes": f"""with t as (select distinct unnest(regexp_extract_all(lower(text), {PATTERN})) as w from benchmark), s as (select w, case when regexp_matches(w, '^[a-z]') then upper(w[1]) || substr(replace(substr({_RUNS}, 2), '0', '') || '000', 1, 3) else w end as sound from t)
        select sound, count(*) as n, min(w) as first from s group by sound""",
    "url_partitions": f"select {CRC32.format('url')} % 64 as part, count(*) as n, count(distinct url) as n_urls from pages group by 1",
    "index_log": "select o_orderkey as time, o_custkey % 9 as new, o_custkey % 5 as recrawled, 7::bigint as untouched from orders where o_orderkey % 10 > 0",
    "unknown_types": "select o_orderpriority as value, count(*) as n from orders group by 1",
    "access_log_users": "select user_id::varchar as \"user\", count(*) as n from events where event_type <> 'error' group by 1",
    "media_types": "select case page_id % 4 when 0 then 'html' when 1 then 'pdf' when 2 then 'png' else '?' end as extension, count(*) as n from pages group by 1",
    "attribute_decode": f"with attr as (select 'lang' as key, lang as value from documents union all select 'source', source from documents union all select 'size', {_SIZE} from documents) select key, value, count(*) as n from attr group by 1, 2",
    "zone_domains": f"select distinct 'http://www.' || {_H} || '/' as url from pages where page_id % 3 > 0",
    "first_column": "select string_split(text, ' ')[1] as value, count(*) as n from benchmark group by 1",
    "small_lots": "select doc_id // 100 as lot, sum(strlen(text))::bigint as size from documents group by 1 having sum(strlen(text)) < 250000",
    "sizes_as_text": "select doc_id, case when b >= 1073741824 then printf('%.1fG', b / 1073741824.0) else printf('%.1fM', b / 1048576.0) end as size from (select doc_id, n_chars * 1000003 as b from documents)",
    "case_listing": "select name from (select case when c_custkey % 2 = 0 then lower(c_name) else upper(c_name) end as name from customer) order by lower(name), name",
    "log_tail": "select event_id as id, event_type as query from events order by id desc limit 250",
    "merged_servers": f"with {TOKENS} select doc_id, count(*) as score from tok where term in ('the', 'und') group by doc_id order by score desc, doc_id limit 20",
    "supported_languages": "select lang in ('de', 'en', 'es') as supported, count(*) as n from documents group by 1",
    "redirect_resource": "select a.page_id, b.page_id as \"to\", length(b.html) as size from pages a join pages b on b.page_id = a.page_id // 5",
    "posting_scan": f"with {TOKENS}, f as (select term, lang, doc_id, min(pos) as p from tok where term in ('the', 'und', 'les', 'que') group by 1, 2, 3) select term, lang, count(*) as n_docs, max(p) as latest_first from f group by 1, 2",
    "sid_list": "select c_custkey, 'S-1-5-32-' || (512 + c_custkey % 256) as sid, 'S-1-5-32-500' as administrator from customer",
    "group_names": "select distinct lower(o_orderpriority) as \"user\", lower(o_orderpriority) || ',' || string_split(lower(o_orderpriority), '-')[1] as groups from orders",
    "synonym_list": "select * from (values (1, 'auto,car'), (2, 'big,huge,large')) t(id, words)",
}
