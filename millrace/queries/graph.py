"""Pages: links, hosts, mark-up, redirects, and crawl rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text, urls
from millrace.operators import access, crawling, links

from .tables import EDGES, edges, read


def _ranks(spark, sf):
    return read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), (F.col("page_id") % 97).alias("rank"))


def link_extract(spark, sf):
    return edges(spark, sf)


def in_links(spark, sf):
    return links.in_links(edges(spark, sf), _ranks(spark, sf))


def out_degree(spark, sf):
    return links.out_degree(edges(spark, sf))


def anchor_texts(spark, sf):
    a = links.anchors(edges(spark, sf))
    return a.select("dst", "n", F.array_join("texts", " ").alias("texts"))


def link_rank(spark, sf):
    return links.link_rank(edges(spark, sf), _ranks(spark, sf), 3).select("doc_id", F.round("rank", 6).alias("rank"))


def unclustered_links(spark, sf):
    """Targets in several runs of their source host's links."""
    e = edges(spark, sf).withColumn("part", F.col("src") % 4)
    return links.unclustered(e.groupBy("part", "src", "dst").agg(F.min("link").alias("link")).withColumn("place", F.concat_ws("|", F.lpad(F.col("src").cast("string"), 12, "0"), F.lpad(F.col("dst").cast("string"), 12, "0"))), "place")


def bad_links(spark, sf):
    errors = read(spark, sf, "pages").where(F.col("page_id") % 11 == 0).select(F.col("page_id").alias("dst"), F.lit("404").alias("error"))
    b = links.bad_links(edges(spark, sf), errors)
    return b.select("dst", "error", F.array_join(F.transform("referrers", lambda x: x.cast("string")), ",").alias("referrers"))


def url_parts(spark, sf):
    p = urls.parts(F.col("url"))
    return read(spark, sf, "pages").select("page_id", *(c.alias(k) for k, c in p.items()))


def url_host_counts(spark, sf):
    return read(spark, sf, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.countDistinct(urls.path(F.col("url"))).alias("n_paths"))


def domains_per_group(spark, sf):
    """Hosts that share a first path segment, where three or more do."""
    seg = F.element_at(F.split(urls.path(F.col("url")), "/"), 2)
    return read(spark, sf, "pages").groupBy(seg.alias("segment")).agg(F.countDistinct(urls.host(F.col("url"))).alias("n")).where("n >= 3")


def url_normalise(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.normalise(F.col("url")).alias("url"))


def url_clean(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.without_query(F.regexp_replace("url", "#.*$", "")).alias("url"), urls.is_valid(F.col("url")).alias("valid"), urls.regular_host(urls.host(F.col("url"))).alias("host"))


def same_host_first(spark, sf):
    from millrace.operators.facets import first_of_equal

    p = read(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), F.length("html").alias("size"))
    return first_of_equal(p, "host", F.desc("size"), F.asc("page_id")).select("host", "page_id", F.col("size").cast("long").alias("size"))


def html_strip(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("sum"))


def html_summary(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.summary(F.col("html")).alias("s")).select("page_id", "s.title", F.md5("s.body").alias("body_sum"))


def html_units(spark, sf):
    from millrace.sources.html import units

    return units(read(spark, sf, "pages"), "page_id", "html")


def robots(spark, sf):
    return read(spark, sf, "pages").select("page_id", crawling.storable(F.col("html")).alias("storable"), (~urls.robots_blocks(F.col("html"), "nofollow")).alias("follow"))


def redirect_classify(spark, sf):
    p = read(spark, sf, "pages")
    n = p.select(urls.host(F.col("url")).alias("host"), "page_id", "url")
    code = F.when(F.col("page_id") % 5 == 0, 301).when(F.col("page_id") % 7 == 0, 302).otherwise(200)
    body = F.when(F.col("page_id") % 3 == 0, F.lit("/moved/here")).when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https", "http")).otherwise(F.lit("nowhere"))
    known = p.groupBy("url").agg(F.min("page_id").alias("doc_id")).where(F.col("url").startswith("http://"))
    r = links.resolved_redirects(n.select(F.col("page_id").alias("doc_id"), code.alias("response"), "host", body.alias("body")), known)
    return r.withColumn("to", F.coalesce("to", F.lit(-1)))


def response_histogram(spark, sf):
    return read(spark, sf, "pages").groupBy(F.when(F.col("page_id") % 5 == 0, 301).when(F.col("page_id") % 7 == 0, 302).otherwise(200).alias("response")).agg(F.count("*").alias("n"))


def near_urls(spark, sf):
    p = read(spark, sf, "pages").select("url", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    starts = p.groupBy("host").agg(F.min(F.regexp_extract("path", "^(/[^/]*)", 1)).alias("path"))
    return crawling.near(p, starts).select("url", "host")


def crawl_rules(spark, sf):
    p = read(spark, sf, "pages").select("url", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path")).distinct()
    rules = p.where("host like '%a%'").select("host", F.when(F.length("host") % 2 == 0, "/en").otherwise("").alias("prefix")).distinct()
    return crawling.allowed(p, rules).withColumn("allowed", F.col("allowed").cast("string")).withColumn("allowed", F.coalesce("allowed", F.lit("unknown")))


def blocklist_suffix(spark, sf):
    p = read(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return access.without_blocked(p, spark.createDataFrame([("example.org",), ("blog.example.net",), ("tiontion.example.com",)], "suffix string"))


def domain_ban(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.substring_index(urls.host(F.col("url")), ".", -2).alias("domain"))
    return access.without_banned(p, spark.createDataFrame([("example.net",)], "domain string"))


def unseen_urls(spark, sf):
    p = read(spark, sf, "pages").select("url")
    return crawling.unseen(p, p.where(F.col("url").contains("blog.")))


def url_lookup(spark, sf):
    """Links' targets by the SHA-1 of their URL: how many are known."""
    p = read(spark, sf, "pages").select(F.sha1("url").alias("sha"), "page_id")
    asked = read(spark, sf, "pages").select(F.sha1(F.regexp_replace("url", "#.*$", "")).alias("sha"))
    return asked.join(p.groupBy("sha").agg(F.min("page_id").alias("doc_id")), "sha", "left").agg(F.count_if(F.col("doc_id").isNotNull()).alias("found"), F.count_if(F.col("doc_id").isNull()).alias("not_found"))


QUERIES = {f.__name__: f for f in (link_extract, in_links, out_degree, anchor_texts, link_rank, unclustered_links, bad_links, url_parts, url_host_counts, domains_per_group, url_normalise, url_clean, same_host_first, html_strip, html_summary, html_units, robots, redirect_classify, response_histogram, near_urls, crawl_rules, blocklist_suffix, domain_ban, unseen_urls, url_lookup)}
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"
_PATH0 = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
_PATH = f"(case when {_PATH0} = '' then '/' else {_PATH0} end)"
_HP = f"hp as (select page_id, url, html, {_HOST} as host, {_PATH} as path from pages)"
_RANK = """r0 as (select page_id as doc_id, (page_id % 97)::double as rank from pages)"""
_STEP = "r{1} as (select r.doc_id, r.rank + coalesce(m.more, 0) as rank from r{0} r left join (select dst, sum(rank + 0.85) / 10 as more from edges join r{0} on src = doc_id group by dst) m on m.dst = r.doc_id)"
_CODE = "case when page_id % 5 = 0 then 301 when page_id % 7 = 0 then 302 else 200 end"
SQL = {
    "link_extract": f"with {EDGES} select src, dst, link from edges",
    "in_links": f"with {EDGES}, own as (select distinct src, dst from edges), deg as (select src, count(*) as out_degree from own group by src) select dst, src, src % 97 as rank, out_degree from own join deg using (src)",
    "out_degree": f"with {EDGES} select src, count(*) as n_links, count(distinct dst) as n_targets from edges group by src",
    "anchor_texts": f"with {EDGES} select dst, count(*) as n, string_agg(distinct link, ' ' order by link) as texts from edges group by dst",
    "link_rank": f"with {EDGES}, {_RANK}, {_STEP.format(0, 1)}, {_STEP.format(1, 2)}, {_STEP.format(2, 3)} select doc_id, round(rank, 6) as rank from r3",
    "unclustered_links": f"with {EDGES}, e as (select distinct src % 4 as part, src, dst from edges), w as (select part, dst, lag(dst) over (partition by part order by src, dst) as last from e) select part, dst, count(*) as n_runs from w where last is null or last <> dst group by part, dst having count(*) > 1",
    "bad_links": f"with {EDGES} select dst, '404' as error, string_agg(src, ',' order by src) as referrers from (select distinct src, dst from edges) where dst % 11 = 0 group by dst",
    "url_parts": f"""with {_HP} select page_id, host, regexp_replace(host, '^www[.]', '') as host_no_www, array_to_string(string_split(host, '.')[-2:], '.') as domain, string_split(host, '.')[-1] as tld, greatest(len(string_split(host, '.')) - 2, 0)::bigint as n_subdomains,
        len(list_filter(string_split(path, '/'), lambda s: s <> ''))::bigint as depth, length(path)::bigint as path_length from hp""",
    "url_host_counts": f"with {_HP} select host, count(*) as n, count(distinct path) as n_paths from hp group by host",
    "domains_per_group": f"with {_HP} select string_split(path, '/')[2] as segment, count(distinct host) as n from hp group by 1 having count(distinct host) >= 3",
    "url_clean": f"with {_HP} select page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', ''), '(?i)/default[.]aspx$', '/') as url, regexp_matches(url, '(?i)^https?://[a-z0-9-]+([.][a-z0-9-]+)+(:[0-9]+)?([/?#]|$)') and not contains(lower(url), 'javascript:') as valid, host from hp",
    "same_host_first": f"with {_HP} select host, page_id, size from (select host, page_id, length(html) as size, row_number() over (partition by host order by length(html) desc, page_id) as p from hp) where p = 1",
    "url_normalise": """with a as (select page_id, trim(url) as u from pages), b as (select page_id, u, lower(regexp_extract(u, '(?i)^(https?)://', 1)) as sc, lower(regexp_extract(u, '(?i)^https?://([^/?#]*)', 1)) as h, regexp_extract(u, '(?i)^https?://[^/?#]*([^#]*)', 1) as r from a),
        c as (select page_id, sc, r, sc = '' or contains(lower(r), 'javascript:') as bad, case when sc = 'http' then regexp_replace(h, ':80$', '') else regexp_replace(h, ':443$', '') end as h from b),
        d as (select page_id, sc, bad, case when regexp_full_match(h, '.*[.](?:com|net|org|no)index[.][a-z]+') then regexp_extract(h, '^(.*[.](?:com|net|org|no))index[.][a-z]+$', 1) else h end as h, case when regexp_full_match(h, '.*[.](?:com|net|org|no)index[.][a-z]+') then '/' || regexp_extract(h, '(index[.][a-z]+)$', 1) || r else r end as r from c),
        e as (select page_id, sc, bad or not regexp_full_match(h, '[a-z0-9-]+([.][a-z0-9-]+)+(:[0-9]+)?') as bad, case when length(h) - length(replace(h, '.', '')) = 1 then 'www.' || h else h end as h, case when starts_with(r, '/') then r else '/' || r end as r from d),
        f as (select *, string_split(string_split(r, '?')[1], '/')[2:] as p from e)
        select page_id, case when not bad and len(list_filter(range(1, len(p) + 1), lambda i: len(list_filter(range(2, len(p) // 3 + 1), lambda k: i + 3 * k - 1 <= len(p) and not list_contains(p[i:i + k - 1], '') and p[i:i + k - 1] = p[i + k:i + 2 * k - 1] and p[i:i + k - 1] = p[i + 2 * k:i + 3 * k - 1])) > 0)) = 0 then sc || '://' || h || r end as url from f""",
    "html_summary": """select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title,
        md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|title)[^>]*>.*?</(?:script|style|title)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) as body_sum from pages""",
    "html_strip": "select page_id, md5(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\\x01-\\x0a]', '', 'g')) as sum from pages",
    "robots": "select page_id, strlen(html) <= 26214400 and not regexp_matches(html, '(?is)<meta\\s+name\\s*=\\s*[\"'']?robots[^>]*noindex') as storable, not regexp_matches(html, '(?is)<meta\\s+name\\s*=\\s*[\"'']?robots[^>]*nofollow') as follow from pages",
    "redirect_classify": f"""with {_HP}, r as (select page_id as doc_id, {_CODE} as response, case when page_id % 3 = 0 then 'http://' || host || '/moved/here' when page_id % 2 = 0 then regexp_replace(url, '^https', 'http') else 'nowhere' end as target,
        case when page_id % 3 = 0 then '/moved/here' when page_id % 2 = 0 then regexp_replace(url, '^https', 'http') else 'nowhere' end as body from hp),
        known as (select url, min(page_id) as to_ from pages where starts_with(url, 'http://') group by url),
        c as (select r.*, k.to_, case when response not in (301, 302) then 'not_redirect' when length(body) >= 200 then 'too_long' when not regexp_matches(target, '(?i)^https?://[a-z0-9-]+([.][a-z0-9-]+)+(:[0-9]+)?([/?#]|$)') or not starts_with(target, 'http://') then 'bad_url' end as first from r left join known k on k.url = r.target)
        select doc_id, target, coalesce(first, case when to_ is not null then 'found' else 'new' end) as class, coalesce(case when first is null then to_ end, -1) as "to" from c""",
    "response_histogram": f"select {_CODE} as response, count(*) as n from pages group by 1",
    "near_urls": f"with {_HP}, s as (select host, min(regexp_extract(path, '^(/[^/]*)', 1)) as start from hp group by host) select distinct url, host from hp join s using (host) where regexp_matches(path, start)",
    "crawl_rules": f"""with {_HP}, p as (select distinct url, host, path from hp) select url, case when host not like '%a%' then 'unknown' when length(host) % 2 = 0 and starts_with(path, '/en') then '0' else '1' end as allowed from p""",
    "blocklist_suffix": f"with {_HP} select page_id, host from hp where not (host = 'example.org' or host like '%.example.org' or host = 'blog.example.net' or host like '%.blog.example.net' or host = 'tiontion.example.com' or host like '%.tiontion.example.com')",
    "domain_ban": f"with {_HP} select page_id, array_to_string(string_split(host, '.')[-2:], '.') as domain from hp where array_to_string(string_split(host, '.')[-2:], '.') <> 'example.net'",
    "unseen_urls": "select distinct url from pages where url not like '%blog.%'",
    "url_lookup": "with k as (select distinct sha1(url) as sha from pages), a as (select sha1(regexp_replace(url, '#.*$', '')) as sha from pages) select count(*) filter (where k.sha is not null) as found, count(*) filter (where k.sha is null) as not_found from a left join k using (sha)",
}
