"""Search: postings, boolean retrieval, ranking, access, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import ranks
from millrace.functions.text import EDGES, tokens
from millrace.operators import facets, search
from millrace.operators.access import visible
from millrace.plans.query import Thesaurus, run_query

from .tables import CRC32, DOCS, PATTERN, TOKENS, docs, read


def _posts(spark, sf, *terms, keep=()):
    return search.postings(read(spark, sf, "documents"), terms, keep=keep)


def tokens_df(spark, sf):
    return search.document_frequency(read(spark, sf, "documents"))


def postings_build(spark, sf):
    p = search.postings(read(spark, sf, "documents"), keep=("lang",))
    return p.select("term", "doc_id", "lang", F.size("positions").cast("long").alias("n_hits"), F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


def and_search(spark, sf):
    return search.match_all(_posts(spark, sf, "the", "and"), ["the", "and"])


def or_search(spark, sf):
    return search.match_any(_posts(spark, sf, "that", "der"), ["that", "der"])


def not_search(spark, sf):
    p = _posts(spark, sf, "the", "from", "with")
    return search.match_none_of(search.match_all(p, ["the", "from"]), p, ["with"])


def phrase_search(spark, sf):
    return search.match_phrase(_posts(spark, sf, "of", "the"), ["of", "the"])


def phrase_gap_search(spark, sf):
    return search.match_phrase(_posts(spark, sf, "the", "and"), ["the", None, "and"])


def prox_search(spark, sf):
    return search.match_near(_posts(spark, sf, "the", "from"), "the", "from")


def ranked_search(spark, sf):
    """Three words in the body, the first of them in the first line as a title, with the documents' short rank."""
    d = search.with_fields(read(spark, sf, "documents").select("doc_id", "text", F.col("n_chars").alias("rank")))
    return search.page(search.rank_fields(search.postings(d, ["the", "from", "that"], keep=("field", "rank"))), 1, 10)


def lang_filter(spark, sf):
    p = _posts(spark, sf, "de", "la", keep=("lang",)).where(F.col("lang").isin("fr", "es"))
    return p.groupBy("term", "lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("positions")).cast("long").alias("n_hits"))


def collection_counts(spark, sf):
    return read(spark, sf, "documents").groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last_doc"))


def acl_search(spark, sf):
    d = docs(spark, sf).where(visible(["u1", "src3", "Everyone", "de"], F.col("acl_allow"), F.col("acl_denied")))
    return search.match_any(search.postings(d, ["the", "und"]), ["the", "und"])


def synonym_expand(spark, sf):
    words = Thesaurus([(1, "the"), (1, "that"), (2, "from"), (2, "by"), (2, "of")])
    return run_query(spark.read.parquet(f"{sf}/documents.parquet"), "the from", thesaurus=words).select("doc_id", "score")


def boolean_query(spark, sf):
    return run_query(read(spark, sf, "documents").withColumn("collection", F.col("source")), '"of the" and -"in the" collection:"src3"').select("doc_id", "score")


def paging(spark, sf):
    found = search.match_any(_posts(spark, sf, "the", "le"), ["the", "le"])
    return search.page(found, 3, 10)


def dedupe_text(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("sum"))
    return d.groupBy("sum").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("copies")).where("n > 1")


def adult_filter(spark, sf):
    """Documents not marked as unsuitable; those without a mark count as suitable."""
    d = read(spark, sf, "documents").select("doc_id", "lang")
    marks = read(spark, sf, "labels").select("doc_id", "toxic")
    return d.join(marks, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0).groupBy("lang").agg(F.count("*").alias("n"))


def adult_flag(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") % 100 >= 50, 1).otherwise(0).alias("flag"))


def rank_range(spark, sf):
    return read(spark, sf, "documents").where(F.col("n_chars").between(1000, 2000)).select("doc_id", F.col("n_chars").alias("rank"), "lang")


def short_rank(spark, sf):
    return read(spark, sf, "documents").select("doc_id", ranks.short_rank(F.col("n_chars")).alias("short_rank"))


def rank_bucket_sort(spark, sf):
    b = ranks.rank_bucket(F.col("n_chars"))
    return read(spark, sf, "documents").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


def rank_histogram(spark, sf):
    got = read(spark, sf, "documents").groupBy(ranks.short_rank(F.col("n_chars")).cast("long").alias("id")).agg(F.count("*").alias("n"))
    return spark.range(256).join(got, "id", "left").select(F.col("id").alias("short_rank"), F.coalesce("n", F.lit(0)).alias("n"))


def rank_merge(spark, sf):
    d = read(spark, sf, "documents")
    ext, inn, noc = (d.select("doc_id", (F.col("doc_id") % k).alias(n)) for k, n in ((1000, "ext"), (7, "internal"), (5, "noc")))
    x = ext.join(inn, "doc_id", "full_outer").join(noc, "doc_id", "full_outer")
    return x.select("doc_id", ranks.merged_rank(F.col("ext"), F.col("internal"), F.col("noc")).alias("pop"))


def set_ops(spark, sf):
    """Union, intersection and difference of the distinct tokens of each language with English."""
    w = read(spark, sf, "documents").select("lang", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    en, other = w.where("lang = 'en'").select("term"), w.where("lang = 'de'").select("term")
    return en.union(other).distinct().agg(F.count("*").alias("n")).select(F.lit("union").alias("op"), "n").union(en.intersect(other).agg(F.count("*")).select(F.lit("intersect"), "count(1)")).union(en.subtract(other).agg(F.count("*")).select(F.lit("except"), "count(1)"))


def partition_hash(spark, sf):
    return tokens_df(spark, sf).groupBy(search.term_partition(F.col("term")).alias("part")).agg(F.count("*").alias("n"))


def facet_counts(spark, sf):
    return facets.counts(_attributes(spark, sf))


def _attributes(spark, sf):
    d = read(spark, sf, "documents")
    size = F.when(F.col("n_chars") < 1000, "small").when(F.col("n_chars") < 5000, "medium").otherwise("large")
    return d.select("doc_id", F.inline(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("lang", F.col("lang")), ("source", F.col("source")), ("size", size))))))


def facet_topk(spark, sf):
    return facets.shown(facets.counts(_attributes(spark, sf)), 5, hidden=("src3",)).select("key", "value", "n", "place")


def attr_roundtrip(spark, sf):
    from millrace.functions.text import attribute_pairs, attribute_text

    d = read(spark, sf, "documents")
    m = F.map_from_arrays(F.array(F.lit("lang"), F.lit("source")), F.array(F.array("lang"), F.array("source", F.concat("source", F.lit(",x=1")))))
    t = d.select("doc_id", attribute_text(m).alias("wire"))
    return t.select("doc_id", "wire", F.explode(attribute_pairs(F.col("wire"))).alias("p")).select("doc_id", "wire", "p.key", "p.value")


def highlighted(spark, sf):
    from millrace.functions.text import highlight

    d = read(spark, sf, "benchmark")
    return d.select("item_id", highlight(F.col("text"), ["the", "and"]).alias("marked"))


def snippets(spark, sf):
    from millrace.functions.text import snippet

    return read(spark, sf, "documents").select("doc_id", snippet(F.col("text"), ["the", "from"], 12).alias("snippet"))


QUERIES = {f.__name__: f for f in (tokens_df, postings_build, and_search, or_search, not_search, phrase_search, phrase_gap_search, prox_search, ranked_search, lang_filter, collection_counts, acl_search, synonym_expand, boolean_query, paging, dedupe_text, adult_filter, adult_flag, rank_range, short_rank, rank_bucket_sort, rank_histogram, rank_merge, set_ops, partition_hash, facet_counts, facet_topk, attr_roundtrip, highlighted, snippets)}

_POINTS = {k: "[" + ", ".join(map(str, v)) + "]" for k, v in ranks.FIELD_POINTS.items()}
_SHORT = "case when {0} <= 0 then 0 else least(255, floor(log10({0}) * 53)) end::int"
_SIZE = "case when n_chars < 1000 then 'small' when n_chars < 5000 then 'medium' else 'large' end"
_ATTR = f"attr as (select doc_id, 'lang' as key, lang as value from documents union all select doc_id, 'source', source from documents union all select doc_id, 'size', {_SIZE} from documents)"
_COUNTED = f"{_ATTR}, counted as (select key, value, count(*) as n from attr group by grouping sets ((key, value), (key)))"
_MARK = r"(?i)(^|[^\p{L}\p{N}_@])(the|and)($|[^\p{L}\p{N}_])"
SQL = {
    # words that share a mark between them are met in two turns; the second passes over what the first has marked
    "highlighted": f"select item_id, regexp_replace(regexp_replace(text, '{_MARK.replace('@', '')}', '\\1<b>\\2</b>\\3', 'g'), '{_MARK.replace('@', '>')}', '\\1<b>\\2</b>\\3', 'g') as marked from benchmark",
    "snippets": f"""with p as (select doc_id, text is null as gone, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') as w from documents),
        h as (select *, list_transform(w, lambda x: (regexp_replace(lower(x), '{EDGES.replace("'", "''")}', '', 'g') in ('the', 'from'))::int) as h from p),
        s as (select *, list_transform(range(0, greatest(len(w) - 12, 0) + 1), lambda i: coalesce(list_sum(h[i + 1:i + 12]), 0)) as t from h), a as (select *, list_position(t, list_max(t)) - 1 as i from s)
        select doc_id, case when gone then null else case when i > 0 then '… ' else '' end || array_to_string(w[i + 1:i + 12], ' ') || case when i + 12 < len(w) then ' …' else '' end end as snippet from a""",
    "partition_hash": f"with {TOKENS}, t as (select distinct term from tok) select {CRC32.format('term')} % 64 as part, count(*) as n from t group by 1",
    "tokens_df": f"with {TOKENS} select term, count(distinct doc_id) as n_docs, count(*) as n_hits from tok group by term",
    "postings_build": f"with {TOKENS} select term, doc_id, lang, count(*) as n_hits, string_agg(pos, ',' order by pos) as positions from tok group by term, doc_id, lang",
    "and_search": f"with {TOKENS} select doc_id, count(*) as score from tok where term in ('the', 'and') group by doc_id having count(distinct term) = 2",
    "or_search": f"with {TOKENS} select doc_id, count(*) as score from tok where term in ('that', 'der') group by doc_id",
    "not_search": f"with {TOKENS} select doc_id, count(*) as score from tok where term in ('the', 'from') and doc_id not in (select doc_id from tok where term = 'with') group by doc_id having count(distinct term) = 2",
    "phrase_search": f"with {TOKENS} select a.doc_id, count(*) as n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the' group by a.doc_id",
    "phrase_gap_search": f"with {TOKENS} select a.doc_id, count(*) as n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 2 where a.term = 'the' and b.term = 'and' group by a.doc_id",
    "prox_search": f"""with {TOKENS}, two as (select * from tok where term in ('the', 'from')),
        near as (select a.doc_id, min(abs(a.pos - b.pos)) as distance from two a join two b on a.doc_id = b.doc_id where a.term = 'the' and b.term = 'from' group by a.doc_id),
        hits as (select doc_id, count(*) as h from two group by doc_id)
        select doc_id, distance, (h + 10 // distance)::bigint as score from near join hits using (doc_id)""",
    "ranked_search": f"""with {TOKENS}, tw as (select doc_id, regexp_extract_all(lower(string_split(coalesce(text, ''), chr(10))[1]), {PATTERN}) as w from documents),
        tt as (select doc_id, unnest(w) as term, generate_subscripts(w, 1) - 1 as pos from tw),
        body as (select doc_id, term, list_extract({_POINTS['body']}, least(count(*), {len(ranks.FIELD_POINTS['body'])})::int) as s from tok where term in ('the', 'from', 'that') group by doc_id, term),
        title as (select doc_id, term, {ranks.FIELD_POINTS['title'][0]} + case when min(pos) = 0 then {ranks.FIRST_TITLE_WORD} else 0 end as s from tt where term in ('the', 'from', 'that') group by doc_id, term),
        both_ as (select doc_id, sum(s) as s from (select * from body union all select * from title) group by doc_id)
        select doc_id, (s + {_SHORT.format('n_chars')})::bigint as score from both_ join documents using (doc_id) order by score desc, doc_id limit 10""",
    "lang_filter": f"with {TOKENS} select term, lang, count(distinct doc_id) as n_docs, count(*) as n_hits from tok where term in ('de', 'la') and lang in ('fr', 'es') group by term, lang",
    "collection_counts": "select source as collection, count(*) as n, max(doc_id) as last_doc from documents group by source",
    "acl_search": f"with {DOCS}, {TOKENS} select doc_id, count(*) as score from tok join docs using (doc_id) where term in ('the', 'und') and list_has_any(acl_allow, ['u1', 'src3', 'Everyone', 'de']) and not list_has_any(acl_denied, ['u1', 'src3', 'Everyone', 'de']) group by doc_id",
    "synonym_expand": f"""with {TOKENS} select doc_id, count(*) as score from tok where term in ('the', 'that', 'from', 'by', 'of') group by doc_id
        having count(*) filter (where term in ('the', 'that')) > 0 and count(*) filter (where term in ('from', 'by', 'of')) > 0""",
    "boolean_query": f"""with {TOKENS}, p as (select a.doc_id, count(*) as n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the' group by a.doc_id)
        select doc_id, (n + count(*))::bigint as score from tok join p using (doc_id) where term = 'and' and source = 'src3' and doc_id not in (select a.doc_id from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'in' and b.term = 'the') group by doc_id, n""",
    "paging": f"with {TOKENS} select doc_id, count(*) as score from tok where term in ('the', 'le') group by doc_id order by score desc, doc_id limit 10 offset 20",
    "dedupe_text": "select md5(coalesce(text, '')) as sum, min(doc_id) as doc_id, count(*) as n, string_agg(doc_id, ',' order by doc_id) as copies from documents group by 1 having count(*) > 1",
    "adult_filter": "select lang, count(*) as n from documents left join labels using (doc_id) where coalesce(toxic, 0) = 0 group by lang",
    "adult_flag": "select doc_id, (n_chars % 100 >= 50)::int as flag from documents",
    "rank_range": "select doc_id, n_chars as rank, lang from documents where n_chars between 1000 and 2000",
    "short_rank": f"select doc_id, {_SHORT.format('n_chars')} as short_rank from documents",
    "rank_bucket_sort": "select (case when n_chars <= 0 then 0 else ceil(ln(n_chars)) end)::bigint as bucket, count(*) as n, min(n_chars) as least, max(n_chars) as most from documents group by 1",
    "rank_histogram": f"select r.range as short_rank, count(d.s) as n from range(256) r left join (select {_SHORT.format('n_chars')} as s from documents) d on d.s = r.range group by 1",
    "rank_merge": "select doc_id, case when doc_id % 1000 = 0 then 1 else doc_id % 1000 end as pop from documents",
    "set_ops": f"with {TOKENS}, en as (select distinct term from tok where lang = 'en'), de as (select distinct term from tok where lang = 'de') select 'union' as op, count(*) as n from (from en union from de) union all select 'intersect', count(*) from (from en intersect from de) union all select 'except', count(*) from (from en except from de)",
    "facet_counts": f"with {_COUNTED} select * from counted",
    "facet_topk": f"with {_COUNTED} select key, value, n, place from (select *, row_number() over (partition by key order by n desc, value) as place from counted where value is not null and value <> 'src3') where place <= 5",
    "attr_roundtrip": "select doc_id, wire, string_split(p, '=')[1] as key, string_split(p, '=')[2] as value from (select doc_id, wire, unnest(string_split(wire, ',')) as p from (select doc_id, 'lang=' || lang || ',source=' || source || ',source=' || source || ' x 1' as wire from documents))",
}
