"""Postings and the boolean, phrase, proximity and ranking operators over them.

Postings are a DataFrame (term, doc_id, positions, and any document columns kept). They are grouped inside each
document's row, so building them moves nothing; an index on disk is the same table written by term.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import ranks
from millrace.functions.text import positions, tokens

INDEX_PARTITIONS = 64


def postings(docs: DataFrame, terms: Sequence[str] | None = None, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """term, doc_id, positions (from 0), and the columns kept. With terms, only theirs: other rows are passed over early."""
    if terms is not None:
        wanted = list(dict.fromkeys(t.lower() for t in terms))
        low = F.lower(F.col(text))
        holds = [F.contains(low, F.lit(t)) for t in wanted]
        rows = docs.where(F.greatest(*holds, *holds[:1])).select(doc_id, *keep, F.explode(F.array(tokens(F.col(text)))).alias("words"))
        one = F.array(*(F.struct(F.lit(t).alias("term"), positions(F.col("words"), t).alias("positions")) for t in wanted))
        return rows.select(F.col(doc_id).alias("doc_id"), *keep, F.inline(F.filter(one, lambda x: F.size(x["positions"]) > 0))).select("term", "doc_id", "positions", *keep)
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.explode(F.array(_ordered(F.col(text)))).alias("s"))
    rows = rows.withColumn("a", F.explode(F.array(_starts(F.col("s")))))
    ends = F.concat(F.slice("a", 2, F.size("a")), F.array(F.size("s")))
    runs = F.zip_with("a", ends, lambda i, j: F.struct(F.get("s", i)["term"].alias("term"), F.transform(F.slice("s", i + 1, j - i), lambda x: x["pos"]).alias("positions")))
    return rows.where(F.size("s") > 0).select("doc_id", *keep, F.inline(runs)).select("term", "doc_id", "positions", *keep)


def _ordered(text: Column) -> Column:
    """A text's tokens as (term, pos), by term and place."""
    return F.sort_array(F.transform(tokens(text), lambda w, i: F.struct(w.alias("term"), i.alias("pos"))))


def _starts(s: Column) -> Column:
    """Where in an array of (term, pos) in order each term begins."""
    return F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())


def write_index(posts: DataFrame, path: str, collection: str = "collection") -> None:
    """One folder for each collection, each file holding a range of terms, so that a term's read prunes files."""
    posts.repartitionByRange(INDEX_PARTITIONS, collection, "term").sortWithinPartitions("term").write.mode("overwrite").partitionBy(collection).parquet(path)


def read_index(spark, path: str, terms: Sequence[str], collections: Sequence[str] = ()) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("term").isin(*terms))
    return rows.where(F.col("collection").isin(*collections)) if collections else rows


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, n_docs, n_hits: in a row's sorted tokens the first of a kind counts for the row,
    so that one pass and one shuffle of partial sums do for both."""
    rows = docs.select(F.explode(F.array(F.sort_array(tokens(F.col(text))))).alias("s"))
    first = lambda w, i: F.when((i == 0) | (F.get("s", i - 1) != w), 1).otherwise(0)
    rows = rows.select(F.explode(F.transform("s", lambda w, i: F.struct(w.alias("term"), first(w, i).alias("first")))).alias("x"))
    return rows.groupBy("x.term").agg(F.sum("x.first").cast("long").alias("n_docs"), F.count("*").alias("n_hits"))


def term_partition(term: Column) -> Column:
    return F.crc32(F.lower(term)) % INDEX_PARTITIONS


def score() -> Column:
    return F.sum(F.size("positions")).cast("long").alias("score")


def match_all(posts: DataFrame, terms: Sequence[str]) -> DataFrame:
    """doc_id, score of documents with every term."""
    wanted = sorted({t.lower() for t in terms})
    return posts.where(F.col("term").isin(*wanted)).groupBy("doc_id").agg(score(), F.count("*").alias("k")).where(F.col("k") == len(wanted)).drop("k")


def match_any(posts: DataFrame, terms: Sequence[str]) -> DataFrame:
    return posts.where(F.col("term").isin(*sorted({t.lower() for t in terms}))).groupBy("doc_id").agg(score())


def match_none_of(found: DataFrame, posts: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Matches without any document that has one of the terms."""
    return found.join(posts.where(F.col("term").isin(*sorted({t.lower() for t in terms}))).select("doc_id").distinct(), "doc_id", "left_anti")


def shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def match_phrase(posts: DataFrame, terms: Sequence[str | None]) -> DataFrame:
    """doc_id, n: documents where the terms follow one another, and how often. None stands for any one word."""
    places = [(k, t.lower()) for k, t in enumerate(terms) if t is not None]
    names = sorted({t for _, t in places})
    by = posts.where(F.col("term").isin(*names)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"), F.count("*").alias("k")).where(F.col("k") == len(names))
    starts = [shifted(F.element_at("m", t), k) for k, t in places]
    both = starts[0]
    for s in starts[1:]:
        both = F.array_intersect(both, s)
    return by.select("doc_id", F.size(both).cast("long").alias("n")).where("n > 0")


def match_near(posts: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, distance, score of documents with both terms. Our weighting: the hits of both, plus 10 over the distance
    of the nearest pair in whole points."""
    both = posts.where(F.col("term").isin(first, second)).groupBy("doc_id").agg(F.max(F.when(F.col("term") == first, F.col("positions"))).alias("a"), F.max(F.when(F.col("term") == second, F.col("positions"))).alias("b")).where("a is not null and b is not null")
    # positions are sorted: merged and tagged, only neighbours of different terms can be nearest
    merged = F.sort_array(F.concat(F.transform("a", lambda p: F.struct(p.alias("p"), F.lit(0).alias("t"))), F.transform("b", lambda p: F.struct(p.alias("p"), F.lit(1).alias("t")))))
    gaps = F.zip_with(F.slice("m", 1, F.size("m") - 1), F.slice("m", 2, F.size("m")), lambda x, y: F.when(x["t"] != y["t"], y["p"] - x["p"]))
    rows = both.withColumn("m", merged).select("doc_id", F.array_min(gaps).cast("long").alias("distance"), (F.size("a") + F.size("b")).alias("hits"))
    return rows.select("doc_id", "distance", (F.col("hits") + F.floor(F.lit(10) / F.col("distance"))).cast("long").alias("score"))


def rank_fields(posts: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """doc_id, score: postings with a column `field` give points by occurrences; their column `rank`, if they have one, or a
    table (doc_id, rank) adds its short rank.

    Our definition, as the tables' use is not known: points of each term and field are added up.
    """
    n = F.size("positions")
    by = F.lit(0).cast("long")
    for f in ranks.FIELD_POINTS:
        by = F.when(F.col("field") == f, ranks.points(f, n)).otherwise(by)
    by = F.when(F.col("field") == "main_url", ranks.MAIN_URL_WORD).otherwise(by)
    first = F.when((F.col("field") == "title") & F.array_contains("positions", 0), ranks.FIRST_TITLE_WORD).otherwise(0)
    if "rank" in posts.columns:
        rows = posts.groupBy("doc_id").agg(F.sum(by + first).alias("score"), F.max("rank").alias("rank"))
        return rows.select("doc_id", (F.col("score") + F.coalesce(ranks.short_rank(F.col("rank")), F.lit(0))).cast("long").alias("score"))
    rows = posts.groupBy("doc_id").agg(F.sum(by + first).alias("score"))
    if prior is None:
        return rows
    return rows.join(prior, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce(ranks.short_rank(F.col("rank")), F.lit(0))).cast("long").alias("score"))


def with_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document as two rows: its whole text as the body, its first line as the title; other columns on both."""
    both = F.array(F.struct(F.lit("body").alias("field"), F.col(text).alias(text)), F.struct(F.lit("title").alias("field"), F.substring_index(text, "\n", 1).alias(text)))
    return docs.select(*(c for c in docs.columns if c != text), F.inline(both))


ANCHOR = r'(?is)<a[^>]+href="([^"#]+)"[^>]*>(.*?)</a>'


def page_fields(pages: DataFrame, anchors: DataFrame | None = None, doc_id: str = "doc_id", url: str = "url", html: str = "html") -> DataFrame:
    """doc_id, field, text: each page's title, headlines, URL, the main word of its host, and body; the texts of links that
    lead to it (doc_id, text) as its anchors."""
    joined = lambda c: F.array_join(c, " ")
    labels = F.split(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1)), r"\.")
    fields = {
        "title": F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1),
        "headline": joined(F.regexp_extract_all(html, F.lit("(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))),
        "url": F.col(url),
        "main_url": F.coalesce(F.try_element_at(labels, F.lit(-2)), F.element_at(labels, -1)),
        "body": F.regexp_replace(F.regexp_replace(html, "(?is)<(?:script|style|title)[^>]*>.*?</(?:script|style|title)>", " "), "<[^>]*>", " "),
    }
    rows = pages.select(F.col(doc_id).alias("doc_id"), F.inline(F.array(*(F.struct(F.lit(k).alias("field"), F.coalesce(v, F.lit("")).alias("text")) for k, v in fields.items()))))
    return rows if anchors is None else rows.unionByName(anchors.select("doc_id", F.lit("anchor").alias("field"), "text"))


def document_scan(rows: DataFrame, response: int | None = None, language: str | None = None, tld: str | None = None) -> DataFrame:
    """Rows of a document index (url, response, lang) that meet every condition given; those without a URL are passed over."""
    out = rows.where(F.coalesce("url", F.lit("")) != "")
    for column, wanted in (("response", response), ("lang", language)):
        out = out if wanted is None else out.where(F.col(column) == wanted)
    return out if tld is None else out.where(F.substring_index(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]*)", 1)), ".", -1) == tld)


def by_rank_bucket(rows: DataFrame, rank: str = "rank", by: str = "doc_id") -> DataFrame:
    """Rows in order of their rank's bucket, the smallest first, ties by `by`: a range partitioned sort."""
    return rows.withColumn("bucket", ranks.rank_bucket(F.col(rank))).orderBy("bucket", by)


def of_lots(rows: DataFrame, lots: DataFrame, size: int = 500_000, doc_id: str = "doc_id") -> DataFrame:
    """Rows whose lot is among those of a server."""
    return rows.withColumn("lot", F.floor(F.col(doc_id) / size)).join(lots.select("lot").distinct(), "lot", "left_semi")


def page(rows: DataFrame, number: int = 1, size: int = 10, order: str = "relevance", most: int = 250, by: str = "doc_id") -> DataFrame:
    """A page of results, from 1. Orders: relevance (also for unknown names), newest, oldest; ties by doc_id."""
    first = {"newest": [F.desc("time")], "oldest": [F.asc("time")]}.get(order, [F.desc("score")])
    n = min(size, most)
    return rows.orderBy(*first, by).offset((max(1, number) - 1) * n).limit(n)
