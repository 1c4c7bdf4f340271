"""Link graph: in-links, out-degree, anchors, ranks by links, broken links, redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_links(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """dst, src, rank, out_degree of each distinct link; 0 for an unranked source."""
    own = edges.select("src", "dst").distinct()
    degree = own.groupBy("src").agg(F.count("*").alias("out_degree"))
    return own.join(ranks.select(F.col("doc_id").alias("src"), "rank"), "src", "left").join(degree, "src").select("dst", "src", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"), "out_degree")


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("n_links"), F.countDistinct("dst").alias("n_targets"))


def anchors(edges: DataFrame) -> DataFrame:
    """dst, n, texts: the distinct link texts that lead to a page."""
    return edges.groupBy("dst").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("link")).alias("texts"))


def link_rank(edges: DataFrame, ranks: DataFrame, rounds: int) -> DataFrame:
    """doc_id, rank: each round adds (R(src) + 0.85) / 10 of every link to its target, all R from the round before.

    Our definition: the sum over the links at once in place of a pass in file order. Lineage grows with `rounds`, which
    are few; R is joined on the links' source, which is hashed once for all rounds.
    """
    links = edges.select("src", "dst").repartition("src")
    r = ranks.select("doc_id", F.col("rank").cast("double").alias("rank"))
    for _ in range(rounds):
        more = links.join(r.withColumnRenamed("doc_id", "src"), "src").groupBy("dst").agg((F.sum(F.col("rank") + 0.85) / 10).alias("more"))
        r = r.join(more.withColumnRenamed("dst", "doc_id"), "doc_id", "left").select("doc_id", (F.col("rank") + F.coalesce("more", F.lit(0.0))).alias("rank"))
    return r


def unclustered(edges: DataFrame, order: str) -> DataFrame:
    """Targets whose links stand in more than one run of the given order within a file's part."""
    runs = edges.withColumn("new", (F.col("dst") != F.lag("dst").over(Window.partitionBy("part").orderBy(order))) | (F.row_number().over(Window.partitionBy("part").orderBy(order)) == 1))
    return runs.where("new").groupBy("part", "dst").agg(F.count("*").alias("n_runs")).where("n_runs > 1")


def bad_links(edges: DataFrame, errors: DataFrame) -> DataFrame:
    """dst, error, referrers: pages that failed, with the pages that lead there."""
    return edges.join(errors, "dst").groupBy("dst", "error").agg(F.array_sort(F.collect_set("src")).alias("referrers"))


def resolved_redirects(redirects: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, target, class, to: 301 and 302 answers whose body is the target; class is not_redirect, too_long, bad_url,
    found (with the target's document) or new.

    redirects: doc_id, response, host, body; known: url, doc_id.
    """
    from millrace.functions.urls import absolute, is_valid

    x = redirects.withColumn("target", absolute(F.trim("body"), F.col("host")))
    first = F.when(~F.col("response").isin(301, 302), "not_redirect").when(F.length("body") >= 200, "too_long").when(~is_valid(F.col("target")) | ~F.col("target").startswith("http://"), "bad_url")
    x = x.withColumn("class", first).join(known.select(F.col("url").alias("target"), F.col("doc_id").alias("to")), "target", "left")
    return x.select("doc_id", "target", F.coalesce("class", F.when(F.col("to").isNotNull(), "found").otherwise("new")).alias("class"), F.when(F.col("class").isNull(), F.col("to")).alias("to"))
