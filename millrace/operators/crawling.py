"""Crawl scheduling and the frontier, redirects aside: what is due, seen, near, excluded, changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DOCUMENT_BYTES = 26_214_400  # fixed value
PUSH_CONNECTOR = 14  # fixed value: collections that nothing crawls
DEFAULT_RATE, DAY = 1440, 1440


def due(shares: DataFrame, now: Column, in_hours: Column | bool = True) -> DataFrame:
    """Active collections that are crawled and due: last + rate minutes <= now. Never crawled ones come first, then those
    of the default rate, then the others. A rate below a day ignores the hours of crawling."""
    rate = F.when(F.coalesce("rate", F.lit(0)) > 0, F.col("rate")).otherwise(DEFAULT_RATE)
    hours = in_hours if isinstance(in_hours, Column) else F.lit(in_hours)
    ready = F.col("last").isNull() | (F.col("last") + F.make_dt_interval(F.lit(0), F.lit(0), rate) <= now)
    place = F.when(F.col("last").isNull(), 0).when(F.coalesce("rate", F.lit(0)) <= 0, 1).otherwise(2)
    return shares.where((F.col("active") == 1) & (F.col("connector") != PUSH_CONNECTOR) & ready & (hours | (rate < DAY))).select("*", place.alias("turn")).orderBy("turn", "id")


def next_minutes(shares: DataFrame, now: Column) -> Column:
    """Minutes until a collection is due; below 0 if overdue."""
    rate = F.when(F.coalesce("rate", F.lit(0)) > 0, F.col("rate")).otherwise(DEFAULT_RATE)
    return (rate - F.floor((F.unix_timestamp(now) - F.unix_timestamp("last")) / 60)).cast("long")


def next_run(last: Column, rate_hours: Column, now: Column) -> Column:
    """Seconds to a timed job's next run, not below 0; -1 where the rate is not positive."""
    return F.when(rate_hours <= 0, -1).otherwise(F.greatest(F.lit(0), last + rate_hours * 3600 - now))


def unseen(urls: DataFrame, seen: DataFrame) -> DataFrame:
    return urls.dropDuplicates(["url"]).join(seen.select("url"), "url", "left_anti")


def near(urls: DataFrame, starts: DataFrame) -> DataFrame:
    """URLs (host, path) on a start's host whose path matches the start's path as a pattern."""
    return urls.join(starts.select("host", F.col("path").alias("start")), "host").where(F.expr("path rlike start")).drop("start").distinct()


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    return path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def blog_links(html: Column) -> Column:
    """Links of a blog's page: without its tag cloud, and without those of the blog's own machinery (wp-)."""
    from millrace.functions.urls import links

    return F.filter(links(F.regexp_replace(html, r'(?is)<div class="tagcloud">.*?</div>', "")), lambda u: ~F.contains(u, F.lit("wp-")))


def redirect_links(redirects: DataFrame) -> DataFrame:
    """src, dst: a redirect counts as a link from its page to its target, which is not followed."""
    return redirects.where(F.col("response").isin(301, 302)).select(F.col("url").alias("src"), F.trim("body").alias("dst"))


def expired(rows: DataFrame, now: Column) -> DataFrame:
    """Stored results whose time and rate in seconds lie before now."""
    return rows.where(F.col("modified") + F.col("rate") < now)


def storable(html: Column) -> Column:
    """Not over the size limit and not barred by the page's own robots tag."""
    from millrace.functions.urls import robots_blocks

    return (F.octet_length(html) <= MAX_DOCUMENT_BYTES) & ~robots_blocks(html, "noindex")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, allowed: 1, 0 if a rule of the host is a prefix of the path, null for a host without rules.

    rules: host, prefix (empty for a host that allows everything). Rules are gathered for a host first, so that a URL
    stays one row.
    """
    own = rules.groupBy("host").agg(F.collect_set("prefix").alias("prefixes"))
    hit = F.exists("prefixes", lambda p: (p != "") & F.startswith(F.col("path"), p))
    return urls.join(own, "host", "left").select("url", F.when(F.col("prefixes").isNull(), None).when(hit, 0).otherwise(1).alias("allowed"))
