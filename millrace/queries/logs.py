"""Search-log statistics and date facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators import statistics as S

from .tables import LOG, log


def log_top_queries(spark, sf):
    return S.top_queries(log(spark, sf), 7, 10)


def log_top_queries_of_user(spark, sf):
    return S.top_queries(log(spark, sf), 30, 10, user=7)


def log_users_asc(spark, sf):
    return S.users(log(spark, sf), 10, ascending=True)


def log_users_desc(spark, sf):
    return S.users(log(spark, sf))


def log_day_gapfill(spark, sf):
    """Searches by day, gaps filled."""
    return S.per_day(log(spark, sf)).select(F.col("day").cast("string").alias("day"), "n")


def log_5min(spark, sf):
    return S.last_minutes(log(spark, sf), 5)


def log_latest50(spark, sf):
    return log(spark, sf).orderBy(F.desc("tid"), F.desc("id")).limit(50).select("id", "query", "user", "hits")


def log_hits_histogram(spark, sf):
    return log(spark, sf).groupBy("hits").agg(F.count("*").alias("n"))


def progress_delta(spark, sf):
    days = log(spark, sf).groupBy(F.to_date("tid").alias("day")).agg(F.count("*").alias("n"))
    return S.progress(days, "day", "n").withColumn("day", F.col("day").cast("string"))


def query_runs(spark, sf):
    """Each user's log without repeats of the query before."""
    return S.runs(log(spark, sf), "user", "query", "id").groupBy("user").agg(F.count("*").alias("n"))


def date_facets(spark, sf):
    r = log(spark, sf)
    return r.agg(*(F.count_if(c).alias(k) for k, c in dates.buckets(F.col("tid"), S.newest(r)).items()))


def date_ranges(spark, sf):
    r = log(spark, sf)
    return r.groupBy(dates.view_range(F.col("tid"), S.newest(r)).alias("range")).agg(F.count("*").alias("n"))


PHRASES = ("today", "yesterday", "this week", "last week", "this month", "last month", "this year", "last year")


def date_filter(spark, sf):
    """Searches of each kind within each of several phrases, read beside the newest."""
    r = log(spark, sf)
    now = r.agg(F.max("tid")).first()[0]
    within = [(p, *dates.date_range(p, now)) for p in PHRASES]
    hit = F.array_compact(F.array(*(F.when((F.col("tid") >= F.lit(a)) & (F.col("tid") < F.lit(b)), p) for p, a, b in within)))
    return r.select("query", F.explode(hit).alias("phrase")).groupBy("phrase", "query").agg(F.count("*").alias("n"))


def collection_tabs(spark, sf):
    """Hits of each query type and of all together."""
    return log(spark, sf).rollup("query").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))


QUERIES = {f.__name__: f for f in (log_top_queries, log_top_queries_of_user, log_users_asc, log_users_desc, log_day_gapfill, log_5min, log_latest50, log_hits_histogram, progress_delta, query_runs, date_facets, date_ranges, date_filter, collection_tabs)}
_DAY = f"with {LOG}, now_ as (select max(tid) as n, date_trunc('day', max(tid)) as d, date_trunc('year', max(tid)) as y from log)"
SQL = {
    "log_top_queries": f"{_DAY} select trim(query) as query, count(*) as num from log, now_ where tid > n - interval 7 day group by 1 order by num desc, query limit 10",
    "log_top_queries_of_user": f"{_DAY} select trim(query) as query, count(*) as num from log, now_ where tid > n - interval 30 day and user_ = 7 group by 1 order by num desc, query limit 10",
    "log_users_asc": f'with {LOG} select user_ as "user", count(*) as num from log group by 1 order by num, user_ limit 10',
    "log_users_desc": f'with {LOG} select user_ as "user", count(*) as num from log group by 1',
    "log_day_gapfill": f"with {LOG}, n as (select tid::date as day, count(*) as n from log group by 1), days as (select unnest(generate_series((select min(day) from n), (select max(day) from n), interval 1 day))::date as day) select day::varchar as day, coalesce(n, 0) as n from days left join n using (day)",
    "log_5min": f"{_DAY} select count(*) as n, coalesce(avg(seconds), 0) as average, coalesce(min(seconds), 0) as least, coalesce(max(seconds), 0) as most from log, now_ where tid > n - interval 5 minute",
    "log_latest50": f'with {LOG} select id, query, user_ as "user", hits from log order by tid desc, id desc limit 50',
    "log_hits_histogram": f"with {LOG} select hits, count(*) as n from log group by hits",
    "progress_delta": f"with {LOG}, days as (select tid::date as day, count(*) as n from log group by 1) select day::varchar as day, n, n - coalesce(max(n) over (order by day rows between unbounded preceding and 1 preceding), 0) as delta from days",
    "query_runs": f'with {LOG} select user_ as "user", count(*) as n from (select user_, query, lag(query) over (partition by user_ order by id) as last from log) where last is null or last <> query group by 1',
    "date_facets": f"""{_DAY} select count(*) filter (where tid >= d) as today, count(*) filter (where tid >= d - interval 1 day and tid < d) as yesterday, count(*) filter (where tid >= date_trunc('week', n)) as this_week, count(*) filter (where tid >= date_trunc('month', n)) as this_month,
        count(*) filter (where tid >= y) as this_year, count(*) filter (where tid >= y - interval 1 year and tid < y) as last_year, count(*) filter (where tid < y - interval 1 year) as two_years_plus from log, now_""",
    "date_ranges": f"""{_DAY} select case when tid >= d then 'today' when tid >= d - interval 1 day then 'yesterday' when tid >= d - interval 7 day then 'last 7 days' when tid >= d - interval 31 day then 'last 31 days' when year(tid) = year(n) then 'this year' when year(tid) = year(n) - 1 then 'last year' else (year(n) - year(tid)) || ' years ago' end as range, count(*) as n from log, now_ group by 1""",
    "date_filter": f"{_DAY} " + " union all ".join(f"select '{p}' as phrase, query, count(*) as n from log, now_ where tid >= {a} and tid < {b} group by query" for p, a, b in (
        ("today", "d", "d + interval 1 day"), ("yesterday", "d - interval 1 day", "d"), ("this week", "date_trunc('week', n)", "date_trunc('week', n) + interval 7 day"), ("last week", "date_trunc('week', n) - interval 7 day", "date_trunc('week', n)"),
        ("this month", "date_trunc('month', n)", "date_trunc('month', n) + interval 1 month"), ("last month", "date_trunc('month', n) - interval 1 month", "date_trunc('month', n)"), ("this year", "y", "y + interval 1 year"), ("last year", "y - interval 1 year", "y"))),
    "collection_tabs": f"with {LOG} select query, count(*) as n, sum(hits)::bigint as hits from log group by rollup (query)",
}
