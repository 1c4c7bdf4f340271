"""Search-log statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, time: str = "tid") -> Column:
    """The log's last time as a literal: the `now` of a finished log."""
    return F.lit(log.agg(F.max(time)).first()[0])


def top_queries(log: DataFrame, days: int, most: int, user: int | None = None) -> DataFrame:
    rows = log.where(F.col("tid") > newest(log) - F.expr(f"interval {days} days"))
    rows = rows.where(F.col("user") == user) if user is not None else rows
    return rows.groupBy(F.trim("query").alias("query")).agg(F.count("*").alias("num")).orderBy(F.desc("num"), "query").limit(most)


def users(log: DataFrame, most: int | None = None, ascending: bool = False) -> DataFrame:
    rows = log.groupBy("user").agg(F.count("*").alias("num")).orderBy(F.col("num").asc() if ascending else F.col("num").desc(), "user")
    return rows if most is None else rows.limit(most)


def per_day(log: DataFrame) -> DataFrame:
    """day, n: every day from the first to the last, 0 where nothing was asked."""
    n = log.groupBy(F.to_date("tid").alias("day")).agg(F.count("*").alias("n"))
    days = n.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def last_minutes(log: DataFrame, minutes: int = 5) -> DataFrame:
    """n, average, least, most seconds of the last minutes; 0 for none."""
    rows = log.where(F.col("tid") > newest(log) - F.expr(f"interval {minutes} minutes"))
    some = lambda f, name: F.coalesce(f("seconds"), F.lit(0.0)).alias(name)
    return rows.agg(F.count("*").alias("n"), some(F.avg, "average"), some(F.min, "least"), some(F.max, "most"))


def progress(points: DataFrame, order: str, value: str) -> DataFrame:
    """How much a value grew over the largest before it; a single series, as of one job's progress."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("delta", F.col(value) - F.coalesce(F.max(value).over(before), F.lit(0)))


def runs(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows whose value differs from the one before within a key."""
    last = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("_last") != F.col(value))).drop("_last")
