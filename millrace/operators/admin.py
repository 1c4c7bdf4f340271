"""Joins of the administration's tables: shares, connectors, users and their mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where(table: DataFrame, conditions: Mapping[str, object], columns: Sequence[str] = ("*",), order: Sequence[str] = ()) -> DataFrame:
    """Rows that equal every condition; None means null."""
    rows = table
    for name, value in conditions.items():
        rows = rows.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    rows = rows.select(*columns)
    return rows.orderBy(*order) if order else rows


def shares_with_connectors(shares: DataFrame, connectors: DataFrame, name: str | None = None, active: bool = False) -> DataFrame:
    rows = shares.join(connectors.select(F.col("id").alias("connector"), F.col("name").alias("connector_name")), "connector")
    rows = rows.where(F.col("connector_name") == name) if name is not None else rows
    return rows.where("active = 1") if active else rows


def connectors_in_use(shares: DataFrame, connectors: DataFrame) -> DataFrame:
    return shares_with_connectors(shares, connectors).groupBy("connector_name").agg(F.count("*").alias("n"))


def nested(connectors: DataFrame, shares: DataFrame, counts: DataFrame) -> DataFrame:
    """Every connector with its collections and their documents; connectors without any have none."""
    own = shares.join(counts, "collection", "left").select(F.col("connector").alias("id"), F.struct("collection", F.coalesce("n", F.lit(0)).alias("n")).alias("s"))
    own = own.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("collections"))
    return connectors.join(own, "id", "left").select("id", "name", F.coalesce("collections", F.array().cast("array<struct<collection:string,n:bigint>>")).alias("collections"))


def pushed(collections: DataFrame, shares: DataFrame) -> DataFrame:
    """Collections that no share crawls."""
    return collections.join(shares.select("collection"), "collection", "left_anti")


def unmapped(users: DataFrame, mapping: DataFrame, offset: int = 0, limit: int | None = 100) -> DataFrame:
    rows = users.join(mapping.select(F.col("secnd_usr").alias("user")), "user", "left_anti").orderBy("user").offset(offset)
    return rows if limit is None else rows.limit(limit)


def auto_mapped(primary: DataFrame, secondary: DataFrame, mapping: DataFrame) -> DataFrame:
    """Names both systems know and that aren't mapped yet."""
    return primary.select("user").intersect(secondary.select("user")).join(mapping.select(F.col("secnd_usr").alias("user")), "user", "left_anti")


def collections_of_users(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user").agg(F.array_sort(F.collect_set("collection")).alias("collections"))


def on_mounts(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """Each path with its mount of longest prefix. A path is cut into its prefixes, which join as equals."""
    steps = F.filter(F.split("path", "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.concat(F.lit("/"), F.concat_ws("/", F.slice(steps, 1, k))))
    hits = paths.select("path", "size", F.explode(prefixes).alias("mount")).join(mounts.select("mount"), "mount")
    best = Window.partitionBy("path").orderBy(F.length("mount").desc())
    return hits.withColumn("_p", F.row_number().over(best)).where("_p = 1").select("path", "mount", "size")


def addresses(ranges: DataFrame, most: int = 65_536) -> DataFrame:
    """Every number of ranges (first, last); a range over `most` is an error, as is one that ends before it begins."""
    size = F.col("last") - F.col("first") + 1
    good = F.when((size < 1) | (size > most), F.raise_error(F.lit("bad address range"))).otherwise(F.sequence("first", "last"))
    return ranges.select("first", "last", F.explode(good).alias("address"))


def group_of(user: Column) -> Column:
    """A user's name and what stands before its first dash."""
    return F.array_distinct(F.array(user, F.substring_index(user, "-", 1)))


# The languages that documents are marked with, numbered from 1
DOCUMENT_LANGUAGES = ["ENG", "NOR", "DAN", "DEU", "FIN", "FRA", "ITA", "NLD", "POR", "RUS", "SWE"]


def language_number(code: Column) -> Column:
    """1 to 11; 0 for others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, DOCUMENT_LANGUAGES)), F.upper(code)), F.lit(0)).cast("int")


def language_code(number: Column) -> Column:
    """The code of a number, null for 0 and others."""
    return F.when(number.between(1, len(DOCUMENT_LANGUAGES)), F.get(F.array(*map(F.lit, DOCUMENT_LANGUAGES)), number - 1))


def interface_language(code: Column) -> Column:
    c = F.lower(code)
    return F.when(c.isin("no", "nb", "nn"), "NBO").when(c.isin("en", "en_us"), "ENG").otherwise(F.upper(code))
