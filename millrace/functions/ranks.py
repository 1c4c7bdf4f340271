"""Number functions of ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points by how often a term stands in a field; the last counts for more
FIELD_POINTS = {
    "title": [15],
    "headline": [4, 6, 7, 8],
    "body": [1, 2, 4, 7, 9, 10, 12, 14, 16, 17, 18, 19, 20, 21, 22, 23, 24],
    "anchor": [1],
    "url": [5],
}
FIRST_TITLE_WORD, MAIN_URL_WORD = 25, 30


def points(field: str, n: Column) -> Column:
    """Our definition: the n-th entry of the field's table, the last one for more, 0 for none."""
    table = FIELD_POINTS[field]
    return F.when(n <= 0, F.lit(0)).otherwise(F.element_at(F.array(*map(F.lit, table)), F.least(n, F.lit(len(table))).cast("int"))).cast("long")


def short_rank(rank: Column) -> Column:
    """0 to 255: 53 a power of ten."""
    return F.when(rank <= 0, F.lit(0)).otherwise(F.least(F.lit(255), F.floor(F.log10(rank) * 53))).cast("int")


def rank_bucket(rank: Column) -> Column:
    return F.when(rank <= 0, F.lit(0)).otherwise(F.ceil(F.log(rank))).cast("long")


def merged_rank(external: Column, internal: Column, noc: Column, most_internal: int = 0, most_noc: int = 0) -> Column:
    """The external rank and capped shares of the two others; a sum of 0 counts as 1."""
    total = external + F.least(internal, F.lit(most_internal)) + F.least(noc, F.lit(most_noc))
    return F.when(total == 0, F.lit(1)).otherwise(total)


def byte_size(n: Column) -> Column:
    """Text such as 1.5G or 20.0M."""
    return F.when(n >= 1 << 30, F.format_string("%.1fG", n / (1 << 30))).otherwise(F.format_string("%.1fM", n / (1 << 20)))


def minutes_text(m: Column) -> Column:
    """now, minutes, hours or days, in words."""
    def unit(n: Column, name: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))

    n = m.cast("long")
    return F.when(n < 1, F.lit("now")).when(n < 60, unit(n, "minute")).when(n < 1440, unit(F.floor(n / 60), "hour")).otherwise(unit(F.floor(n / 1440), "day"))


def verification_id(salt: str, value: Column, time: Column, ip: Column) -> Column:
    """crc32(salt, value, time, ip) and the time."""
    return F.concat_ws("-", F.crc32(F.concat(F.lit(salt), value, time.cast("string"), ip)).cast("string"), time.cast("string"))
