"""Access lists: who may see a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW_MASK, DENY_MASK = 0x00120089, 0x00020089  # fixed values: rights of a Windows access entry that mean reading


def visible(principals: Sequence[str] | Column, allow: Column, deny: Column) -> Column:
    """Some principal is allowed and none is denied; an empty list allows nobody."""
    own = principals if isinstance(principals, Column) else F.array(*map(F.lit, principals)).cast("array<string>")
    empty = F.array().cast("array<string>")
    return F.arrays_overlap(own, F.coalesce(allow, empty)) & ~F.arrays_overlap(own, F.coalesce(deny, empty))


def principals_of(users: DataFrame, groups: DataFrame) -> DataFrame:
    """user, principals: the user and all groups (user, group); users unknown to `groups` are left out, so see nothing."""
    return users.join(groups, "user").groupBy("user").agg(F.sort_array(F.array_union(F.array(F.first("user")), F.collect_set("group"))).alias("principals"))


def windows_acl(text: Column) -> Column:
    """struct(allow, deny) of ACL:<sid>:<type>/<flags>/<mask> entries; an allowed Everyone stands for all."""
    entries = F.transform(F.regexp_extract_all(text, F.lit(r"ACL:([^:,]+:[0-9]+/[0-9]+/0x[0-9a-fA-F]+)")), lambda e: F.struct(F.substring_index(e, ":", 1).alias("sid"), F.substring_index(F.substring_index(e, ":", -1), "/", 1).alias("type"), F.conv(F.substring_index(e, "/0x", -1), 16, 10).cast("long").alias("mask")))
    side = lambda kind, mask: F.array_distinct(F.transform(F.filter(entries, lambda e: (e["type"] == kind) & (e["mask"].bitwiseAND(F.lit(mask)) == mask)), lambda e: e["sid"]))
    allow = side("0", ALLOW_MASK)
    return F.struct(F.when(F.array_contains(allow, "S-1-1-0"), F.array(F.lit("Everyone"))).otherwise(allow).alias("allow"), side("1", DENY_MASK).alias("deny"))


def without_banned(rows: DataFrame, banned: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows whose domain isn't banned; domains are compared whole."""
    return rows.join(banned.select(domain).distinct(), domain, "left_anti")


def without_blocked(rows: DataFrame, blocked: DataFrame, host: str = "host") -> DataFrame:
    """Rows none of whose host's suffixes (host, host without its first label, ...) is blocked."""
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    hosts = rows.select(host).distinct().select(host, F.explode(suffixes).alias("suffix"))
    hit = hosts.join(blocked.select(F.col(blocked.columns[0]).alias("suffix")).distinct(), "suffix", "left_semi").select(host).distinct()
    return rows.join(hit, host, "left_anti")
