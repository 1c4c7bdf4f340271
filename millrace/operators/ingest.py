"""Versions, changes, deletions and other upkeep of document tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from millrace.storage import checkpoint


def latest(log: DataFrame, key: Sequence[str] = ("doc_id",), version: str = "version") -> DataFrame:
    """The row of the highest version of each key, as a maximum of structs, so that tasks reduce before the shuffle."""
    rest = [c for c in log.columns if c not in key and c != version]
    return log.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("_r")).select(*key, "_r.*")


def live(log: DataFrame, pointers: DataFrame) -> DataFrame:
    """Rows that a pointer (doc_id, pointer) names; what is left over is garbage."""
    return log.join(pointers, ["doc_id", "pointer"], "left_semi")


def changed(found: DataFrame, stored: DataFrame, by: Sequence[str] = ("url", "last_modified", "size")) -> DataFrame:
    """Found rows that aren't stored as they are."""
    return found.join(stored.select(*by), list(by), "left_anti")


def upsert(stored: DataFrame, log: DataFrame, key: Sequence[str] = ("collection", "url")) -> DataFrame:
    """The state after a log of adds and deletes (op, ts and the columns of stored): the last entry of a key counts, of
    equally late ones a delete, then the greatest in its columns' order.

    A delete with a null url empties the collection of what came before it.
    """
    columns = stored.columns
    wiped = log.where("op = 'delete' and url is null").groupBy("collection").agg(F.max("ts").alias("wiped"))
    rows = stored.select(*columns, F.lit(None).cast(log.schema["ts"].dataType).alias("ts"), F.lit("add").alias("op")).unionByName(log.where("url is not null").select(*columns, "ts", "op"))
    rows = rows.join(wiped, "collection", "left").where(F.col("wiped").isNull() | (F.col("ts") > F.col("wiped"))).drop("wiped")
    last = rows.groupBy(*key).agg(F.max(F.struct(F.coalesce(F.col("ts").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("_ts"), "op", *[c for c in columns if c not in key])).alias("_r"))
    return last.where("_r.op <> 'delete'").select(*[F.col(c) if c in key else F.col(f"_r.{c}") for c in columns])


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r")).select(key, "_r.*")


def stale(rows: DataFrame, now: Column, keep: Column) -> Column:
    """Not seen for a day, unless its collection keeps old documents. Our reading of a flag's name."""
    return (F.col("last_seen") < now - F.expr("interval 1 day")) & ~keep


def numbered(rows: DataFrame, order: str, into: str = "n") -> DataFrame:
    """Rows with their number from 0 in a global order: sorted by range once, counted by partition, and numbered where they
    lie. Only a count for each partition comes to the driver."""
    x = checkpoint(rows.orderBy(order))
    before, offsets = 0, {}
    for part, k in sorted(map(tuple, x.groupBy(F.spark_partition_id().alias("part")).count().collect())):
        offsets[part], before = before, before + k

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            n = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, n], [*batch.schema.names, into])

    return x.mapInArrow(number, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*x.schema.fields, StructField(into, LongType())]))


def interleaved(large: DataFrame, small: DataFrame, order: str) -> DataFrame:
    """Rows of both with `place`, a number to sort by, and `side`: a small one after every so many large ones as their
    numbers' ratio, what is left at the end."""
    ratio = max(1, large.count() // max(1, small.count()))
    a = numbered(large, order, "_n").select("*", (F.col("_n") * 2).cast("long").alias("place"), F.lit("large").alias("side"))
    b = numbered(small, order, "_n").select("*", ((F.col("_n") + 1) * ratio * 2 - 1).cast("long").alias("place"), F.lit("small").alias("side"))
    return a.unionByName(b).drop("_n")


def lot(doc_id: Column, size: int = 500_000) -> Column:
    return F.floor(doc_id / size)


def bucket_of_name(name: Column, letters: int = 1) -> Column:
    """Lower-cased first letters of a name, _ in place of others."""
    return F.regexp_replace(F.lower(F.substring(name, 1, letters)), "[^a-z0-9]", "_")
