"""Streams: rolling query metrics, changes applied batch by batch, first sight of URLs, and progress by state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def metrics(log: DataFrame, minutes: int = 5, late: str = "10 minutes", time: str = "tid") -> DataFrame:
    """start, query, n, average, least, most of each window. On a stream, events later than `late` are left out."""
    rows = log.withWatermark(time, late) if log.isStreaming else log
    return rows.groupBy(F.window(time, f"{minutes} minutes").alias("w"), "query").agg(F.count("*").alias("n"), F.avg("seconds").alias("average"), F.min("seconds").alias("least"), F.max("seconds").alias("most")).select(F.col("w.start").alias("start"), "query", "n", "average", "least", "most")


def unseen(urls: DataFrame, late: str = "1 day", time: str = "ts") -> DataFrame:
    """Each URL once within the watermark."""
    return urls.withWatermark(time, late).dropDuplicatesWithinWatermark(["url"]) if urls.isStreaming else urls.dropDuplicates(["url"])


def apply_changes(changes: DataFrame, path: str, base: Callable[[], DataFrame], checkpoint: str):
    """A query that keeps the table of documents at `path` up to date; a batch becomes visible as a whole.

    Each batch is written beside the table as a version of its own, so that a batch that runs again gives the same; the
    version before stays for that, older ones go.
    """
    from millrace.operators.ingest import upsert

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = base() if number == 0 else spark.read.parquet(f"{path}/v{number - 1}")
        upsert(stored, batch).write.mode("overwrite").parquet(f"{path}/v{number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
        if number > 1:
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def progress(points: DataFrame) -> DataFrame:
    """job, ts, delta of a stream (job, ts, value): growth over the largest value before, kept as state for each job."""

    def grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most = state.get[0] if state.exists else 0
        for batch in batches:
            out = []
            for ts, value in batch.sort_values("ts")[["ts", "value"]].itertuples(index=False):
                out.append((key[0], ts, int(value) - most))
                most = max(most, int(value))
            yield pd.DataFrame(out, columns=["job", "ts", "delta"])
        state.update((most,))

    return points.groupBy("job").applyInPandasWithState(grow, "job string, ts timestamp, delta long", "most long", "append", GroupStateTimeout.NoTimeout)
