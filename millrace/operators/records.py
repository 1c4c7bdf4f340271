"""Lines of logs and lists as rows, dictionaries of attribute values, settings, and access to stored pages."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHED_PAGE_SECONDS = 3600  # fixed value
SMALL_LOT_BYTES = 1 << 30  # fixed value
# Common media types and the extensions they stand for
MEDIA_TYPES = {
    "application/json": "json", "application/msword": "doc", "application/pdf": "pdf", "application/rtf": "rtf", "application/vnd.ms-excel": "xls", "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/xml": "xml", "application/zip": "zip", "audio/mpeg": "mp3", "image/gif": "gif", "image/jpeg": "jpg",
    "image/png": "png", "message/rfc822": "eml", "text/css": "css", "text/csv": "csv", "text/html": "html", "text/plain": "txt",
}
LANGUAGES = ["de", "en", "es", "fr"]


def index_runs(lines: DataFrame) -> DataFrame:
    """time, new, recrawled, untouched of lines `<unix time> new=<n>,recrawled=<n>,untouched=<n>`; others are left out."""
    pattern = r"^(\d+) new=(\d+),recrawled=(\d+),untouched=(\d+)$"
    names = ("time", "new", "recrawled", "untouched")
    return lines.where(F.col("value").rlike(pattern)).select(*(F.regexp_extract("value", pattern, k + 1).cast("long").alias(n) for k, n in enumerate(names)))


def counted_tails(lines: DataFrame, mark: str = ": ") -> DataFrame:
    """value, n: what stands behind the last mark of each line, most frequent first."""
    return lines.groupBy(F.substring_index("value", mark, -1).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def requests_by_user(lines: DataFrame, pattern: str = r"user=([^ ]+)") -> DataFrame:
    return lines.where(F.col("value").rlike(pattern)).groupBy(F.regexp_extract("value", pattern, 1).alias("user")).agg(F.count("*").alias("n"))


def media_extension(kind: Column) -> Column:
    """The extension of a media type without its parameters, null if unknown."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair)), F.trim(F.lower(F.substring_index(kind, ";", 1))))


def value_dictionary(attributes: DataFrame) -> DataFrame:
    """crc32, value: each attribute value once, the smaller of two that share a sum."""
    return attributes.groupBy(F.crc32("value").alias("crc32")).agg(F.min("value").alias("value"))


def decoded(index: DataFrame, dictionary: DataFrame) -> DataFrame:
    """An attribute index (doc_id, key, crc32) with its values; null for a sum the dictionary lacks."""
    return index.join(dictionary, "crc32", "left").drop("crc32")


def registered_domains(lines: DataFrame) -> DataFrame:
    """Domains of a zone file's NS lines, in lower case, once."""
    p = F.split("value", r"\s+")
    return lines.where(F.upper(F.get(p, F.lit(1))) == "NS").select(F.concat(F.lit("http://www."), F.lower(F.regexp_replace(F.get(p, F.lit(0)), r"\.$", "")), F.lit("/")).alias("url")).distinct()


def first_columns(lines: DataFrame, mark: str = " ") -> DataFrame:
    return lines.select(F.substring_index("value", mark, 1).alias("value"))


def small_lots(documents: DataFrame, most: int = SMALL_LOT_BYTES) -> DataFrame:
    return documents.groupBy("lot").agg(F.sum("size").alias("size")).where(F.col("size") < most)


def page_signature(secret: str, doc_id: Column, time: Column) -> Column:
    return F.crc32(F.concat_ws("|", F.lit(secret), doc_id.cast("string"), time.cast("string")))


def may_fetch(secret: str, doc_id: Column, time: Column, signature: Column, now: Column) -> Column:
    """Whether a cached page's address is signed and less than an hour old."""
    return (signature == page_signature(secret, doc_id, time)) & (time + CACHED_PAGE_SECONDS >= now)


def access_level(address: str, key: str | None = None, user: str | None = None, keys: Sequence[str] = (), trusted: Sequence[str] = ("127.0.0.0/8", "::1/128"), anonymous: bool = False) -> str:
    """full for trusted addresses and known keys, limited for users and, if allowed, for anybody, else none."""
    ip = ipaddress.ip_address(address)
    if any(ip in ipaddress.ip_network(n) for n in trusted) or (key is not None and key in keys):
        return "full"
    return "limited" if user or anonymous else "none"


def sid_text(raw: Column) -> Column:
    """A binary security identifier as S-r-a-s-...; null where it is cut short."""
    h = F.hex(raw)
    n = F.conv(F.substring(h, 3, 2), 16, 10).cast("int")
    little = lambda k: F.concat(*(F.substring(h, (k * 8 + 17 + 2 * b), F.lit(2)) for b in (3, 2, 1, 0)))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.conv(little(k), 16, 10))
    whole = F.concat_ws("-", F.lit("S"), F.conv(F.substring(h, 1, 2), 16, 10), F.conv(F.substring(h, 5, 12), 16, 10), parts)
    return F.when((F.length(h) >= 16) & (n > 0) & (F.length(h) == 16 + 8 * n), whole)


def with_last_part(sid: Column, last: Column) -> Column:
    return F.concat(F.regexp_replace(sid, "[0-9]+$", ""), last.cast("string"))


def export_settings(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def import_settings(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def merged(results: Iterable[DataFrame], most: int) -> DataFrame:
    """One list of the servers' results by score; a document that several return counts once, with its best score."""
    first, *rest = results
    for r in rest:
        first = first.unionByName(r)
    return first.groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(most)


def user_system(spark: SparkSession, users: Callable[[], Iterable[str]], groups: Callable[[str], Iterable[str]]) -> DataFrame:
    """user, group rows of a plugged-in user system: each user's groups are asked for by a task, not here."""
    import pandas as pd

    def ask(batches):
        for batch in batches:
            yield pd.DataFrame([(u, g) for u in batch["user"] for g in groups(u)], columns=["user", "group"])

    names = [(u,) for u in users()]
    return spark.createDataFrame(names, "user string").mapInPandas(ask, "user string, group string")
