"""Document formats: mail, archives, office files, XML batches, packed link files, and result feeds."""

from __future__ import annotations

import base64
import email
import email.policy
import io
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names and file name extensions
HEADERS = ("Subject", "From", "To", "Cc", "Bcc", "Reply-To", "Date")
OFFICE = ("docx", "docm", "dotx", "dotm", "xlsx", "xlsm", "xltx", "xltm", "xlam", "xlsb", "pptx", "pptm", "potx", "potm", "ppsx", "ppsm", "ppam", "thmx")
PLAIN = ("txt", "ini", "c", "cpp", "h", "log", "csv")
MAX_PART = 1 << 28  # bytes of one unpacked file


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def mail_parts(raw: bytes) -> list[tuple[int, str, str]]:
    """(part, type, text): the headers first, then every leaf part; nested messages are taken apart too."""
    message = email.message_from_bytes(raw, policy=email.policy.default)
    out = [(0, "headers", "\n".join(f"{h}: {message[h]}" for h in HEADERS if message[h]))]
    for part in message.walk():
        if part.is_multipart():
            continue
        body = part.get_payload(decode=True) or b""
        if part.get_content_maintype() == "text":
            try:
                text = body.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:  # a charset that nobody knows
                text = body.decode("utf-8", "replace")
        else:
            text = base64.b64encode(body).decode()
        out.append((len(out), part.get_content_type(), text))
    return out


def zip_parts(raw: bytes) -> list[tuple[str, bytes]]:
    """(name, content) of an archive's files. A file that unpacks to more than MAX_PART is an error."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        found = []
        for info in z.infolist():
            if info.file_size > MAX_PART:
                raise ValueError(f"{info.filename} is too large")
            if not info.is_dir():
                found.append((info.filename, z.read(info)))
        return found


def office_text(raw: bytes) -> tuple[str, dict[str, str]]:
    """Text and chosen properties of an office file: creator, language, last saved by, page count."""
    names = {"creator": "creator", "language": "language", "lastModifiedBy": "last saved by", "Pages": "page count"}
    text, properties = [], {}
    for name, content in zip_parts(raw):
        if not name.endswith(".xml"):
            continue
        tag = lambda e: e.tag.rpartition("}")[2]
        root = ET.fromstring(content)
        if name.startswith("docProps/"):
            properties |= {names[tag(e)]: e.text for e in root.iter() if tag(e) in names and e.text}
        elif name.startswith(("word/document", "xl/sharedStrings", "ppt/slides/")):
            for e in root.iter():
                if tag(e) == "t" and e.text:
                    text.append(e.text)
                elif tag(e) in ("p", "si"):
                    text.append("\n")
    return "".join(text).strip(), properties


def exploded(rows: DataFrame, kind: str, key: str = "path", content: str = "content") -> DataFrame:
    """Parts of mail (kind eml), archives (zip) or office files (ooxml): key, part, name, text; error for damaged ones."""
    if kind not in ("eml", "zip", "ooxml"):
        raise ValueError(f"no such kind: {kind}")
    t = rows.schema[key].dataType.simpleString()

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, raw in zip(batch["key"], batch["content"], strict=True):
                try:
                    if kind == "eml":
                        out += [(k, i, n, x, None) for i, n, x in mail_parts(bytes(raw or b""))]
                    elif kind == "zip":
                        out += [(k, i, n, c.decode("utf-8", "replace"), None) for i, (n, c) in enumerate(zip_parts(bytes(raw or b"")))]
                    else:
                        body, found = office_text(bytes(raw or b""))
                        out += [(k, 0, "body", body, None), *((k, i, n, v, None) for i, (n, v) in enumerate(sorted(found.items()), 1))]
                except (ValueError, zipfile.BadZipFile, ET.ParseError, EOFError, LookupError, RuntimeError, NotImplementedError, zlib.error, OSError, struct.error) as e:  # encrypted, damaged or of an unknown method
                    out.append((k, 0, None, None, str(e)))
            yield pd.DataFrame(out, columns=["key", "part", "name", "text", "error"])

    return rows.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(parts, f"key {t}, part int, name string, text string, error string").withColumnRenamed("key", key)


PACKED = "<20s200s50s2sI"  # fixed layout of a found link: sha1, url, anchor, two bytes, source


def found_links(rows: DataFrame) -> DataFrame:
    """sha1 (hex), url, anchor, src of packed records in files' content; a half record at the end is left out."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw in batch["content"]:
                for a, b, c, _, d in struct.iter_unpack(PACKED, raw[: len(raw) // struct.calcsize(PACKED) * struct.calcsize(PACKED)]):
                    out.append((a.hex(), *(x.split(b"\0")[0].decode("utf-8", "replace") for x in (b, c)), d))
            yield pd.DataFrame(out, columns=["sha1", "url", "anchor", "src"])

    return rows.select("content").mapInPandas(unpack, "sha1 string, url string, anchor string, src long")


BATCH = ["op", "collection", "url", "title", "body", "acl_allow", "acl_denied", "last_modified", "value", "error"]
BATCH_TYPE = "op string, collection string, url string, title string, body string, acl_allow array<string>, acl_denied array<string>, last_modified long, value string, error string"


def _added(d: ET.Element) -> dict:
    row = {e.tag: e.text or "" for e in d}
    missing = [k for k in ("uri", "collection", "title", "body") if not row.get(k)]
    if missing:
        return {"op": "add", "error": f"{row.get('uri') or '?'}: no {', '.join(missing)}"}
    try:
        body = base64.b64decode(row["body"], validate=True).decode("utf-8", "replace")
        modified = int(row.get("lastmodified") or 0)
    except ValueError:
        return {"op": "add", "error": f"{row['uri']}: bad body or date"}
    many = lambda k: [v for v in row.get(k, "").split(",") if v]
    return {"op": "add", "collection": row["collection"], "url": row["uri"], "title": row["title"], "body": body, "acl_allow": many("aclallow") or ["Everyone"], "acl_denied": many("acldeny"), "last_modified": modified}


def batch_rows(xml: str) -> list[dict]:
    """What an XML batch (sddocument) asks for, in order: documents to add, uris of a collection to delete, collections to
    close or create, users, and notes to the garbage collector or of errors. A part that lacks what it must have gives a
    row with its error, and the others stand."""
    out: list[dict] = []
    for part in ET.fromstring(xml):
        op, collection = part.tag, (part.findtext("collection") or "").strip()
        if op == "add":
            out += [_added(d) for holder in part.iter("documents") for d in holder.findall("document")]
        elif op == "delete":
            uris = [e.text for e in part.findall("uri") if e.text]
            out += [{"op": op, "collection": collection, "url": u} for u in uris] if collection else [{"op": op, "error": "no collection"}]
        elif op in ("close", "create"):
            out.append({"op": op, "collection": collection} if collection else {"op": op, "error": "no collection"})
        elif op == "users":
            out += [{"op": op, "value": e.text.strip()} for e in part.iter() if e is not part and not len(e) and e.text and e.text.strip()]
        elif op in ("gcwhispers", "error"):
            out += [{"op": op, "collection": collection or None, "value": f"{e.tag}={(e.text or '').strip()}"} for e in part if e.tag != "collection"] or [{"op": op, "collection": collection or None, "value": (part.text or "").strip()}]
    return out


def read_batches(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """What XML batches ask for, one row each (`op` and its columns); a batch that is no XML gives one row with the error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch["xml"]:
                try:
                    found = batch_rows(x or "")
                except ET.ParseError as e:
                    found = [{"error": str(e)}]
                out += [[d.get(c) for c in BATCH] for d in found]
            yield pd.DataFrame(out, columns=BATCH, dtype="object").astype({"last_modified": "Int64"})

    return rows.select(F.col(xml).alias("xml")).mapInPandas(parse, BATCH_TYPE)


def batch_changes(batch: DataFrame) -> DataFrame:
    """Adds and deletes of a batch as changes (collection, url, title, body, op) for `ingest.upsert`."""
    return batch.where("error is null and op in ('add', 'delete')").select("collection", "url", "title", "body", "op")


def result_xml(page: DataFrame, version: str = "2.1") -> DataFrame:
    """value: a RESULT element for each row (title, url, snippet, and for version 2.1 its rank), as the result writers give."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tags = {"TITLE": "title", "URL": "url", "DESCRIPTION": "snippet"} | ({"RANK": "rank"} if version == "2.1" else {})
    return page.select("*", F.concat(F.lit("<RESULT>"), *(F.concat(F.lit(f"<{t}>"), safe(c), F.lit(f"</{t}>")) for t, c in tags.items()), F.lit("</RESULT>")).alias("value"))


def feed_items(rows: DataFrame) -> DataFrame:
    """One OpenSearch RSS item for each result (title, url, snippet)."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return rows.select("*", F.concat(F.lit("<item><title>"), safe("title"), F.lit("</title><link>"), safe("url"), F.lit("</link><description>"), safe("snippet"), F.lit("</description></item>")).alias("item"))


def feed(page: DataFrame, query: str, total: int, start: int) -> str:
    """The RSS document of one page of results, which is all that is gathered."""
    items = "".join(r["item"] for r in feed_items(page).select("item").collect())
    q = query.replace("&", "&amp;").replace("<", "&lt;")
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/"><channel><title>{q}</title><opensearch:totalResults>{total}</opensearch:totalResults><opensearch:startIndex>{start}</opensearch:startIndex>{items}</channel></rss>'


def as_json(page: DataFrame) -> DataFrame:
    return page.select(F.to_json(F.struct("*")).alias("value"))


def wiki_pages(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Pages of an XML dump in the main namespace."""
    rows = spark.read.format("xml").option("rowTag", "page").load(path).where("ns = 0")
    return rows if most is None else rows.limit(most)


def timeline(rows: DataFrame) -> DataFrame:
    """Posts (name, text) as documents: title is the name and the text's first 50 letters."""
    return rows.select(F.concat(F.col("name"), F.lit(": "), F.substring("text", 1, 50)).alias("title"), F.col("text").alias("body"))
