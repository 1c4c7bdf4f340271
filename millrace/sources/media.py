"""Sizes of images and tags of sound files, from their first bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def image_size(raw: bytes) -> tuple[str, int, int] | None:
    """Format, width and height of PNG, GIF, BMP and JPEG data."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return ("png", *struct.unpack(">II", raw[16:24]))
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        return ("gif", *struct.unpack("<HH", raw[6:10]))
    if raw[:2] == b"BM" and len(raw) >= 26:
        w, h = struct.unpack("<ii", raw[18:26])
        return "bmp", w, abs(h)
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(raw) and raw[at] == 0xFF:
            kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return "jpg", w, h
            at += 2 + size
    return None


def sound_tags(raw: bytes) -> dict[str, str]:
    """title, artist, album and year of ID3 tags: of version 2 at the front, else of version 1 at the end."""
    names, out = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album", b"TYER": "year", b"TDRC": "year"}, {}
    if raw[:3] == b"ID3" and len(raw) > 10:
        end = 10 + sum((b & 127) << 7 * (3 - k) for k, b in enumerate(raw[6:10]))
        at = 10
        while at + 10 < min(end, len(raw)) and raw[at : at + 4].strip(b"\0"):
            size = sum((b & 127) << 7 * (3 - k) for k, b in enumerate(raw[at + 4 : at + 8])) if raw[3] >= 4 else int.from_bytes(raw[at + 4 : at + 8], "big")
            if name := names.get(raw[at : at + 4]):
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[at + 10], "latin-1")
                out[name] = raw[at + 11 : at + 10 + size].decode(code, "replace").strip("\0")
            at += 10 + size
    elif raw[-128:-125] == b"TAG":
        t = raw[-128:]
        out = {n: t[a:b].split(b"\0")[0].decode("latin-1").strip() for n, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97))}
    return {k: v for k, v in out.items() if v}


def described(files: DataFrame) -> DataFrame:
    """path, attributes of files (path, content): what their formats tell; empty for others."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                found = image_size(bytes(raw))
                out.append((path, {"format": found[0], "width": str(found[1]), "height": str(found[2])} if found else sound_tags(bytes(raw))))
            yield pd.DataFrame(out, columns=["path", "attributes"])

    return files.select("path", "content").mapInPandas(read, "path string, attributes map<string,string>")
