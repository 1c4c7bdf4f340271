"""HTML as units: words, headings, links and meta values with their places; text that a style hides is told apart."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w(?:[\w']*\w)?")
_FLAGS = ("title", "h1", "h2", "h3", "h4", "h5", "h6")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def hidden(style: str) -> bool:
    """Whether an element's style makes its text unseen: not visible, not displayed, no size, or ink as the paper."""
    rules = {k.strip().lower(): v.strip().lower() for k, _, v in (part.partition(":") for part in style.split(";")) if v}
    ink, paper = rules.get("color"), rules.get("background-color", rules.get("background"))
    return rules.get("visibility") == "hidden" or rules.get("display") == "none" or bool(re.fullmatch(r"0+(\.0+)?(px|pt|em|%)?", rules.get("font-size", ""))) or (ink is not None and ink == paper)


class _Units(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.place, self.open = [], 0, []

    def add(self, unit: str, text: str) -> None:
        flag = next((t for t, _ in reversed(self.open) if t in _FLAGS), "")
        self.out.append((self.place, unit, flag, text))
        self.place += 1

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "a" and a.get("href"):
            self.add("link", a["href"])
        elif tag == "base" and a.get("href"):
            self.add("baselink", a["href"])
        elif tag == "meta" and a.get("name", "").lower() in ("keywords", "description", "robots", "author"):
            self.add("meta_" + a["name"].lower(), a.get("content", ""))
        if tag not in _VOID:
            self.open.append((tag, hidden(a.get("style", ""))))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "script" in tags or "style" in tags:
            return
        kind = "cloaked_word" if any(h for _, h in self.open) else "linkword" if "a" in tags else "word"
        for w in _WORD.findall(data):
            self.add(kind, w.lower())


def parse(html: str | None) -> list[tuple[int, str, str, str]]:
    """(place, unit, flag, text) of a page."""
    p = _Units()
    p.feed(html or "")
    p.close()
    return p.out


def units(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, place, unit, flag, text: a row for each unit of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 100):
                part = batch.iloc[k : k + 100]
                yield pd.DataFrame([(i, *u) for i, h in zip(part["key"], part["html"], strict=True) for u in parse(h if isinstance(h, str) else None)], columns=["key", "place", "unit", "flag", "text"])

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(rows, f"key {kind}, place int, unit string, flag string, text string").withColumnRenamed("key", key)
