"""Query strings: parsing to a small tree, rewriting, and evaluation as one plan."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import TOKEN
from millrace.operators import search
from millrace.operators.access import visible

_TOKEN = re.compile(TOKEN.replace(r"\p{L}\p{N}_", r"\w").replace(r"\p{L}", r"[^\W\d_]"))
_FILTER = re.compile(r'(-?)([A-Za-z_]+):(?:"([^"]*)"|(\S+))')
_PART = re.compile(r'(-?)"([^"]*)"?|(\S+)')


@dataclass
class Query:
    """All of `phrases` (tuples of words, one for a plain word), none of `excluded`; filters by key; a sort order."""

    phrases: list[tuple[str, ...]] = field(default_factory=list)
    excluded: list[tuple[str, ...]] = field(default_factory=list)
    filters: dict[str, list[str]] = field(default_factory=dict)
    order: str = "relevance"


def words(text: str) -> tuple[str, ...]:
    return tuple(_TOKEN.findall(text.lower()))


def parse(text: str) -> Query:
    """Words, "phrases", -exclusions and key:value or key:"a value" filters; keys in lower case, repeatable.

    An unclosed quote reaches to the end. Stop words are words like others.
    """
    q = Query()
    for minus, key, quoted, plain in _FILTER.findall(text):
        if key.lower() == "sort":
            q.order = quoted or plain
        elif not minus:
            q.filters.setdefault(key.lower(), []).append(quoted or plain)
    for minus, quoted, plain in _PART.findall(_FILTER.sub(" ", text)):
        negative = minus == "-" or plain.startswith("-")
        found = words(quoted or plain.lstrip("-"))
        if found:
            parts = [found] if quoted else [(w,) for w in found]
            (q.excluded if negative else q.phrases).extend(parts)
    return q


def with_attribute(query: str, attribute: str | None = None) -> str:
    """The query without its attribute filters, and with a new one."""
    rest = " ".join(re.sub(r'attribute:"[^"]*"', " ", query).split())
    return f'{rest} attribute:"{attribute}"'.strip() if attribute else rest


def with_filter(query: str, key: str, value: str, remove: bool = False) -> str:
    """The query with a filter added once, or without it."""
    found = re.compile(rf'(?i)(?<!\S){re.escape(key)}:(?:"{re.escape(value)}"|{re.escape(value)}(?!\S))')
    rest = " ".join(found.sub(" ", query).split())
    return rest if remove else f'{rest} {key}:"{value}"'.strip()


class Thesaurus:
    """Groups of words that stand for each other."""

    def __init__(self, rows: Iterable[tuple[int, str]]):
        self.groups: dict[int, list[str]] = {}
        for group, word in rows:
            own = self.groups.setdefault(group, [])
            if (w := word.strip().lower()) and w not in own:
                own.append(w)

    def of(self, word: str) -> list[str]:
        out = [word]
        for own in self.groups.values():
            out += [w for w in own if word in own and w not in out]
        return out


def run_query(docs: DataFrame, query: str, principals: Sequence[str] | None = None, thesaurus: Thesaurus | None = None, collections: Sequence[str] = (), languages: Sequence[str] = ()) -> DataFrame:
    """doc_id, score and the columns of docs but the text, of documents that match: hits of words and phrases added up.

    Filters name columns of docs (collection, lang, ...), any of their values; attribute:"k=v" looks into a map column
    `attributes`. Everything is in one row's reach, so nothing is shuffled but by what the caller does next.
    """
    q = parse(query)
    rows = docs
    if principals is not None:
        rows = rows.where(visible(principals, F.col("acl_allow"), F.col("acl_denied")))
    for key, chosen in (*q.filters.items(), ("collection", list(collections)), ("lang", list(languages))):
        if chosen and key == "attribute":
            for one in chosen:
                name, _, value = one.partition("=")
                rows = rows.where(F.array_contains(F.element_at("attributes", name), value))
        elif chosen:
            rows = rows.where(F.col(key).isin(*chosen))
    forms = lambda w: thesaurus.of(w) if thesaurus else [w]
    wanted = sorted({f for p in (*q.phrases, *q.excluded) for w in p for f in forms(w)})
    keep = [c for c in rows.columns if c not in ("doc_id", "text")]
    if not q.phrases:
        return rows.select("doc_id", F.lit(0).cast("long").alias("score"), *keep)
    low = F.lower("text")
    for p in q.phrases:
        for w in p:
            held = [F.contains(low, F.lit(f)) for f in forms(w)]
            rows = rows.where(F.greatest(*held, *held[:1]))
    rows = rows.withColumn("_w", F.explode(F.array(search.tokens(F.col("text")))))
    at = {w: search.positions(F.col("_w"), w) for w in wanted}

    def hits(p: tuple[str, ...]):
        out = None
        for k, w in enumerate(p):
            places = F.array_distinct(F.flatten(F.array(*(search.shifted(at[f], k) for f in forms(w)))))
            out = places if out is None else F.array_intersect(out, places)
        return F.size(out)

    names = []
    for k, p in enumerate(q.phrases):
        rows = rows.withColumn(f"_n{k}", hits(p)).where(F.col(f"_n{k}") > 0)
        names.append(F.col(f"_n{k}"))
    for p in q.excluded:
        rows = rows.where(hits(p) == 0)
    return rows.select("doc_id", sum(names[1:], names[0]).cast("long").alias("score"), *keep)


def search_page(docs: DataFrame, query: str, page: int = 1, size: int = 10, most: int = 250, **how) -> DataFrame:
    """A page of run_query's result, in the order the query names."""
    return search.page(run_query(docs, query, **how), page, size, parse(query).order, most)
