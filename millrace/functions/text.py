"""Text functions: tokens, mark-up stripping, highlighting, snippets, UTF-8 repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters, digits and inner apostrophes; and the tokens c++, c#, 1%, #tag that must survive as they are.
TOKEN = r"\p{L}\+\+|\p{L}#|[0-9]+%|#[\p{L}\p{N}_]+|[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def positions(words: Column, term: str) -> Column:
    """Where in an array of tokens a term stands, from 0."""
    return F.array_compact(F.transform(words, lambda w, i: F.when(w == term, i)))


def strip_html(html: Column) -> Column:
    """Each tag becomes a space; bytes 1 to 10 go."""
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[\x01-\x0a]", "")


def without_invalid_utf8(raw: Column) -> Column:
    """Binary to text, with a replacement mark for bytes that are not UTF-8."""
    return F.make_valid_utf8(raw)


def highlight(text: Column, words: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """Marks whole words, ignoring case."""
    if not words:
        return text
    choice = "|".join(sorted((_quoted(w) for w in words), key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_])({choice})(?![\p{{L}}\p{{N}}_])", f"{before}$1{after}")


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in word)


EDGES = r"""^[.,;:!?()"']+|[.,;:!?()"']+$"""


def snippet(text: Column, words: list[str], size: int = 30) -> Column:
    """The run of `size` words with most hits, the first of equal ones; the text's head where nothing hits."""
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    wanted = F.array(*map(F.lit, sorted({w.lower() for w in words}))).cast("array<string>")
    hit = lambda p: F.when(F.array_contains(wanted, F.regexp_replace(F.lower(p), EDGES, "")), 1).otherwise(0)
    total = lambda h, i: F.aggregate(F.slice(h, i + 1, size), F.lit(0), lambda a, b: a + b)

    def shown(parts: Column) -> Column:
        n = F.size(parts)
        best = let(F.transform(parts, hit), lambda h: F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.struct(total(h, i).alias("n"), (-i).alias("at")))))
        cut = lambda at: F.concat(F.when(at > 0, "… ").otherwise(""), F.array_join(F.slice(parts, at + 1, size), " "), F.when(at + size < n, " …").otherwise(""))
        return let(-best["at"], cut)

    return F.when(text.isNotNull(), let(F.filter(F.split(text, r"\s+"), lambda p: p != ""), shown))


def summary(html: Column) -> Column:
    """struct(title, keywords, description, body) of a page, by patterns; empty where absent."""
    meta = lambda name: F.regexp_extract(html, rf"(?is)<meta\s+name=[\"']{name}[\"']\s+content=[\"']([^\"']*)", 1)
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(?:script|style|title)[^>]*>.*?</(?:script|style|title)>", " "), "<[^>]*>", " ")
    return F.struct(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), meta("keywords").alias("keywords"), meta("description").alias("description"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("body"))


def attribute_text(attributes: Column) -> Column:
    """map<string,array<string>> as k=v,k=v with commas and equals signs in values made spaces; keys sorted."""
    pairs = F.sort_array(F.flatten(F.transform(F.map_entries(attributes), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit("="), F.translate(v, ",=", "  "))))))
    return F.concat_ws(",", pairs)


def attribute_pairs(text: Column) -> Column:
    """array<struct<key,value>> of k=v,k=v; parts without a key are left out."""
    parts = F.filter(F.split(text, ","), lambda p: F.instr(p, "=") > 1)
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("value")))
