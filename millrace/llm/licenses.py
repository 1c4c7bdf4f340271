"""License scans: Dice coefficient over word bigrams against licence templates, in DataFrame functions only.

A text, its paragraphs, lines and sentences are units of comparison; so is, for a template that a text holds most of, the
block from the first to the last of the text's lines that are mostly the template's. A Dice coefficient of at least t needs
b t / (2 - t) <= a <= b (2 - t) / t for the numbers of distinct bigrams a of the unit and b of the template, so only
templates within these bounds are compared; texts without any of the words that a match must hold are passed over. The
templates, notices and full texts, ride along as a literal; nothing is joined or shuffled.
"""

from __future__ import annotations

from collections import Counter
from fractions import Fraction
from math import ceil, floor
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = Fraction(4, 5)
TEXTS = Path(__file__).parent / "license_texts"

# Public licence notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0-or-later-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def templates() -> dict[str, str]:
    """The notices above and the full texts of licences, as `<name>-text`."""
    return TEMPLATES | {f"{p.stem}-text": p.read_text("utf-8") for p in sorted(TEXTS.glob("*.txt"))}


def _bigrams(text: str) -> list[str]:
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _prepared(templates: dict[str, str], least: Fraction) -> list[tuple[str, int, int, list[str]]]:
    rows = []
    for name, text in sorted(templates.items()):
        grams = _bigrams(text)
        if grams:
            rows.append((name, ceil(len(grams) * least / (2 - least)), floor(len(grams) * (2 - least) / least), grams))
    return rows


def _probes(known: list[tuple[str, int, int, list[str]]]) -> list[list[str]]:
    """For each template words and bigrams of which every unit that matches it holds one.

    A match shares at least `low` of a template's b bigrams, so one of any b - low + 1 of them: enough are chosen, by
    long words that lie in several of them first.
    """
    chosen: dict[str, None] = {}
    out = []
    for _, low, _, grams in known:
        parts = {g: g.split(" ") for g in grams}
        own = [p for p in chosen if any(p == g or p in w for g, w in parts.items())]
        left = {g for g, w in parts.items() if not any(p == g or p in w for p in own)}
        while len(grams) - len(left) < len(grams) - low + 1:
            count = Counter(w for g in left for w in set(parts[g]) if len(w) > 6)
            best = max(count, key=lambda w: (count[w], w)) if count else max(left)
            own.append(best)
            chosen[best] = None
            left = {g for g in left if best != g and best not in parts[g]}
        out.append(own)
    return out


def normalised(text: Column) -> Column:
    """Lower-case words of a-z and 0-9, one space apart."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text; none for fewer than two words."""
    words = F.split(text, " ")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def _literal(known: list[tuple[str, int, int, list[str]]], probes: list[list[str]]) -> Column:
    """The templates as one array. Bigrams come as one string each, which the optimizer splits once."""
    many = lambda v: F.split(F.lit("|".join(v)), r"\|")
    rows = (F.struct(F.lit(n).alias("license"), F.lit(a).alias("low"), F.lit(b).alias("high"), many(g).alias("grams"), many(p).alias("probes")) for (n, a, b, g), p in zip(known, probes, strict=True))
    return F.array(*rows).cast("array<struct<license:string,low:int,high:int,grams:array<string>,probes:array<string>>>")


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: dict[str, str] | None = None, least: Fraction = LEAST) -> DataFrame:
    """doc_id, unit (text, paragraph, line, sentence or block), number, license, n_bigrams, n_shared, dice: every unit and
    template that match.

    A null or empty text has no match; neither has a unit of fewer than two words. Repeated rows match each; other
    columns are not read. Line ends are read as one line feed each; paragraphs are set off by empty lines, sentences by a
    full stop, question or exclamation mark and white space. A text of one line, paragraph or sentence is compared once. A
    block has the number of its first line, and is not given where it is the whole text.
    """
    known = _prepared(templates() if known is None else known, least)
    units = lambda kind, parts: F.transform(parts, lambda v, i: F.struct(F.lit(kind).alias("unit"), i.alias("number"), v.alias("v")))
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    several = lambda parts: F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
    probes = _probes(known)
    every = sorted({p for own in probes for p in own})
    words, pairs = [p for p in every if " " not in p], [p for p in every if " " in p]
    text_ = F.array().cast("array<string>")
    lit = lambda v: F.split(F.lit("|".join(v)), r"\|") if v else text_
    hits = F.concat(F.array_intersect(F.split("__plain", " "), lit(words)), F.filter(lit(pairs), lambda w: F.contains("__plain", w)))
    # exploding one array keeps its value from being worked out again for each use
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"), F.explode(F.array(normalised(t))).alias("__plain"))
    rows = rows.select("doc_id", "t", F.explode(F.array(hits)).alias("hits")).where(F.size("hits") > 0)
    cut = lambda pattern: several(F.split("t", pattern))
    all_units = F.concat(units("text", F.array("t")), units("paragraph", cut(PARAGRAPH)), units("line", cut("\n")), units("sentence", cut(SENTENCE)))
    rows = rows.select("doc_id", "t", "hits", F.explode(all_units).alias("u")).select("doc_id", "hits", F.when(F.col("u.unit") == "text", F.col("t")).alias("t"), "u.unit", "u.number", normalised(F.col("u.v")).alias("v"))
    rows = rows.where(F.contains("v", F.lit(" "))).withColumn("grams", F.explode(F.array(bigrams(F.col("v"))))).withColumn("n", F.size("grams"))
    # a literal of the plan, not a table: the bounds leave the few templates of a like size; of larger texts, a block may match
    table = _literal(known, probes)
    fit = lambda i: (F.get(table, i)["low"] <= F.col("n")) & ((F.get(table, i)["high"] >= F.col("n")) | F.col("t").isNotNull()) & F.arrays_overlap("hits", F.get(table, i)["probes"])
    rows = rows.withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(known) - 1)), fit)))
    of = lambda name: F.get(table, F.col("i"))[name]
    rows = rows.withColumn("n_shared", F.explode(F.array(F.size(F.array_intersect("grams", of("grams"))))))
    fits = lambda n, shared: (of("high") >= n) & (of("low") <= n) & (shared * 2 * least.denominator >= (n + F.size(of("grams"))) * least.numerator)
    rows = rows.where(fits(F.col("n"), F.col("n_shared")) | (F.col("t").isNotNull() & (F.col("n_shared") >= of("low"))))
    whole = F.array(F.struct("unit", F.col("number").cast("int").alias("number"), F.col("n"), F.col("n_shared").alias("shared")))
    found = F.concat(F.filter(whole, lambda x: fits(x["n"], x["shared"])), F.when(F.col("t").isNotNull(), F.filter(_block(F.split("t", "\n"), of("grams")), lambda x: fits(x["n"], x["shared"]))).otherwise(F.array()))
    rows = rows.select("doc_id", of("license").alias("license"), F.size(of("grams")).alias("b"), F.explode(found).alias("x"))
    return rows.select("doc_id", "x.unit", "x.number", "license", F.col("x.n").alias("n_bigrams"), F.col("x.shared").alias("n_shared"), (F.col("x.shared") * F.lit(2.0) / (F.col("x.n") + F.col("b"))).alias("dice"))


PARAGRAPH, SENTENCE = r"\n[ \t]*\n+", r"[.?!][ \t]+"


def _block(lines: Column, grams: Column) -> Column:
    """The block of lines of a template's bigrams, as an array of one unit, or of none."""
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    own = lambda v: let(bigrams(normalised(v)), lambda g: (F.size(g) > 0) & (F.size(F.array_intersect(g, grams)) * 2 >= F.size(g)))
    unit = lambda first, last: let(bigrams(normalised(F.array_join(F.slice(lines, first, last - first + 1), "\n"))), lambda g: F.struct(F.lit("block").alias("unit"), (first - 1).cast("int").alias("number"), F.size(g).alias("n"), F.size(F.array_intersect(g, grams)).alias("shared")))
    ends = lambda f: F.struct(F.array_position(f, True).alias("first"), (F.size(f) - F.array_position(F.reverse(f), True) + 1).alias("last"), F.size(f).alias("size"))
    found = let(F.transform(lines, own), lambda f: let(ends(f), lambda e: F.when((e["first"] > 0) & (e["last"] - e["first"] + 1 < e["size"]), unit(e["first"].cast("int"), e["last"].cast("int")))))
    return F.filter(F.array(found), lambda x: x.isNotNull())


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_ROWS = ", ".join("('{}', {}, {}, string_split('{}', '|'))".format(n, a, b, "|".join(g)) for n, a, b, g in _prepared(templates(), LEAST))
_GRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_WORDS = "string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ')"
_PART = "select doc_id, '{0}', unnest(range(0, len({1}))), unnest({1}), null from docs where len({1}) > 1"
_FITS = f"{{n}} between low and high and {{shared}} * {2 * LEAST.denominator} >= ({{n}} + len(tgrams)) * {LEAST.numerator}"
OP1_SQL = f"""
with templates(license, low, high, tgrams) as (values {_ROWS}),
docs as (select doc_id, regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g') as t from documents),
units(doc_id, unit, number, v, t) as (select doc_id, 'text', 0, t, t from docs
    union all {_PART.format("paragraph", f"string_split_regex(t, '{PARAGRAPH}')")}
    union all {_PART.format("line", "string_split(t, chr(10))")}
    union all {_PART.format("sentence", f"string_split_regex(t, '{SENTENCE}')")}),
words as (select doc_id, unit, number, t, {_WORDS.format("v")} as w from units),
grams as (select doc_id, unit, number, t, {_GRAMS.format("w")} as g from words where len(w) > 1),
compared as (select doc_id, unit, number, t, license, low, high, tgrams, len(g) as n, len(list_intersect(g, tgrams)) as shared from grams join templates on len(g) >= low and (len(g) <= high or t is not null)),
lined as (select doc_id, license, low, high, tgrams, list_transform(string_split(t, chr(10)), lambda v: {_GRAMS.format(_WORDS.format("v"))}) as lg, string_split(t, chr(10)) as lines from compared where t is not null and shared >= low),
flagged as (select *, list_transform(lg, lambda g: len(g) > 0 and len(list_intersect(g, tgrams)) * 2 >= len(g)) as f from lined),
ends as (select *, list_position(f, true) as first, len(f) - list_position(list_reverse(f), true) + 1 as last from flagged where list_contains(f, true)),
block_words as (select doc_id, license, low, high, tgrams, first, {_WORDS.format("array_to_string(lines[first:last], chr(10))")} as w from ends where last - first + 1 < len(lines)),
block_grams as (select doc_id, license, low, high, tgrams, first, {_GRAMS.format("w")} as g from block_words),
blocks as (select doc_id, first - 1 as number, license, low, high, tgrams, len(g) as n, len(list_intersect(g, tgrams)) as shared from block_grams),
found as (select doc_id, unit, number, license, n, shared, tgrams from compared where {_FITS.format(n="n", shared="shared")}
    union all select doc_id, 'block', number, license, n, shared, tgrams from blocks where {_FITS.format(n="n", shared="shared")})
select doc_id, unit, number::int as number, license, n::int as n_bigrams, shared::int as n_shared, shared * 2.0::double / (n + len(tgrams)) as dice from found
"""
