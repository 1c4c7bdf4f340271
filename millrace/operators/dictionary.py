"""Search dictionaries, prefix suggestions and spelling."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from millrace.functions.text import tokens
from millrace.operators.access import visible

LEAST_BYTES, LEAST_FREQUENCY, SUGGESTIONS, MAX_WORDS = 4, 15, 10, 1_000_000  # fixed values
# The most frequent function words of four languages
STOP_WORDS = {
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"],
    "de": ["als", "auf", "das", "dem", "den", "der", "die", "ein", "ist", "mit", "nicht", "und", "von", "zu"],
    "fr": ["avec", "dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "pour", "que", "qui", "sur", "un", "une"],
    "es": ["con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "un", "una", "y"],
}


def build(docs: DataFrame, stop_words: Sequence[str], allow: str = "acl_allow", deny: str = "acl_denied", collection: str = "collection", text: str = "text") -> DataFrame:
    """word, freq, acl_allow, acl_denied, collections: hits and united lists of each word; short and stop words left out.

    Hits are summed before they are shuffled, and every principal of a word's lists is told apart before it is gathered,
    so that no task holds more of a word than its row.
    """
    words = F.explode(tokens(F.col(text)))
    rows = docs.select(words.alias("word"), F.col(allow).alias("allow"), F.col(deny).alias("deny"), F.col(collection).alias("collection")).where((F.octet_length("word") >= LEAST_BYTES) & ~F.col("word").isin(*stop_words))
    hits = rows.groupBy("word", "allow", "deny", "collection").agg(F.count("*").alias("n"))
    of = lambda kind, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    each = hits.select("word", F.inline(F.concat(of(0, F.col("allow")), of(1, F.col("deny")), of(2, F.array("collection"))))).where("value is not null").distinct()
    gathered = lambda kind, name: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(name)
    lists = each.groupBy("word").agg(gathered(0, "acl_allow"), gathered(1, "acl_denied"), gathered(2, "collections"))
    return hits.groupBy("word").agg(F.sum("n").alias("freq")).join(lists, "word", "left").select("word", "freq", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("acl_allow", "acl_denied", "collections")))


def top(dictionary: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    return dictionary.orderBy(F.desc("freq"), "word").limit(most)


def as_text(dictionary: DataFrame) -> DataFrame:
    """One line a word: word, frequency, lists."""
    lists = [F.concat_ws(",", F.sort_array(c)) for c in ("acl_allow", "acl_denied", "collections")]
    return dictionary.select(F.concat_ws(" ", "word", F.col("freq").cast("string"), *lists).alias("value"))


def from_text(lines: DataFrame) -> DataFrame:
    p = F.split("value", " ")
    many = lambda k: F.filter(F.split(F.element_at(p, k), ","), lambda x: x != "")
    return lines.select(F.element_at(p, 1).alias("word"), F.element_at(p, 2).cast("long").alias("freq"), many(3).alias("acl_allow"), many(4).alias("acl_denied"), many(5).alias("collections"))


def suggest(dictionary: DataFrame, prefix: str, principals: Sequence[str], collections: Sequence[str] = (), most: int = SUGGESTIONS) -> DataFrame:
    """word, freq: the most frequent visible words that begin so; only the last word of a query is completed."""
    *before, last = prefix.lower().split(" ")
    rows = dictionary.where(F.col("word").startswith(last) & (F.col("freq") >= LEAST_FREQUENCY) & visible(principals, F.col("acl_allow"), F.col("acl_denied")))
    if collections:
        rows = rows.where(F.arrays_overlap("collections", F.array(*map(F.lit, collections))))
    rows = rows.orderBy(F.desc("freq"), "word").limit(most)
    return rows.select(F.concat_ws(" ", *map(F.lit, before), "word").alias("word"), "freq") if before else rows.select("word", "freq")


def suggestion_table(dictionary: DataFrame, longest: int = 8, most: int = SUGGESTIONS) -> DataFrame:
    """prefix, place, word, freq: the best words of every prefix, made once."""
    rows = dictionary.where(F.col("freq") >= LEAST_FREQUENCY).select("word", "freq", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest))), lambda k: F.substring("word", 1, k))).alias("prefix"))
    order = Window.partitionBy("prefix").orderBy(F.desc("freq"), "word")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("prefix", "place", "word", "freq")


def aspell_words(dictionary: DataFrame) -> DataFrame:
    return dictionary.where(F.col("word").rlike("^[a-z][^'0-9]*$") & (F.length("word") > 2)).select("word")


def osa_distance(a: str, b: str) -> int:
    """Edits of one letter and swaps of neighbours, no place edited twice."""
    before, last, now = [], list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


@F.pandas_udf(IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa_distance(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="object")


def shortened(word: Column, most: int) -> Column:
    """The word and all that is left of it without up to `most` letters: words within so many edits share one of these."""
    without = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    found = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, without)))
        found = F.concat(found, last)
    return F.array_distinct(found)


def correct(words: DataFrame, dictionary: DataFrame, distance: Column | None = None, most: int = 2) -> DataFrame:
    """word, correction, distance: known words and numbers stay; others get the nearest dictionary word, null and -1 if none.

    Our definition: at most two edits, the same first letter and a length within two; then more frequent, then by name.
    Candidates meet by first letter and what is left of both without a few letters, so that a word meets those near it,
    however large the dictionary. A distance of one's own is worked out only where the edits of letters allow it.
    """
    d = F.levenshtein("word", "candidate", most) if distance is None else distance
    known = dictionary.select(F.col("word").alias("candidate"), "freq")
    asked = words.select("word").distinct()
    fine = asked.join(known.select(F.col("candidate").alias("word")), "word", "left_semi").union(asked.where(F.col("word").rlike("^[0-9]+$"))).distinct()
    first = lambda c: F.substring(c, 1, 1).alias("first")
    rest = asked.join(fine, "word", "left_anti").select("word", first("word"), F.explode(shortened(F.col("word"), most)).alias("left"))
    met = rest.join(known.select("candidate", "freq", first("candidate"), F.explode(shortened(F.col("candidate"), most)).alias("left")), ["first", "left"])
    met = met.select("word", "candidate", "freq").distinct().where(F.abs(F.length("word") - F.length("candidate")) <= most)
    # a swap of neighbours is two edits of single letters
    met = met if distance is None else met.where(F.levenshtein("word", "candidate", 2 * most) >= 0)
    near = met.withColumn("distance", d).where(F.col("distance").between(0, most))
    best = near.groupBy("word").agg(F.min(F.struct("distance", (-F.col("freq")).alias("f"), "candidate")).alias("b"))
    found = asked.join(fine.withColumn("ok", F.lit(True)), "word", "left").join(best, "word", "left")
    return found.select("word", F.when(F.col("ok"), F.col("word")).otherwise(F.col("b.candidate")).alias("correction"), F.coalesce(F.when(F.col("ok"), 0).otherwise(F.col("b.distance")), F.lit(-1)).cast("int").alias("distance"))
