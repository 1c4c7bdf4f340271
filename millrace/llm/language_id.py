"""Language identification by rank-order profiles.

A text's most frequent letter n-grams (one to three letters, word edges included) are ranked; a language's
profile is the same ranking over all its training texts. The out-of-place distance adds, for each n-gram of the
text, how far its rank is from the profile's; an n-gram missing there counts as the profile's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.queries.tables import CRC32

from .common import PIECE, fold, small_batches, trim

PROFILE = 300
UNKNOWN = "und"
MAX_LANGUAGES = 10_000
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def grams(text: str | None) -> np.ndarray:
    """A text's n-grams as integers of 21 bits a letter (0x20 is a word's edge); empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    x = np.where(letter, codes, 32)[letter | np.append(letter[1:], False)].astype(np.int64)
    x = np.concatenate(([32], x, [32]) if x[0] != 32 else (x, [32]))
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    return np.concatenate((x[x != 32], two, three))


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct n-grams in order and how often it has each; long texts in pieces of whole words."""
    text, found, at = (text or "").lower(), [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        found.append(np.unique(grams(text[at:end]), return_counts=True))
        at = end
    if len(found) < 2:
        return found[0] if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    keys, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(which, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def ranked(keys: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """The most frequent of n-grams in order, more frequent ones first, equal ones by their letters."""
    return keys[np.argsort(-count, kind="stable")[:size]]


def _counted(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, pd.Series] = {}
    for batch in rows:
        for lang, texts in batch.groupby("lang", sort=False)["text"]:
            for k in range(0, len(texts), 200):
                found = [counted(t) for t in texts.iloc[k : k + 200]]
                keys, which = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                more = pd.Series(np.bincount(which, weights=np.concatenate([n for _, n in found])).astype(np.int64), index=keys)
                total[lang] = more if lang not in total else total[lang].add(more, fill_value=0)
    for lang, n in total.items():
        yield pd.DataFrame({"lang": lang, "gram": n.index.to_numpy(np.int64), "n": n.to_numpy(np.int64)})
    trim()


def learn_profiles(rows: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """lang, gram, place (from 0): each language's `size` most frequent n-grams over all rows given.

    Rows with a null text or language teach nothing; ties go to the smaller n-gram.
    """
    small_batches(rows.sparkSession)
    pairs = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = pairs.mapInPandas(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # the bound on row_number() lets every task keep its own first ones only
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("place"))


def identifier(profiles: DataFrame, size: int = PROFILE):
    """A pandas UDF text -> struct(lang_pred, score) that compares with every profile.

    The profiles, at most `size` rows for each language, are all that comes to the driver.
    """
    table = profiles.limit(size * MAX_LANGUAGES + 1).toPandas()
    if len(table) > size * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    known = []
    for lang, t in sorted(table.groupby("lang"), key=lambda x: x[0]):
        t = t.sort_values("gram")
        known.append((lang, t["gram"].to_numpy(np.int64), t["place"].to_numpy(np.int64)))

    def one(text: str | None) -> tuple[str, float]:
        own = ranked(*counted(text), size)
        if not len(own) or not known:
            return UNKNOWN, 0.0
        place, best = np.arange(len(own)), (0, "")
        for k, (lang, keys, places) in enumerate(known):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            far = int(np.where(keys[at] == own, np.abs(places[at] - place), size).sum())
            if k == 0 or far < best[0]:
                best = far, lang
        return best[1], 1.0 - best[0] / (size * len(own))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])
        trim()
        return found

    # so that a filter on the result and its later use read one evaluation
    return predict.asNondeterministic()


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column `into`: lang_pred (`und` without letters) and score, 1 for no distance at all.

    Null and letterless texts get (`und`, 0); every other text a learned language, ties the first by name; with no
    profile at all everything is `und`. Other columns pass through; one named as `into` is replaced.
    """
    return docs.withColumn(into, identifier(profiles)(F.col(text)))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 5) == 0


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


_CRC = CRC32.format("coalesce(doc_id::varchar, '')")
OP6_SQL = f"""
with d as (select doc_id, lang, {_CRC} % 5 = 0 as held_out, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') as w, text is not null as given from documents),
x as (select *, ' ' || array_to_string(w, ' ') || ' ' as s from d),
g as (select doc_id, lang, held_out, given, unnest(list_transform(range(1, length(s) + 1), lambda i: substr(s, i, 1)) || list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) || list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) as gram from x where len(w) > 0),
own as (select doc_id, gram, count(*) as n from g where gram <> ' ' group by 1, 2),
ranked as (select doc_id, gram, row_number() over (partition by doc_id order by n desc, length(gram), gram) - 1 as place from own qualify place < {PROFILE}),
learned as (select lang, gram, count(*) as n from g where gram <> ' ' and not held_out and lang is not null and given group by 1, 2),
profile as (select lang, gram, row_number() over (partition by lang order by n desc, length(gram), gram) - 1 as place from learned qualify place < {PROFILE}),
size as (select doc_id, count(*) as k from ranked group by 1),
near as (select r.doc_id, p.lang, sum({PROFILE} - abs(r.place - p.place)) as saved from ranked r join profile p on r.gram = p.gram group by 1, 2),
far as (select s.doc_id, l.lang, ({PROFILE} * k - coalesce(saved, 0))::bigint as far, k from size s cross join (select distinct lang from profile) l left join near n on n.doc_id = s.doc_id and n.lang = l.lang),
best as (select doc_id, lang, 1.0::double - far::double / ({PROFILE} * k)::double as score from far qualify row_number() over (partition by doc_id order by far, lang) = 1)
select d.doc_id, d.held_out, coalesce(best.lang, '{UNKNOWN}') as lang_pred, coalesce(score, 0::double) as score from d left join best on best.doc_id = d.doc_id
"""
