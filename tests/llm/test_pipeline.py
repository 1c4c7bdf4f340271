import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from millrace.llm import language_id, mixing
from tests.llm import brute


def test_against_plain_stages(spark, sf):
    """Each stage, in plain Python, on what the plain stage before it kept."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    text = {i: r.text for i, r in docs.items()}

    # language: the operator's own distance, checked elsewhere, learned from all rows here
    profiles = language_id.learn_profiles(spark.read.parquet(f"{sf}/documents.parquet"))
    table = [(lang, [r.gram for r in sorted(rows, key=lambda r: r.place)]) for lang, rows in _grouped(profiles.collect())]

    def score(t):
        own = language_id.ranked(*language_id.counted(t), 300).tolist()
        far = [sum(abs(p[g] - j) if g in p else 300 for j, g in enumerate(own)) for p in ({g: k for k, g in enumerate(x)} for _, x in table)]
        return 1 - min(far) / (300 * len(own)) if own else 0

    text = {i: t for i, t in text.items() if t and re.search(r"[^\W\d_]", t) and score(t) >= P.LEAST_SCORE}
    same = brute.similar(list(text.items()))
    text = {i: t for i, t in text.items() if same[i][1] == i}
    for i, t in text.items():
        spans, at, out = brute.secrets(t), 0, ""
        for s, _, e in spans:
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        text[i] = out + t[at:]

    got = P.near_duplicates(spark, P.identify(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), sf)
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(text)
    kept = spark.createDataFrame([(i, t, docs[i].lang, docs[i].source) for i, t in text.items()], "doc_id long, text string, lang string, source string")
    taken = {r.doc_id for r in mixing.mix(kept, P.MIX).collect()}  # against SQL elsewhere
    assert taken and taken < set(text)

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = P.run(spark, sf).toPandas()
    assert set(rows.doc_id) == taken
    for i, own in rows.groupby("doc_id"):
        assert own.length.sum() == len(t.encode(text[i], add_special_tokens=False).ids) + 1
    assert (rows.groupby("sequence_id").length.sum() <= 4096).all()


def _grouped(rows):
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    return sorted(by.items())


def test_clean_documents_stay(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert P.identify(spark, d, sf).count() == d.count()
    n = P.redact(spark, d, sf).join(d.withColumnRenamed("text", "before"), "doc_id").where(F.col("text") != F.col("before"))
    assert all("[SECRET]" in r.text for r in n.select("text").collect())


def test_ids_that_repeat(spark):
    """Rows that share an id but not a text are documents of their own; each group of similar ones keeps one."""
    copy = "one two three four five six seven eight nine ten eleven twelve " * 3
    rows = [(1, "a text that stands alone here", "en", "s", 1), (1, copy, "en", "s", 1), (2, copy, "en", "s", 1), (3, copy + "more", "en", "s", 1), (3, "another text of its own", "en", "s", 1), (3, "another text of its own", "en", "s", 1), (None, copy, "en", "s", 1), (None, copy, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((r.doc_id or 0, r.text) for r in P.near_duplicates(spark, docs, "").collect())
    assert got == sorted([(0, copy), (0, copy), (1, "a text that stands alone here"), (1, copy), (3, "another text of its own")])
