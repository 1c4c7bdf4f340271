"""Every query and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import registry
from tests.llm import brute

CLASH = ["__t", "__low", "__assign", "__secrets", "__language", "__plain", "id", "sum", "n", "rep", "sig", "kind", "blob", "pid", "train", "language", "secrets", "words", "shard", "piece", "component", "places", "token", "epoch"]
LONG = " ".join(f"word{k % 997} the" for k in range(60_000))
COPY = "one two three four five six seven eight nine ten eleven twelve " * 3
ROWS = [
    (1, "the plain text of a document, in words that are like others.", "en", "src1", 10), (2, None, "en", "src1", None), (3, "", "de", "src2", 0), (4, LONG, "en", "src3", len(LONG)), (5, COPY, "en", "src1", 9), (6, COPY, None, None, 9), (6, COPY, None, None, 9),
    (7, COPY + "more", "fr", "src2", 9), (None, "a text without an id", "en", "src1", 3), (8, "12345 !!! ***", None, "src9", 4), (9, "token = abcdefgh12345 der die das und nicht mit", "de", "src2", 4), (10, "le la les des que qui dans avec pour une", "fr", "src4", 4), (11, "\0 ퟿ 🙂 ẞ", "xx", "", 1), (12, "   \n\t ", "en", "src1", 3),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.999, 0.01], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (8, [float("inf"), 1.0], 1), (9, [], 1), (10, [1.0], 1)]


def write(spark, folder, docs, vectors):
    d = spark.createDataFrame(docs, COLUMNS)
    d.select("*", *(F.lit("x").alias(c) for c in CLASH)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    e = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    e.select("*", *(F.lit("x").alias(c) for c in ("rep", "dim", "near", "shards", "good", "times"))).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("full"), ROWS, VECTORS)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), [], [])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, none, name):
    assert registry.QUERIES[name](spark, none).collect() == []


@pytest.mark.parametrize("name", [n for n in sorted(registry.QUERIES) if n.split("_")[0] in ("op2", "op3", "op4", "op6", "op9", "op10")])
def test_a_row_for_each_row(spark, full, name):
    got = registry.QUERIES[name](spark, full).collect()
    assert len(got) == len(ROWS) and sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)


def by_id(spark, full, name):
    return {r.doc_id: r for r in registry.QUERIES[name](spark, full).collect()}


def test_licenses(spark, full):
    assert by_id(spark, full, "op1_license_scan") == {}


def test_secrets(spark, full):
    got = by_id(spark, full, "op2_secret_scan")
    assert got[9].n_assign == 1 and got[2].spans == "" and got[None].spans == ""


def test_streams(spark, full):
    got = by_id(spark, full, "op3_transport_stream")
    assert (got[2].n_bytes, got[2].payload_bytes) == (0, 576) and got[2].media_sha256 == got[3].media_sha256 and got[5].media_sha256 == got[6].media_sha256


def test_suffixes(spark, full):
    got = by_id(spark, full, "op4_suffix_dedup")
    assert got[2].n_bytes == 0 and got[6].n_removed == got[6].n_bytes and got[7].n_removed == got[6].n_bytes
    # a row without an id is the first of all; rows that repeat are one document
    assert got[None].n_removed == 0 and got[4].n_removed > 0


def test_vectors(spark, full):
    got = [tuple(r) for r in registry.QUERIES["op5_embedding_dedup"](spark, full).collect()]
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(VECTORS) and by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[3] == (3, 1, False)
    assert all(by[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10)) and by[None][0] == 0


def test_languages(spark, full):
    got = by_id(spark, full, "op6_language_id")
    assert got[2].lang_pred == got[3].lang_pred == got[8].lang_pred == got[12].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())


def test_mixing(spark, full):
    got = registry.QUERIES["op7_mixing"](spark, full).collect()
    assert got and {r.source for r in got} <= {"src1", "src2", "src3", "src4", "src9", "none", ""}


def test_packing(spark, full):
    got = registry.QUERIES["op8_best_fit_packing"](spark, full).collect()
    assert sum(r.doc_id == 6 for r in got) == 2 and next(r for r in got if r.doc_id == 2).length == 1 and max(r.piece for r in got if r.doc_id == 4) > 5
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_jaccard(spark, full):
    got = by_id(spark, full, "op9_ngram_jaccard")
    true = brute.similar([r[:2] for r in ROWS if r[0] is not None])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == true and got[None].component_id is None


def test_language_model(spark, full):
    got = by_id(spark, full, "op10_language_model")
    assert got[2].n_tokens == got[3].n_tokens == got[12].n_tokens == 1 and got[2].score == got[3].score


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("stage", STAGES)
@pytest.mark.parametrize("table", ["full", "none"])
def test_stages(spark, request, stage, table):
    folder = request.getfixturevalue(table)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES[stage](spark, docs, folder)
    n = out.count()
    assert n == 0 if table == "none" else n > 0
    if stage != "best_fit_packing":
        assert out.columns == docs.columns and {f.name: f.dataType for f in out.schema} == {f.name: f.dataType for f in docs.schema}


def test_whole_pipeline(spark, full, none):
    got = {r.doc_id for r in corpus_pipeline.run(spark, full).collect()}
    assert not got & {2, 3, 6, 7, 8, 12} and corpus_pipeline.run(spark, none).count() == 0
