import pytest

from millrace import catalog
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(spark, sf, con, name):
    same(catalog.QUERIES[name](spark, sf), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_laws(spark, sf):
    from millrace.operators import search

    d = spark.read.parquet(f"{sf}/documents.parquet")
    p = search.postings(d, ["the", "and", "of"]).cache()
    ids = lambda x: {r.doc_id for r in x.select("doc_id").collect()}
    both, any_, phrase = ids(search.match_all(p, ["of", "the"])), ids(search.match_any(p, ["of", "the"])), ids(search.match_phrase(p, ["of", "the"]))
    assert phrase <= both <= any_ and phrase
    without = ids(search.match_none_of(search.match_all(p, ["the"]), p, ["and"]))
    assert not without & ids(search.match_all(p, ["and"]))
    p.unpersist()


def test_index_on_disk(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from millrace.operators import search

    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("collection", F.col("source"))
    search.write_index(search.postings(d, keep=("collection",)), str(tmp_path / "index"))
    got = search.match_all(search.read_index(spark, str(tmp_path / "index"), ["the", "of"]), ["the", "of"])
    assert sorted(got.collect()) == sorted(search.match_all(search.postings(d, ["the", "of"]), ["the", "of"]).collect())


def test_spelling_against_brute_force(spark, sf):
    from millrace.operators.dictionary import osa_distance
    from millrace.queries import words

    known = {r.word: r.freq for r in words._built(spark, sf).where("freq >= 15").collect()}
    for r in words.spell_osa(spark, sf).limit(150).collect():  # a fixture's size, not the query's
        near = [(osa_distance(r.word, k), -f, k) for k, f in known.items() if k[0] == r.word[0] and abs(len(k) - len(r.word)) <= 2]
        best = (0, 0, r.word) if r.word in known else min([x for x in near if x[0] <= 2], default=(-1, 0, None))
        assert (r.distance, r.correction) == (best[0], best[2])
