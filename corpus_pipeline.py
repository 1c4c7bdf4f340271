"""From documents to packed training sequences: language ID, near duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all of docs, and all but the last return the columns of documents.
Nulls, empty texts and empty tables pass through as the stages say; columns beyond those of documents are kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, language_id, mixing, packing, secrets
from millrace.llm.common import checkpoint, fresh, shared_folder

LEAST_SCORE = 0.2
MIX = mixing.Plan(permille=900, epochs=1)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and those far from every language's profile; fills a null
    lang with the language found. Without any labelled row nothing can be told, and only letterless texts go."""
    profiles = checkpoint(language_id.learn_profiles(docs))
    own = fresh(docs, "__language")
    found = language_id.identify(docs, profiles, into=own)
    if profiles.isEmpty():
        return found.where(F.col("text").rlike(r"\p{L}")).drop(own)
    kept = found.where((F.col(f"{own}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{own}.score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", f"{own}.lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of similar ones, of equal ids the one whose id and text have the
    smaller hash; one row of those that repeat both. Rows without a doc_id stay, as nothing names them."""
    own, named = fresh(docs, "__key"), docs.where("doc_id is not null")
    rows = named.agg(F.count("*"), F.countDistinct("doc_id")).first()
    key = F.col("doc_id") if rows[0] == rows[1] else F.xxhash64("doc_id", "text")  # a row is known by its id, or by both
    keyed = named.withColumn(own, key)
    found = checkpoint(jaccard.similar_components(keyed.select(F.col(own).alias("doc_id"), "text")))
    if rows[0] == rows[1]:
        kept = keyed.join(found.where("doc_id = component_id").select(F.col("doc_id").alias(own)), own, "left_semi")
    else:
        ids = keyed.select(F.col(own).alias("doc_id"), F.col("doc_id").alias("id"))
        first = found.distinct().join(ids.distinct(), "doc_id").groupBy("component_id").agg(F.min(F.struct("id", "doc_id")).alias("m"))
        kept = keyed.join(checkpoint(first.select(F.col("m.doc_id").alias(own))), own, "left_semi").dropDuplicates([own])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; n_chars follows the text. No row goes."""
    own = fresh(docs, "__secrets")
    done = secrets.redact(secrets.find_secrets(docs, into=own), into=own)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size(own) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the sources' target weights take; rows that share a doc_id are kept together."""
    own = fresh(docs, "__taken")
    taken = checkpoint(mixing.mix(docs, MIX).select(F.col("doc_id").alias(own)).distinct())
    return docs.join(taken, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every document left."""
    return packing.pack_pieces(checkpoint(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)))


STAGES = [("language_id", identify), ("ngram_jaccard", near_duplicates), ("secret_scan", redact), ("mixing", mix), ("best_fit_packing", pack)]
ORACLE_SQL = None  # rank-order profiles and tokenizers are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each result but the last written to the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(top)
    files.deleteOnExit(top)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}"), True)
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
