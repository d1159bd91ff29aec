"""From documents to token ids: quality, near-duplicates, benchmark passages, personal data, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet in the shared folder
and reads it back as the next stage's docs, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontamination, near_copies, pii, quality, sentencepiece_viterbi
from sievework.llm.common import named, read, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade (sound and clean) is more likely than not, by a model of the labelled documents.

    All stay if fewer than two grades are labelled. A null text is graded as an empty one.
    """
    ratings = quality.ratings_from_labels(read(spark, sf_dir, "labels"))
    return quality.select_texts(docs, quality.fit(docs, ratings))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingle similarity of 0.8 or more the one with the smallest doc_id.

    Rows are told apart by doc_id and words: of rows that share a doc_id those of other groups stay, equal ones stay once.
    Rows without a doc_id stay.
    """
    given, kept = near_copies.representatives(docs)
    kept, keyed = written(kept, "kept"), given.where("doc_id IS NOT NULL")
    gone = written(keyed.distinct().join(kept, ["doc_id", "tid"], "left_anti"), "gone")
    repeated = written(keyed.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return by_id(docs, gone, "left_anti")
    # the rows that repeat an id are sorted out apart, by their words
    once = by_id(docs, gone.select("doc_id").union(repeated), "left_anti")
    return once.union(near_copies.only(by_id(docs, repeated, "left_semi"), kept))


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose doc_id is (left_semi) or isn't (left_anti) among ids, columns in their order."""
    # the ids grow with the documents: one plan for all sizes, both sides dealt by doc_id
    return docs.join(ids.select("doc_id").distinct().hint("merge"), "doc_id", how).select(*[named(c) for c in docs.columns])


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark within the error budget."""
    return decontamination.without_items(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind, n_chars brought up to date (null for null text)."""
    masked = pii.mask_column(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, ids, n_pieces, round_trip) of all documents left."""
    return sentencepiece_viterbi.encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("pii", mask_personal_data),
    ("sentencepiece", encode_pieces),
]

# no stage but the third could be told in SQL; tests compare each with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
