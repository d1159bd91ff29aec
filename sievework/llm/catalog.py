"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import (
    conversation_repair,
    decontamination,
    embedding_dedup,
    language_id,
    license_scan,
    lm_scoring,
    pii,
    quality,
    quality_rules,
    sentencepiece_viterbi,
    simhash,
    token_counts,
    whitening,
)
from . import sql
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES = {
    "op4_embedding_dedup": sql.EMBEDDING_DEDUP,
    "op5_license_scan": sql.LICENSE_SCAN,
    "op12_conversation_repair": sql.CONVERSATION_REPAIR,
    "op13_quality_rules": sql.QUALITY_RULES,
}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_lm_scoring(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return lm_scoring.cross_entropy_difference(read(spark, sf_dir, "documents"), good)


@query
def op2_sentencepiece(spark, sf_dir):
    return sentencepiece_viterbi.encode(read(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark, sf_dir):
    return decontamination.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op4_embedding_dedup(spark, sf_dir):
    found = embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query
def op5_license_scan(spark, sf_dir):
    return license_scan.license_report(read(spark, sf_dir, "documents"))


@query
def op6_pii(spark, sf_dir):
    return pii.pii_report(read(spark, sf_dir, "documents"))


@query
def op7_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    found = language_id.label_texts(docs, language_id.train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "spans")


@query
def op8_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.ratings_from_labels(read(spark, sf_dir, "labels")))
    return quality.grade_texts(docs, model).selectExpr("doc_id", "expected_grade", "tail", "tail >= 0.5 AS keep")


@query
def op9_simhash(spark, sf_dir):
    return simhash.simhash_components(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


@query
def op11_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@query
def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_report(conversation_repair.damaged(read(spark, sf_dir, "conversations")))


@query
def op13_quality_rules(spark, sf_dir):
    return quality_rules.clean_texts(read(spark, sf_dir, "documents"), cleaned=False)
