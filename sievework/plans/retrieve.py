"""Retrieval for a whole query table in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, entities, rx, signals, text
from ..operators import access, ranking
from ..operators.vector_search import embed_distinct, match_vectors
from ..session import cut_lineage, fetch

FETCH_FLOOR = 0.10


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Add the profile's columns, the normalised query and its terms to (query_id, query, ...)."""
    profile = classify.query_profile(F.col("query"))
    return (
        queries.where(rx.trim(rx.text_or_empty("query")) != "")
        .withColumn("_profile", profile)
        .select("*", "_profile.*")
        .drop("_profile")
        .withColumnRenamed("type", "profile")
        .withColumn("normalized", text.normalize_query(F.col("query")))
        .withColumn("terms", text.query_terms(F.col("normalized")))
    )


def candidates(
    queries: DataFrame, corpus: DataFrame, *, key: str, own_key: str | None = None, floor: float = FETCH_FLOOR
) -> DataFrame:
    """Best vectors per prepared query with the text of their rows.

    Search and text are read apart: the scan sees only scope, key and vector, and the texts are fetched by key for the
    few rows kept. The hits are written before that, so nothing later can cause a second scan of all vectors. Up to a
    million hits are broadcast: then the texts are read in place and only those found move.
    """
    hits = match_vectors(
        queries,
        corpus,
        key=key,
        top=F.col("match_count"),
        largest=classify.MAX_MATCH_COUNT,
        floor=floor,
        own_key=own_key,
    )
    texts = corpus.select(key, "filename", "chunk_text")
    return fetch(hits, texts, key)


def shape(found: DataFrame) -> DataFrame:
    """Content with single spaces and a file name for every row."""
    return found.withColumn("content", rx.collapse(rx.text_or_empty("chunk_text"))).withColumn(
        "filename",
        entities.source_file(F.col("filename"), F.col("chunk_text"), signals.synthetic_id(F.col("content"))),
    ).drop("chunk_text")


def scored(found: DataFrame, prepared: DataFrame) -> DataFrame:
    """Shaped, filtered, de-duplicated and scored candidates, before any cap."""
    settings = prepared.select("query_id", "profile", "top_k", "threshold", "budget", "terms")
    rows = shape(ranking.by_query(found)).join(settings.hint("shuffle_hash"), "query_id")
    rows = ranking.threshold(rows.where(F.col("content") != ""))
    rows = ranking.score_candidates(ranking.dedupe_fingerprint(rows)).drop("terms")
    rows = ranking.neighborhoods(ranking.file_occurrence(rows))
    return ranking.attach_pressure(ranking.relationship_scoring(rows))


def retrieve(queries: DataFrame, corpus: DataFrame, *, key: str, own_key: str | None = None) -> DataFrame:
    """Results of every query in packing order. Prepared queries and hits are written to the checkpoint folder.

    queries: query_id, query, namespace, query_vector; corpus: key, namespace, filename, chunk_text, embedding.
    """
    prepared = cut_lineage(prepare_queries(queries))
    rows = scored(candidates(prepared, corpus, key=key, own_key=own_key), prepared)
    rows = ranking.file_scores(ranking.file_cap(rows))
    rows = ranking.budget_pack(ranking.adaptive_limits(rows))
    return ranking.final_topk(rows)


def judge_requests(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """Add status to (query_id, query, namespace, role, own_namespace): what a retrieval request is answered with."""
    judged = access.authorize(requests.withColumn("action", F.lit("chat")), matrix)
    status = (
        F.when(F.col("reason") != "ok", F.col("reason"))
        .when(rx.trim(rx.text_or_empty("query")) == "", "query required")
        .otherwise("ok")
    )
    return judged.withColumn("status", status).drop("action", "decision", "reason")


def retrieve_requests(
    requests: DataFrame, corpus: DataFrame, embed: Callable[[Column], Column], *, key: str
) -> tuple[DataFrame, DataFrame]:
    """(status per request, results of the permitted ones); each distinct normalised query is embedded once."""
    judged = cut_lineage(judge_requests(requests, access.role_matrix(requests.sparkSession)))
    permitted = judged.where(F.col("status") == "ok").withColumn(
        "normalized", text.normalize_query(F.col("query"))
    )
    asked = embed_distinct(permitted, "normalized", embed, "query_vector").drop("normalized", "status")
    return judged.select("query_id", "status"), retrieve(asked, corpus, key=key)
