"""Search requests of a whole table: access, search, result rows with counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rx
from ..operators import access
from ..operators.vector_search import match_vectors
from ..session import fetch

RAG_FLOOR, RAG_TOP = 0.1, 5


def search(requests: DataFrame, corpus: DataFrame, *, key: str, k: int = 5, own_key: str | None = None) -> DataFrame:
    """Status and count per request and one row per result; refused and empty requests have one row without result.

    requests: query_id, query, namespace, role, own_namespace, query_vector.
    """
    status = (
        F.when(~access.namespace_gate(F.col("role"), F.col("namespace"), F.col("own_namespace")), "denied")
        .when(rx.trim(rx.text_or_empty("query")) == "", "query required")
        .otherwise("success")
    )
    judged = requests.withColumn("status", status)
    found = match_vectors(
        judged.where(F.col("status") == "success"), corpus, key=key, top=k, floor=None, own_key=own_key
    )
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("count"))
    return (
        judged.select("query_id", "status")
        .join(counts, "query_id", "left")
        .join(found, "query_id", "left")
        .withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    )


def rag_search(queries: DataFrame, corpus: DataFrame, *, key: str, own_key: str | None = None) -> DataFrame:
    """The five best rows above 0.1 with default shape."""
    found = match_vectors(
        queries.where(rx.text_or_empty("query") != ""),
        corpus,
        key=key,
        scope=None,
        top=RAG_TOP,
        floor=RAG_FLOOR,
        own_key=own_key,
    )
    texts = corpus.select(key, F.col("chunk_text").alias("chunk"))
    return fetch(found, texts, key).select(
        "query_id",
        key,
        "pos",
        rx.text_or_empty("chunk").alias("chunk"),
        F.coalesce("similarity", F.lit(0.0)).alias("score"),
    )
