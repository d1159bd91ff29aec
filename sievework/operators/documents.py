"""Projections, filters and joins over documents, chunks and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rx


def in_namespace(df: DataFrame, namespace: str) -> DataFrame:
    """Reaches the scan; on tables partitioned by namespace it prunes folders."""
    return df.where(F.col("namespace") == namespace)


def with_document(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("document_id").isNotNull())


def metadata_filter(df: DataFrame, wanted: dict[str, str] | None, column: str = "metadata") -> DataFrame:
    """Rows whose metadata hold all wanted pairs; no pairs keep all rows."""
    for key, value in (wanted or {}).items():
        df = df.where(F.try_element_at(column, F.lit(key)) == value)
    return df


def metadata_contains(metadata: str, wanted: str):
    """The same with the wanted pairs in a column."""
    return F.forall(F.map_entries(wanted), lambda e: F.try_element_at(metadata, e["key"]).eqNullSafe(e["value"]))


def chunk_count(chunks: DataFrame) -> DataFrame:
    """Chunks per document, counted inside the tasks first, so a document with most of the chunks does no harm."""
    return with_document(chunks).groupBy("namespace", "document_id").agg(F.count(F.lit(1)).alias("chunk_count"))


def documents_with_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunk_count(chunks).withColumnRenamed("document_id", "id")
    return documents.join(counts, ["namespace", "id"], "left").select(
        F.col("id").alias("document_id"),
        "file_name",
        "namespace",
        F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count"),
    )


def normalize_results(df: DataFrame, *keep: str) -> DataFrame:
    """snippet and relevance of raw search rows (chunk, score)."""
    return df.select(
        *keep,
        F.substring(rx.text_or_empty("chunk"), 1, 300).alias("snippet"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("relevance"),
    )


def default_row_shape(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        *keep,
        rx.text_or_empty("chunk").alias("chunk"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )


def previews(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.substring(rx.text_or_empty("text"), 1, 300).alias("text"), "score")


def memory_results(queries: DataFrame, found: DataFrame, store_ready: bool = True) -> DataFrame:
    """Result rows per query with their count; a query without results has one row with count 0.

    found: query_id, id, text, similarity, pos.
    """
    if not store_ready:
        found = found.limit(0)
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("count"))
    status = "success" if store_ready else "vector_db_disabled"
    return (
        queries.select("query_id")
        .join(counts, "query_id", "left")
        .join(found, "query_id", "left")
        .select(
            "query_id",
            F.lit(status).alias("status"),
            F.coalesce("count", F.lit(0).cast("long")).alias("count"),
            "pos",
            "id",
            "text",
            "similarity",
        )
    )


def audit_row(df: DataFrame) -> DataFrame:
    """Lengths and part counts per answered request (message, context, answer, namespace, priority)."""
    context = rx.text_or_empty("context")
    return df.withColumn(
        "retrieved_chunks", F.when(context == "", 0).otherwise(F.size(F.split(context, "\n\n", -1)))
    ).withColumns(
        {
            "input_length": F.length(rx.text_or_empty("message")),
            "context_length": F.length(context),
            "output_length": F.length(rx.text_or_empty("answer")),
        }
    )
