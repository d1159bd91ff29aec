"""Weighting and summing up memories found for a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import objects, rx
from .context import or_empty, ordered_join, two_decimals
from .ranking import DIGITS, per_query
from .vector_search import local_search

NO_MEMORY_NUMBERED = "No relevant memories were found."
NO_MEMORY_TOP3 = "(no relevant memory found)"


def memory_weight(score: Column, priority: Column, written: Column, as_of: Column) -> Column:
    """Score, priority and recency; both times in epoch milliseconds."""
    # written one day after as_of, recency has no value and counts nothing
    spread = F.nullif(1 + (as_of - written) / F.lit(86400000.0), F.lit(0.0))
    recency = F.when(written.isNotNull(), F.coalesce(1 / spread, F.lit(0.0)))
    return F.round(score * 0.65 + priority * 0.25 + recency * 0.10, DIGITS)


def apply_weights(df: DataFrame, as_of: Column) -> DataFrame:
    return df.withColumn("final_score", memory_weight(F.col("score"), F.col("priority"), F.col("written_ms"), as_of))


def top_per_query(df: DataFrame, k: int, *order: Column, out: str = "rank") -> DataFrame:
    """First k rows per query; the literal k lets every task drop rows before the shuffle."""
    return (
        df.withColumn(out, F.row_number().over(per_query().orderBy(*order)))
        .where(F.col(out) <= k)
        .withColumn(out, F.col(out) - 1)
    )


def oversample_topk(df: DataFrame, as_of: Column, k: int = 5) -> DataFrame:
    """Take 3k by score, weigh them, keep k by weight."""
    pool = top_per_query(df, 3 * k, F.desc("score"), F.col("pos"), out="pos")
    return top_per_query(apply_weights(pool, as_of), k, F.desc("final_score"), F.col("pos"))


def summary_numbered(df: DataFrame, queries: DataFrame) -> DataFrame:
    shown = F.round("final_score", 2)
    line = F.concat(
        F.lit("\n"),
        (F.col("rank") + 1).cast("string"),
        F.lit(". "),
        F.substring(rx.text_or_empty("text"), 1, 120),
        F.lit("... (relevance: "),
        F.call_function("format_number", shown, F.lit("0.##")),
        F.lit(")"),
    )
    found = df.groupBy("query_id").agg(
        F.concat(
            F.lit("Top "),
            F.count(F.lit(1)).cast("string"),
            F.lit(" relevant memories:\n"),
            ordered_join(F.col("rank"), line, ""),
        ).alias("context")
    )
    return or_empty(queries.select("query_id"), found, NO_MEMORY_NUMBERED).withColumnRenamed("context", "summary")


def summary_top3(df: DataFrame, queries: DataFrame) -> DataFrame:
    body = F.when(F.col("text").isNull(), F.lit("(invalid memory text)")).otherwise(F.substring("text", 1, 120))
    line = F.concat(
        F.lit("• "),
        body,
        F.lit("... (score: "),
        F.coalesce(two_decimals(F.col("final_score")), F.lit("N/A")),
        F.lit(")"),
    )
    found = (
        df.where(F.col("rank") < 3)
        .groupBy("query_id")
        .agg(F.concat(F.lit("Memory Recall:\n"), ordered_join(F.col("rank"), line, "\n")).alias("context"))
    )
    return or_empty(queries.select("query_id"), found, NO_MEMORY_TOP3).withColumnRenamed("context", "summary")


def probe(store: DataFrame, embed, key: str, texts: tuple[str, ...]) -> DataFrame:
    """Run a few given queries against the store, two results each, to see whether it answers."""
    listed = store.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("query_id", "query")
    )
    return local_search(listed.withColumn("query_vector", embed(F.col("query"))), store, key=key, k=2)


def clean_memory(df: DataFrame) -> DataFrame:
    """Add valid: a numeric id, an object as raw JSON, and a vector that is not empty."""
    valid = (
        F.col("id").isNotNull()
        & objects.is_object(F.col("raw"))
        & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)
    )
    return df.withColumn("valid", valid)


def clean_report(df: DataFrame) -> DataFrame:
    return clean_memory(df).groupBy("valid").agg(F.count(F.lit(1)).alias("entries"))


def integrity_report(df: DataFrame, expected_width: int) -> DataFrame:
    """One row of counts over the whole vector table and the status that follows from them."""
    width = F.coalesce(F.size("embedding"), F.lit(0))
    counts = df.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("id").isNull()).alias("without_id"),
        F.count_if(rx.text_or_empty("text") == "").alias("without_text"),
        F.count_if(width == 0).alias("without_vector"),
        F.count_if((width > 0) & (width != expected_width)).alias("other_width"),
    )
    status = (
        F.when(F.col("entries") == 0, "degraded")
        .when((F.col("without_id") > 0) | (F.col("without_vector") > 0) | (F.col("other_width") > 0), "error")
        .otherwise("ok")
    )
    return counts.withColumn("status", status)
