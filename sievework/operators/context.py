"""Texts put together from the evidence of a query, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities, rx, text
from . import evidence

RULE = "\n\n---\n\n"
SOURCE_RULE = "\n\n----------------------\n\n"


def ordered_join(order: Column, value: Column, separator: str) -> Column:
    """Aggregate: values joined in the given order. Used on the bounded result lists of a query."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]),
        separator,
    )


def two_decimals(c: Column) -> Column:
    """Two decimals of the exact binary value, exact halves away from zero."""
    halves = (c * 8 == F.floor(c * 8)) & (F.pmod(F.abs(F.floor(c * 8)), F.lit(2)) == 1)
    return F.call_function("format_number", F.when(halves, c + F.signum(c) * 1e-9).otherwise(c), F.lit("0.00"))


def shortest_number(c: Column) -> Column:
    """Decimal text of a score as a script would print it, at most 6 digits."""
    rounded = F.round(c, 6)
    fixed = F.call_function("format_number", rounded, F.lit("0.######"))
    return fixed


def chunk_context(df: DataFrame, max_chars: int = 5000) -> DataFrame:
    """Numbered chunks with similarity between begin and end lines."""
    similarity = F.coalesce(shortest_number(F.col("similarity")), F.lit("?"))
    block = F.concat(
        F.lit("CHUNK "),
        (F.col("pos") + 1).cast("string"),
        F.lit(":\n"),
        rx.text_or_empty("content"),
        F.lit("\n\n(similarity: "),
        similarity,
        F.lit(")"),
    )
    joined = df.groupBy("query_id").agg(ordered_join(F.col("pos"), block, "\n\n").alias("context"))
    return joined.withColumn(
        "context",
        F.concat(
            F.lit("### RAG CONTEXT BEGIN\n"),
            text.truncate(F.col("context"), max_chars, "\n...[trimmed]"),
            F.lit("\n### RAG CONTEXT END"),
        ),
    )


def source_context(df: DataFrame) -> DataFrame:
    block = F.concat(
        F.lit("SOURCE "), (F.col("pos") + 1).cast("string"), F.lit(":\n"), rx.text_or_empty("content")
    )
    return df.groupBy("query_id").agg(
        ordered_join(F.col("pos"), block, SOURCE_RULE).alias("context"), F.count(F.lit(1)).alias("match_count")
    )


def or_empty(queries: DataFrame, contexts: DataFrame, empty: str = "") -> DataFrame:
    """A row for every query, also for those without results."""
    joined = queries.join(contexts, "query_id", "left")
    return joined.withColumn("context", F.coalesce("context", F.lit(empty)))


TIER_TITLES = (("core", "CORE SIGNALS"), ("supporting", "SUPPORTING CONTEXT"), ("peripheral", "PERIPHERAL CONTEXT"))


def assemble_context(df: DataFrame, requests: DataFrame) -> DataFrame:
    """The evidence of each query by source in tiers, with intent and message in front.

    df: query_id, pos, content, weight and source fields; requests: query_id, intent, message.
    """
    rows = evidence.with_source_totals(evidence.semantic_tiers(evidence.labelled(df)))
    line = F.concat(F.lit("- ("), F.col("entity"), F.lit(") "), F.col("content"))
    tier_lines = [
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("tier") == tier, F.struct("tier_row", line.alias("line"))))),
                lambda x: x["line"],
            ),
            "\n",
        ).alias(tier)
        for tier, _ in TIER_TITLES
    ]
    sections = rows.groupBy("query_id", "source_label", "entity", "total_weight", "first_pos").agg(*tier_lines)
    tiers = [
        F.when(F.col(tier) != "", F.concat(F.lit(title + ":\n"), F.col(tier))) for tier, title in TIER_TITLES
    ]
    section = F.concat_ws(
        "\n",
        F.concat(F.lit("PRIMARY ENTITY: "), F.col("entity")),
        F.concat(F.lit("SOURCE: "), F.col("source_label")),
        F.concat(F.lit("SOURCE CONTINUITY WEIGHT: "), two_decimals(F.col("total_weight"))),
        F.lit("ENTITY CONTEXT:"),
        *tiers,
    )
    listed = sections.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct((-F.col("total_weight")).alias("w"), "first_pos", section.alias("text")))
                ),
                lambda x: x["text"],
            ),
            RULE,
        ).alias("sections")
    )
    body = F.coalesce("sections", F.lit("No evidence available."))
    whole = F.concat(
        F.lit("INTENT:\n"), F.col("intent"), F.lit("\n\nUSER MESSAGE:\n"), rx.text_or_empty("message"),
        F.lit("\n\nEVIDENCE CONTEXT:\n"), body,
    )
    return requests.join(listed, "query_id", "left").select("query_id", rx.trim(whole).alias("context"))


def concat_context(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Retrieved contents joined by blank lines, private context in front, cut, with the entity line on top.

    results: query_id, pos, content; requests: query_id, message, private_context.
    """
    useful = results.where(rx.trim(rx.text_or_empty("content")) != "")
    joined = useful.groupBy("query_id").agg(ordered_join(F.col("pos"), F.col("content"), "\n\n").alias("retrieved"))
    rows = requests.join(joined, "query_id", "left").withColumn("retrieved", rx.text_or_empty("retrieved"))
    private = text.truncate(F.col("private_context"), text.PRIVATE_CONTEXT_CHARS)
    rows = rows.withColumn("_private", private).withColumn(
        "context",
        text.truncate(
            F.when(
                rx.trim(F.col("_private")) != "", F.concat("_private", F.lit("\n\n"), F.col("retrieved"))
            ).otherwise(F.col("retrieved")),
            text.RETRIEVED_CONTEXT_CHARS,
        ),
    )
    name = F.coalesce(
        entities.message_entity(F.col("message")),
        entities.name_from_context(F.col("context"), entities.requested_token(F.col("message"))),
    )
    rows = rows.withColumn("resolved_name", name)
    return rows.withColumn(
        "context",
        F.when(
            F.col("resolved_name").isNotNull(),
            F.concat(F.lit("PRIMARY ENTITY: "), F.col("resolved_name"), F.lit("\n\n"), F.col("context")),
        ).otherwise(F.col("context")),
    ).select("query_id", "resolved_name", "context")


def evidence_text(bucketed: DataFrame, *keep: str) -> DataFrame:
    """Buckets as titled lists in fixed order; keep names columns that are equal on all rows of a query."""
    lists = bucketed.groupBy("query_id", *keep, "bucket").agg(
        ordered_join(F.col("bucket_pos"), F.concat(F.lit("- "), F.col("content")), "\n").alias("items")
    )
    place = F.array_position(F.array(*[F.lit(b) for b in evidence.BUCKET_NAMES]), F.col("bucket"))
    titled = F.concat(F.upper("bucket"), F.lit(" SIGNALS:\n"), F.col("items"))
    return lists.groupBy("query_id", *keep).agg(ordered_join(place, rx.trim(titled), "\n\n").alias("evidence_text"))


def answer_inputs(df: DataFrame, requests: DataFrame) -> DataFrame:
    """What an answering model would get: chosen evidence as text, and whether evidence is scarce."""
    order = (F.coalesce(F.col("score"), F.lit(0.0)).desc(), F.col("pos")) if "score" in df.columns else (F.col("pos"),)
    chosen = evidence.source_cap_with_fallback(evidence.dedupe_content(df), order)
    numbers = ("total_length", "sources", "evidence_rows", "low_evidence")
    rated = evidence.with_quality(chosen)
    texts = evidence_text(evidence.bucket_rows(rated, "chosen_pos", numbers), *numbers)
    return (
        requests.select("query_id")
        .join(texts, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("evidence_rows", F.lit(0)).alias("evidence_count"),
            F.coalesce("sources", F.lit(0)).alias("sources"),
            F.coalesce("total_length", F.lit(0)).alias("total_length"),
            F.coalesce("low_evidence", F.lit(True)).alias("low_evidence"),
            rx.text_or_empty("evidence_text").alias("evidence_text"),
        )
    )
