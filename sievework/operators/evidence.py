"""Fusing retrieved evidence and choosing what goes into an answer.

The rows of one query are the results of a retrieval (at most 14), so windows over ``query_id`` hold short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, entities, rx, signals, text
from .ranking import DIGITS, per_query

LEAST_WEIGHT, MOST_WEIGHT, DEFAULT_WEIGHT = 0.05, 1.0, 0.5
CONCEPT_RATIO = 0.12


def redundancy_penalty(df: DataFrame) -> DataFrame:
    """0.15 where the normalised content occurred at an earlier position of the query."""
    # the digest keeps the sort key short
    earlier = W.partitionBy("query_id", "_norm").orderBy("pos")
    return (
        df.withColumn("_norm", F.sha2(text.normalize_terms(F.col("content")), 256))
        .withColumn("redundancy", F.when(F.row_number().over(earlier) > 1, 0.15).otherwise(0.0))
        .drop("_norm")
    )


def concept_continuity(df: DataFrame) -> DataFrame:
    """Reward for sharing concept terms with other rows of the query; the term sets travel as one array per query."""
    terms = df.withColumn("_terms", signals.concept_terms(F.col("content")))
    listed = terms.withColumn("_all", F.array_sort(F.collect_list(F.struct("pos", "_terms")).over(per_query())))
    ratios = F.transform(
        F.filter("_all", lambda other: other["pos"] != F.col("pos")),
        lambda other: signals.shared_concept_ratio(F.col("_terms"), other["_terms"]),
    )
    near = listed.withColumn("_near", F.filter(ratios, lambda r: r >= CONCEPT_RATIO))
    strength = F.aggregate("_near", F.lit(0.0), lambda total, r: total + r * 0.08) + F.least(
        F.size("_near") * 0.01, F.lit(0.04)
    )
    return near.withColumn("continuity", signals.clamp(strength, 0.0, 0.12)).drop("_terms", "_all", "_near")


def _number(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def fuse_evidence(df: DataFrame) -> DataFrame:
    """Weight per row from (query_id, pos, content, source, intent) and the scores and relations the rows bring."""
    base = F.coalesce(
        _number(df, "final_score"), _number(df, "weight"), _number(df, "similarity"), F.lit(DEFAULT_WEIGHT)
    )
    content = rx.text_or_empty("content")
    rows = redundancy_penalty(df.withColumn("content", content))
    preliminary = (
        base
        + signals.specificity(F.col("content"))
        + signals.density_terms(F.col("content"))
        + signals.directness(F.col("content"), rx.text_or_empty("intent"))
        + signals.relationship(
            _number(df, "neighborhood_strength"),
            _number(df, "relationship_boost"),
            _number(df, "continuity_boost"),
            _number(df, "relationship_count"),
        )
        - F.col("redundancy")
    )
    rows = concept_continuity(rows.withColumn("preliminary", signals.clamp(preliminary, LEAST_WEIGHT, MOST_WEIGHT)))
    weight = signals.clamp(F.col("preliminary") + F.col("continuity"), LEAST_WEIGHT, MOST_WEIGHT)
    place = F.row_number().over(per_query().orderBy(F.desc("weight"), "pos")) - 1
    return (
        rows.withColumn("weight", F.round(weight, DIGITS))
        .select(
            "query_id",
            "pos",
            "content",
            F.coalesce(entities.first_filled(F.col("source")), F.lit("unknown")).alias("source"),
            "weight",
            "intent",
        )
        .withColumn("pos", place)
    )


def labelled(df: DataFrame) -> DataFrame:
    """Add source label, entity and cleaned content; rows without content are dropped."""
    fields = ("source", "filename", "document_name", "document_id", "id")
    label = entities.source_label(*[F.col(f) for f in fields if f in df.columns])
    explicit = [F.col(f) for f in ("primary_entity", "entity", "owner", "subject", "name") if f in df.columns]
    return (
        df.withColumn("source_label", label)
        .withColumn("evidence_entity", entities.evidence_entity(explicit, F.col("source_label")))
        .withColumn("content", text.normalize_content(F.col("content")))
        .where(F.col("content") != "")
        .withColumn("weight", F.coalesce(_number(df, "weight"), F.lit(DEFAULT_WEIGHT)))
    )


def group_by_source(df: DataFrame) -> DataFrame:
    """One row per query and source: total weight, first entity, first position."""
    return (
        labelled(df)
        .groupBy("query_id", F.col("source_label").alias("source"))
        .agg(
            F.min_by("evidence_entity", "pos").alias("entity"),
            F.round(F.sum("weight"), DIGITS).alias("total_weight"),
            F.count(F.lit(1)).alias("entries"),
            F.min("pos").alias("first_pos"),
        )
    )


def with_source_totals(df: DataFrame) -> DataFrame:
    """The numbers of group_by_source on every labelled row; windows on (query, source) need no second pass."""
    of_source = W.partitionBy("query_id", "source_label")
    first = F.min(F.struct("pos", "evidence_entity")).over(of_source)
    return (
        df.withColumn("_first", first)
        .withColumn("entity", F.col("_first.evidence_entity"))
        .withColumn("first_pos", F.col("_first.pos"))
        .withColumn("total_weight", F.round(F.sum("weight").over(of_source), DIGITS))
        .drop("_first")
    )


def semantic_tiers(df: DataFrame) -> DataFrame:
    """core, supporting or peripheral per row within its query and source; two rows or fewer are all core."""
    of_source = W.partitionBy("query_id", "source_label")
    rows = df.withColumn("_n", F.count(F.lit(1)).over(of_source)).withColumn(
        "tier_row",
        F.when(F.col("_n") <= 2, F.row_number().over(of_source.orderBy("pos"))).otherwise(
            F.row_number().over(of_source.orderBy(F.desc("weight"), "pos"))
        ),
    )
    core = F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.25))
    supporting = F.greatest(core + 1, F.ceil(F.col("_n") * 0.7))
    tier = (
        F.when((F.col("_n") <= 2) | (F.col("tier_row") <= core), "core")
        .when(F.col("tier_row") <= supporting, "supporting")
        .otherwise("peripheral")
    )
    return rows.withColumn("tier", tier).drop("_n")


def dedupe_content(df: DataFrame, chars: int = 240) -> DataFrame:
    """Collapsed content; the first row per query and beginning of the content in lower case."""
    first = W.partitionBy("query_id", "_start").orderBy("pos")
    return (
        df.withColumn("content", rx.collapse(rx.text_or_empty("content")))
        .where(F.col("content") != "")
        .withColumn("_start", F.substring(F.lower("content"), 1, chars))
        .withColumn("_copy", F.row_number().over(first))
        .where(F.col("_copy") == 1)
        .drop("_start", "_copy")
    )


MAX_EVIDENCE, MAX_PER_SOURCE, ENOUGH = 8, 2, 5


def source_key(df: DataFrame) -> Column:
    names = [F.col(c) for c in ("document_id", "source") if c in df.columns]
    if "metadata" in df.columns:
        names += [F.try_element_at("metadata", F.lit("documentId")), F.try_element_at("metadata", F.lit("source"))]
    return F.coalesce(entities.first_filled(*names), F.lit("unknown"))


def source_cap_with_fallback(df: DataFrame, order: tuple[Column, ...]) -> DataFrame:
    """At most 2 rows per source and 8 in all; when fewer than 5 were kept, the rest fills up to 8. chosen_pos orders."""
    rows = df.withColumn("_key", source_key(df)).withColumn("_place", F.row_number().over(per_query().orderBy(*order)))
    within = F.row_number().over(W.partitionBy("query_id", "_key").orderBy("_place"))
    rows = rows.withColumn("_capped", within <= MAX_PER_SOURCE)
    running = F.row_number().over(W.partitionBy("query_id", "_capped").orderBy("_place"))
    rows = rows.withColumn("_running", running).withColumn(
        "_first", F.col("_capped") & (F.col("_running") <= MAX_EVIDENCE)
    )
    rows = rows.withColumn("_kept", F.sum(F.col("_first").cast("int")).over(per_query()))
    # with fewer than 5 kept every capped row is among them, so the leftovers are exactly the uncapped rows
    fill = ~F.col("_first") & (F.col("_kept") < ENOUGH) & (F.col("_kept") + F.col("_running") <= MAX_EVIDENCE)
    return (
        rows.where(F.col("_first") | fill)
        .withColumn("chosen_pos", F.row_number().over(per_query().orderBy(F.desc("_first"), "_place")) - 1)
        .drop("_key", "_place", "_capped", "_running", "_first", "_kept")
    )


def _low_evidence() -> Column:
    return ((F.col("evidence_rows") <= 2) & (F.col("sources") <= 1)) | (F.col("total_length") < 900)


def evidence_quality(df: DataFrame) -> DataFrame:
    # rows without any source count as one source
    return df.groupBy("query_id").agg(
        F.sum(F.length("content")).alias("total_length"),
        F.countDistinct(source_key(df)).alias("sources"),
        F.count(F.lit(1)).alias("evidence_rows"),
    ).withColumn("low_evidence", _low_evidence())


def with_quality(df: DataFrame) -> DataFrame:
    """The numbers of evidence_quality on every row."""
    return df.withColumns(
        {
            "total_length": F.sum(F.length("content")).over(per_query()),
            "sources": F.size(F.collect_set(source_key(df)).over(per_query())),
            "evidence_rows": F.count(F.lit(1)).over(per_query()),
        }
    ).withColumn("low_evidence", _low_evidence())


BUCKET_NAMES = [name for name, *_ in classify.BUCKETS]


def bucket_rows(df: DataFrame, order: str = "pos", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per query, bucket and distinct content, at most 4 (operational 5) per bucket in order."""
    rows = df.select(
        "query_id",
        *keep,
        F.col(order).alias("_order"),
        rx.trim(rx.text_or_empty("content")).alias("content"),
    ).where(F.col("content") != "")
    rows = rows.withColumn("bucket", F.explode(classify.abstraction_buckets(F.col("content"))))
    first = W.partitionBy("query_id", "bucket", "content").orderBy("_order")
    rows = rows.withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") == 1)
    place = W.partitionBy("query_id", "bucket").orderBy("_order")
    limit = F.when(F.col("bucket") == "operational", 5).otherwise(4)
    return (
        rows.withColumn("bucket_pos", F.row_number().over(place))
        .where((F.col("bucket_pos") <= 5) & (F.col("bucket_pos") <= limit))
        .drop("_order", "_copy")
    )
