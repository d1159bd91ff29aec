"""Re-ranking and packing of search results.

Each query has at most ``classify.MAX_MATCH_COUNT`` candidates when these steps run, because the search before them keeps
no more. All windows are partitioned by ``query_id`` (alone or with more columns), so after ``by_query`` the rows stay
where they are: the whole re-ranking is one shuffle of short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rx, signals

MAX_PER_FILE = 3
NEIGHBOURS = 15
NEIGHBOUR_OVERLAP = 0.12
BUDGET_CEILING = 16000
ROUNDS = 3
# scores are compared at 9 digits: a difference beyond that is summation order, not meaning
DIGITS = 9


def per_query():
    return W.partitionBy("query_id")


def by_query(df: DataFrame) -> DataFrame:
    """Rows of a query together. The number is given, because the lists are small in bytes but costly to score:
    by size alone AQE would merge them into a few tasks."""
    session = df.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return df.repartition(parts, "query_id")


def threshold(df: DataFrame, similarity: str = "similarity", least: str = "threshold") -> DataFrame:
    return df.where(F.col(similarity) >= F.col(least))


def drop_empty(df: DataFrame, content: str = "content") -> DataFrame:
    return df.where(rx.trim(rx.text_or_empty(content)) != "")


def dedupe_fingerprint(df: DataFrame) -> DataFrame:
    """Keep the first row per query and content fingerprint and number the rows anew."""
    seen = W.partitionBy("query_id", "fingerprint").orderBy("pos")
    kept = (
        df.withColumn("fingerprint", signals.fingerprint(F.col("content")))
        .withColumn("_copy", F.row_number().over(seen))
        .where(F.col("_copy") == 1)
        .drop("_copy")
    )
    return renumber(kept, F.col("pos"))


def renumber(df: DataFrame, *order: Column, out: str = "pos") -> DataFrame:
    return df.withColumn(out, F.row_number().over(per_query().orderBy(*order)) - 1)


def score_candidates(df: DataFrame) -> DataFrame:
    """Similarity plus keyword, coverage and density boosts."""
    scored = df.withColumn("matched_terms", signals.term_matches(F.col("content"), F.col("terms"))).withColumn(
        "_words", signals.words(F.col("content"))
    )
    scored = scored.withColumn("semantic_density", signals.density(F.col("_words")))
    boosted = (
        F.col("similarity")
        + F.col("matched_terms") * 0.03
        + F.least(F.col("matched_terms") * 0.015, F.lit(0.08))
        + F.col("semantic_density") * 0.03
    )
    return scored.withColumn("boosted", boosted).withColumn("word_set", F.array_distinct("_words")).drop("_words")


def file_occurrence(df: DataFrame) -> DataFrame:
    return df.withColumn("file_count", F.count(F.lit(1)).over(W.partitionBy("query_id", "filename")))


def neighborhoods(df: DataFrame) -> DataFrame:
    """Overlap of each row with the first 15 rows of its query: summed strength and number of neighbours.

    The word sets of those rows travel as one array per query; no row pairs are made. A word_set column is used up.
    """
    known = F.col("word_set") if "word_set" in df.columns else signals.word_set(F.col("content"))
    sets = (
        df.withColumn("_words", known)
        .withColumn("_n", F.size("_words"))
        .withColumn("_words", signals.telling_words(F.col("_words")))
    )
    first = F.when(F.col("pos") < NEIGHBOURS, F.struct("pos", "_n", "_words"))
    listed = sets.withColumn("_first", F.array_sort(F.collect_list(first).over(per_query())))
    overlaps = F.transform(
        F.filter("_first", lambda other: other["pos"] != F.col("pos")),
        lambda other: F.size(F.array_intersect(F.col("_words"), other["_words"]))
        / F.greatest(F.col("_n"), other["_n"], F.lit(1)),
    )
    near = listed.withColumn("_near", F.filter(overlaps, lambda o: o >= NEIGHBOUR_OVERLAP))
    return (
        near.withColumn("neighborhood_strength", F.aggregate("_near", F.lit(0.0), lambda total, o: total + o))
        .withColumn("relationship_count", F.size("_near"))
        .drop("_n", "_words", "_first", "_near", "word_set")
    )


def relationship_scoring(df: DataFrame) -> DataFrame:
    strongest = F.greatest(F.max("neighborhood_strength").over(per_query()), F.lit(0.01))
    ratio = F.col("_ratio")
    return (
        df.withColumn("max_neighborhood", strongest)
        .withColumn("_ratio", F.col("neighborhood_strength") / F.col("max_neighborhood"))
        .withColumn("relationship_boost", F.sqrt(ratio) * 0.04)
        .withColumn("continuity_boost", F.least(F.log1p("relationship_count") * 0.012, F.lit(0.03)))
        .withColumn("gap_penalty", F.when((ratio < 0.18) & (F.col("boosted") < 0.46), 0.025).otherwise(0.0))
        .withColumn("file_penalty", F.least((F.col("file_count") - 1) * 0.012, F.lit(0.05)))
        .withColumn(
            "final_score",
            F.col("boosted")
            + F.col("relationship_boost")
            + F.col("continuity_boost")
            - F.col("gap_penalty")
            - F.col("file_penalty"),
        )
        .drop("_ratio")
    )


def pressure(n: Column, files: Column, mean_similarity: Column) -> Column:
    return n * 0.45 + files * 0.35 + mean_similarity * 10


def retrieval_pressure(df: DataFrame) -> DataFrame:
    """One row per query: pressure and whether it is high. Partial aggregates, any number of rows per query."""
    return df.groupBy("query_id").agg(
        pressure(
            F.count(F.lit(1)), F.countDistinct("filename"), F.avg(F.coalesce("similarity", F.lit(0.0)))
        ).alias("pressure")
    ).withColumn("high_pressure", F.round("pressure", DIGITS) >= 12)


def attach_pressure(df: DataFrame) -> DataFrame:
    """The same numbers on every candidate row, without leaving the query's partition."""
    value = pressure(
        F.count(F.lit(1)).over(per_query()),
        F.size(F.collect_set("filename").over(per_query())),
        F.avg(F.coalesce("similarity", F.lit(0.0))).over(per_query()),
    )
    return df.withColumn("pressure", value).withColumn("high_pressure", F.round("pressure", DIGITS) >= 12)


def adaptive_limits(df: DataFrame) -> DataFrame:
    wide = F.least(F.col("budget") + 2000, F.lit(BUDGET_CEILING))
    return df.withColumn("budget", F.when(F.col("high_pressure"), wide).otherwise(F.col("budget"))).withColumn(
        "top_k", F.when(F.col("high_pressure"), F.col("top_k") + 4).otherwise(F.col("top_k"))
    )


def file_cap(df: DataFrame, cap: int = MAX_PER_FILE) -> DataFrame:
    """At most cap rows per query and file in score order; file_row counts from 0."""
    order = W.partitionBy("query_id", "filename").orderBy(F.round("final_score", DIGITS).desc(), "pos")
    return (
        df.withColumn("file_row", F.row_number().over(order))
        .where(F.col("file_row") <= cap)
        .withColumn("file_row", F.col("file_row") - 1)
    )


def file_scores(df: DataFrame) -> DataFrame:
    """Sum of the scores of a file's rows, and the file's place in the order of these sums."""
    ranked = renumber(df, F.round("final_score", DIGITS).desc(), F.col("pos"), out="score_pos")
    of_file = W.partitionBy("query_id", "filename")
    summed = ranked.withColumn("file_score", F.round(F.sum("final_score").over(of_file), DIGITS)).withColumn(
        "_file_first", F.min("score_pos").over(of_file)
    )
    place = F.dense_rank().over(per_query().orderBy(F.desc("file_score"), "_file_first"))
    return summed.withColumn("file_rank", place).drop("_file_first")


def budget_pack(df: DataFrame) -> DataFrame:
    """Choose rows within the character budget; pack_pos is the place among the chosen.

    The best row of each file comes first, then the second of each, and so on while a round adds something. A row that
    repeats a chosen fingerprint or does not fit is skipped, later rows may still fit. The skip rule makes this a fold;
    it runs over the short list of the query's rows.
    """
    same = W.partitionBy("query_id", "fingerprint")
    entry = F.struct(
        F.col("file_row").cast("int").alias("round"),
        F.col("file_rank").cast("int").alias("file_rank"),
        F.col("score_pos").cast("int").alias("row"),
        F.length("content").cast("long").alias("chars"),
        F.col("_same").cast("int").alias("same"),
    )
    listed = df.withColumn("_same", F.min("score_pos").over(same)).withColumn(
        "_queue", F.array_sort(F.collect_list(entry).over(per_query()))
    )
    nothing = F.array().cast("array<int>")
    start = F.struct(
        nothing.alias("rows"),
        nothing.alias("seen"),
        F.lit(0).cast("long").alias("chars"),
        F.lit(-1).alias("round"),
    )

    def step(held, x):
        fits = (
            ~F.array_contains(held["seen"], x["same"])
            & (held["chars"] + x["chars"] <= F.col("budget"))
            & (x["round"] <= ROUNDS)
            & ((x["round"] <= 1) | (held["round"] >= x["round"] - 1))
        )
        grown = F.struct(
            F.array_append(held["rows"], x["row"]).alias("rows"),
            F.array_append(held["seen"], x["same"]).alias("seen"),
            (held["chars"] + x["chars"]).alias("chars"),
            x["round"].alias("round"),
        )
        return F.when(fits, grown).otherwise(held)

    chosen = F.aggregate("_queue", start, step, lambda held: held["rows"])
    return (
        listed.withColumn("_chosen", chosen)
        .withColumn("pack_pos", F.array_position("_chosen", F.col("score_pos").cast("int")).cast("int") - 1)
        .where(F.col("pack_pos") >= 0)
        .drop("_same", "_queue", "_chosen")
    )


def final_topk(df: DataFrame) -> DataFrame:
    return df.where(F.col("pack_pos") < F.col("top_k"))


def weak_top_cutoff(df: DataFrame, k: int = 5, weakest: float = 0.05) -> DataFrame:
    """First k rows per query in score order; none when even the best is weak."""
    ranked = renumber(df, F.desc("similarity"), F.col("pos"), out="rank")
    kept = ranked.where(F.col("rank") < k).withColumn("_best", F.max("similarity").over(per_query()))
    return kept.where(F.col("_best") >= weakest).drop("_best")
