"""Exact similarity search of a query table in a vector table.

A pair join would emit queries x vectors rows. Here each task multiplies its Arrow batches of vectors with the query
block and keeps the k best per query, so only k rows per query and task are shuffled. Two ways bring queries to vectors:

* up to ``MAX_BROADCAST_QUERIES`` queries of ``MAX_BROADCAST_BYTES`` in all (checked by a limited read) they are broadcast
  and the vectors stay in place; scopes that no query names are not read;
* beyond, or when a stored index is given, queries go only to the blocks of clustered vectors that can hold a better hit
  (see ``vector_index``). Where every score is needed, for sums, both sides of each namespace are cut into blocks of bounded
  size by hash, and every query block meets every vector block of its namespace once.

All give the same rows. Scores are rounded to 9 digits before ranking, so ties do not depend on how data are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import cut_lineage
from ..sources import tables
from . import vector_index

MAX_BROADCAST_QUERIES = 16384
MAX_BROADCAST_BYTES = 64 << 20
QUERY_BLOCK = 4096
VECTOR_BLOCK = 16384
LISTED_SCOPES = 1000


def _shape_vectors(df: DataFrame, key: str, vector: str, scope: str | None) -> DataFrame:
    shaped = df.select(
        (F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("scope"),
        F.col(key).alias("key"),
        F.col(vector).cast("array<float>").alias("vector"),
    ).where(F.col("key").isNotNull())
    # a null scope agrees with nothing
    return shaped.where(F.col("scope").isNotNull()) if scope else shaped


def _shape_queries(df: DataFrame, vector: str, scope: str | None, top: Column, floor, own_key, key_type: str) -> DataFrame:
    floor = floor if isinstance(floor, Column) else F.lit(floor)
    shaped = df.select(
        F.col("query_id"),
        (F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("scope"),
        F.col(vector).cast("array<float>").alias("vector"),
        top.cast("int").alias("top"),
        floor.cast("double").alias("floor"),
        (F.col(own_key) if own_key else F.lit(None)).cast(key_type).alias("own_key"),
    ).where(F.size("vector") > 0)
    return shaped.where(F.col("scope").isNotNull()) if scope else shaped


def _found_schema(queries: DataFrame) -> str:
    id_type, key_type = (queries.schema[c].dataType.simpleString() for c in ("query_id", "own_key"))
    return f"query_id {id_type}, key {key_type}, similarity double, top int, part int, scored long, exp_sum double"


def _broadcast_scan(queries_table, corpus: DataFrame, schema: str, scoped: bool, sums: bool) -> DataFrame:
    """Every task reads its vectors once and gives at most top hits per query, and its sums if asked."""
    if scoped:
        scopes = set(queries_table.column("scope").to_pylist())
        if len(scopes) <= LISTED_SCOPES:
            # reaches the scan: files and partitions of other scopes are not read
            corpus = corpus.where(F.col("scope").isin(*sorted(scopes))) if scopes else corpus.limit(0)
    shared = corpus.sparkSession.sparkContext.broadcast(queries_table)
    build, id_type = vectors.block_from_table, queries_table.schema.field("query_id").type

    def run(batches):
        from itertools import chain

        from pyspark import TaskContext

        first = next(batches, None)
        if first is None:
            return
        block = build(shared.value, scoped)
        best, totals = block.scan(chain([first], batches), sums)
        yield block.rows(best, TaskContext.get().partitionId(), totals, first.schema.field("key").type, id_type)

    return corpus.mapInArrow(run, schema)


def _block_scan(
    queries: DataFrame, corpus: DataFrame, schema: str, scoped: bool, sums: bool, query_block: int, vector_block: int
) -> DataFrame:
    space = F.col("scope") if scoped else F.lit("")

    def sizes(df, block, name):
        blocks = F.ceil(F.count(F.lit(1)) / block).cast("int")
        return df.groupBy(space.alias("space")).agg(blocks.alias(name))

    def block_of(column, blocks):
        return F.pmod(F.xxhash64(column), F.col(blocks)).cast("int")

    def every_block(blocks):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    blocks = sizes(queries, query_block, "q_blocks").join(sizes(corpus, vector_block, "v_blocks"), "space")
    spread_queries = (
        queries.withColumn("space", space)
        .join(blocks, "space")
        .withColumn("qb", block_of("query_id", "q_blocks"))
        .withColumn("vb", every_block("v_blocks"))
        .drop("q_blocks", "v_blocks")
    )
    spread_vectors = (
        corpus.withColumn("space", space)
        .join(blocks, "space")
        .withColumn("vb", block_of("key", "v_blocks"))
        .withColumn("qb", every_block("q_blocks"))
        .drop("q_blocks", "v_blocks")
    )
    build = vectors.block_from_table

    def meet(key, left, right):
        block = build(left, scoped)
        best, totals = block.scan(right.to_batches(), sums)
        import pyarrow as pa

        types = right.schema.field("key").type, left.schema.field("query_id").type
        return pa.Table.from_batches([block.rows(best, key[2].as_py(), totals, *types)])

    return (
        spread_queries.groupBy("space", "qb", "vb")
        .cogroup(spread_vectors.groupBy("space", "qb", "vb"))
        .applyInArrow(meet, schema)
    )


def _pruned_scan(queries: DataFrame, index: vector_index.Index, scoped: bool, largest: int) -> DataFrame | None:
    """Hits of two passes over an index, None if it has too many blocks to be held by a task."""
    stats = index.blocks.limit(vector_index.STATS_ROWS + 1).toArrow()
    if stats.num_rows > vector_index.STATS_ROWS:
        return None
    schema = _found_schema(queries)
    parts = max(1, -(-queries.count() // vector_index.QUERY_PART))

    def hits(asked: DataFrame) -> DataFrame:
        return vector_index.meet(index, vector_index.planned(asked, stats, index.centres, scoped, parts), schema)

    first = cut_lineage(hits(queries))
    best = keep_top(first.drop("scored", "exp_sum"), largest, F.col("top")).groupBy("query_id")
    bars = best.agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("worst"), F.max("top").alias("most"))
    bars = bars.select("query_id", F.when(F.col("n") >= F.col("most"), F.col("worst")).alias("bar"))
    return first.unionByName(hits(queries.join(bars, "query_id", "left")))


def _scan(
    queries: DataFrame, corpus: DataFrame, scoped: bool, sums: bool, limit: int | None = None, largest: int | None = None
) -> DataFrame:
    limit = MAX_BROADCAST_QUERIES if limit is None else limit
    schema = _found_schema(queries)
    table = queries.limit(limit + 1).toArrow()
    if table.num_rows <= limit and table.nbytes <= MAX_BROADCAST_BYTES:
        return _broadcast_scan(table, corpus, schema, scoped, sums)
    found = None if sums else _pruned_scan(queries, vector_index.build_index(corpus), scoped, largest)
    if found is not None:
        return found
    return _block_scan(queries, corpus, schema, scoped, sums, QUERY_BLOCK, VECTOR_BLOCK)


def keep_top(hits: DataFrame, largest: int, limit: Column) -> DataFrame:
    """The first rows per query by score, then key; the literal bound lets each task drop rows before the shuffle.

    Ranked first within (query, part), then within the query, so no task gets one query's hits of all tasks.
    """
    order = [F.desc("similarity"), F.col("key")]
    local = W.partitionBy("query_id", "part").orderBy(*order)
    ranked = hits.withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= largest)
    final = W.partitionBy("query_id").orderBy(*order)
    ranked = ranked.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= largest)
    return ranked.where(F.col("rank") <= limit)


def match_vectors(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    key: str,
    vector: str = "embedding",
    query_vector: str = "query_vector",
    scope: str | None = "namespace",
    top: int | Column = 5,
    largest: int | None = None,
    floor: float | Column | None = None,
    own_key: str | None = None,
    broadcast_limit: int | None = None,
) -> DataFrame:
    """Rows (query_id, key, similarity, pos): the best vectors per query with similarity above floor.

    top may be a column of the query table; largest is then the literal bound it never exceeds. scope is the column both
    sides must agree on, None for no such rule; a null scope on either side agrees with nothing. own_key names a query
    column holding a key to leave out. Keys and query ids keep their types; vectors without key are left out.
    """
    if isinstance(top, int):
        largest, top = top, F.lit(top)
    elif largest is None:
        raise ValueError("a column limit needs its largest value")
    vectors_ = _shape_vectors(corpus, key, vector, scope)
    shaped = _shape_queries(queries, query_vector, scope, top, floor, own_key, vectors_.schema["key"].dataType.simpleString())
    hits = _scan(shaped, vectors_, scope is not None, False, broadcast_limit, largest)
    return _ranked(hits, largest, key)


def store_index(corpus: DataFrame, path: str, *, key: str, vector: str = "embedding", scope: str | None = "namespace", **options):
    """Write an index of the vectors that `match_index` searches; open it again with `vector_index.open_index`."""
    return vector_index.build_index(_shape_vectors(corpus, key, vector, scope), path, **options)


def match_index(
    queries: DataFrame,
    index: vector_index.Index,
    *,
    key: str,
    query_vector: str = "query_vector",
    scope: str | None = "namespace",
    top: int = 5,
    floor: float | Column | None = None,
    own_key: str | None = None,
) -> DataFrame:
    """`match_vectors` over a stored index: the same rows, blocks that can't hold one of them are not read."""
    shaped = _shape_queries(queries, query_vector, scope, F.lit(top), floor, own_key, index.table.schema["key"].dataType.simpleString())
    hits = _pruned_scan(shaped, index, scope is not None, top)
    if hits is None:
        hits = _block_scan(shaped, index.table, _found_schema(shaped), scope is not None, False, QUERY_BLOCK, VECTOR_BLOCK)
    return _ranked(hits, top, key)


def _ranked(hits: DataFrame, largest: int, key: str) -> DataFrame:
    kept = keep_top(hits.drop("scored", "exp_sum"), largest, F.col("top"))
    return kept.select(
        "query_id", F.col("key").alias(key), "similarity", (F.col("rank") - 1).cast("int").alias("pos")
    )


def local_search(queries: DataFrame, corpus: DataFrame, *, key: str, k: int = 5, **options) -> DataFrame:
    """Best k of the whole store, no threshold, no namespace."""
    return match_vectors(queries, corpus, key=key, scope=None, top=k, floor=None, **options)


def local_search_confidence(
    queries: DataFrame, corpus: DataFrame, *, key: str, k: int = 5, weakest: float = 0.05, **options
) -> DataFrame:
    """Best k with softmax confidence over all scores; queries whose best score is weak have no rows."""
    vector, query_vector = options.get("vector", "embedding"), options.get("query_vector", "query_vector")
    vectors_ = _shape_vectors(corpus, key, vector, None)
    key_type = vectors_.schema["key"].dataType.simpleString()
    shaped = _shape_queries(queries, query_vector, None, F.lit(k), None, options.get("own_key"), key_type)
    # hits and sums come out of one scan, written once: k rows and one sum per query and task
    both = cut_lineage(_scan(shaped, vectors_, False, True, options.get("broadcast_limit")))
    found = _ranked(both.where(F.col("key").isNotNull()), k, key)
    # cosines lie in [-1, 1], so exp needs no shift by the maximum
    totals = both.where(F.col("key").isNull()).groupBy("query_id").agg(F.sum("exp_sum").alias("exp_sum"))
    per_query = W.partitionBy("query_id")
    return (
        found.join(totals, "query_id")
        .withColumn("confidence", F.exp("similarity") / F.col("exp_sum"))
        .withColumn("best", F.max("similarity").over(per_query))
        .where(F.col("best") >= weakest)
        .drop("best", "exp_sum")
    )


BAND = 16.0


def softmax(df: DataFrame, score: str, by: str, out: str = "confidence") -> DataFrame:
    """exp(s - max) / sum over each group, by one aggregation that is joined back once.

    Scores are summed as exp(s - BAND * band) per band of BAND, which can't overflow and merges in any order; a group's few
    bands are then brought to its highest. A group of any size is summed in parts, before the shuffle.
    """
    band = F.floor(F.col(score) / BAND)
    parts = df.groupBy(by, band.alias("_band")).agg(
        F.sum(F.exp(F.col(score) - band * BAND)).alias("_sum"), F.max(score).alias("_max")
    )
    listed = parts.groupBy(by).agg(F.max("_max").alias("_max"), F.collect_list(F.struct("_band", "_sum")).alias("_bands"))
    total = F.aggregate(
        "_bands", F.lit(0.0), lambda held, x: held + x["_sum"] * F.exp(x["_band"] * BAND - F.col("_max"))
    )
    sums = listed.select(by, "_max", total.alias("_total"))
    return df.join(sums, by).withColumn(out, F.exp(F.col(score) - F.col("_max")) / F.col("_total")).drop("_max", "_total")


def embed_distinct(df: DataFrame, text: str, embed, out: str = "embedding") -> DataFrame:
    """Embed each distinct text once and give the vector back to all its rows."""
    vectors_of = df.select(text).distinct().withColumn(out, embed(F.col(text)))
    return df.join(vectors_of, text, "left")


def embed_stored(df: DataFrame, text: str, embed, path: str, out: str = "embedding") -> DataFrame:
    """Embed each text once for all runs: vectors are kept in a table at `path` by the digest of their text.

    Only texts the table doesn't hold go through the model and are appended; then the wanted rows are read from it. The
    caller normalises texts that should share a vector. Blank texts have what the model hook gives them.
    """
    spark, digest = df.sparkSession, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    wanted = df.select(digest.alias("_digest"), F.col(text)).dropDuplicates(["_digest"])
    unknown = wanted
    if tables.exists(spark, path):
        unknown = wanted.join(spark.read.parquet(path).select("_digest"), "_digest", "left_anti")
    unknown.select("_digest", embed(F.col(text)).alias(out)).write.mode("append").parquet(path)
    held = spark.read.parquet(path).join(wanted.select("_digest"), "_digest", "left_semi").dropDuplicates(["_digest"])
    return df.withColumn("_digest", digest).join(held, "_digest", "left").drop("_digest")
