"""Clustered vectors: exact search that skips blocks which cannot hold a better hit.

Every vector goes to the nearest of a bounded number of centres; a scope's vectors of one centre are cut into blocks of
bounded size. A block keeps the least and the greatest angle between its vectors and the centre. For a query at angle t to
the centre no vector of the block is nearer than max(t - greatest, least - t, 0): the triangle inequality on the sphere.

A search makes two passes. First each query meets the blocks of the best bounds that hold enough vectors; its k-th best
score there is a bar. Then it meets the other blocks whose bound reaches the bar; all others are skipped, and the result is
the one a full scan gives. Queries travel to blocks: a vector is shuffled once, or once per QUERY_PART queries that need it.

The centres are fitted on at most SAMPLE vectors; a poor sample costs speed, never rows. Vectors without an angle (zero,
or of another width than most) have score 0 and blocks of their own.
"""

from __future__ import annotations

import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import new_workspace

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 8192
CENTRES = 1024
BLOCK = 16384
QUERY_PART = 1 << 18
STATS_ROWS = 1 << 20
SLACK = 1e-6
NO_ANGLE = -1
FULL = 2.0


@dataclass
class Index:
    """Table of (scope, key, vector, cluster, chunk), table of blocks, and the centres."""

    table: DataFrame
    blocks: DataFrame
    centres: np.ndarray


def fit_centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means, first ones drawn far from each other."""
    units = vectors._unit(sample[np.linalg.norm(sample, axis=1) > 0])
    if not len(units):
        return units
    pick = np.random.default_rng(17)
    chosen = [int(pick.integers(len(units)))]
    nearest = units @ units[chosen[0]]
    while len(chosen) < min(count, len(units)):
        weight = np.maximum(1.0 - nearest, 0.0)
        if weight.sum() < 1e-12:
            break
        chosen.append(int(pick.choice(len(units), p=weight / weight.sum())))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    centres = units[chosen]
    for _ in range(rounds):
        home = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, units)
        held = np.linalg.norm(sums, axis=1) > 1e-12
        centres[held] = vectors._unit(sums[held])
    return centres


def angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def _sample(corpus: DataFrame, size: int) -> np.ndarray:
    """Vectors of most rows' width, drawn by the hash of their key; at most `size` of them reach the driver."""
    total = corpus.count()
    share = max(1, total // size)
    drawn = corpus.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).limit(size).select("vector").toArrow().column("vector")
    widths = [len(v) for v in drawn.to_pylist() if v]
    width = max(set(widths), key=widths.count) if widths else 0
    rows, _ = vectors._matrix(drawn, width)
    return rows[np.isfinite(rows).all(axis=1)] if width else np.empty((0, 0))


def assigned(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows (scope, key, vector, cluster int, angle double) of all vectors."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)
    types = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}

    def run(batches):
        held = shared.value
        for batch in batches:
            rows, good = vectors._matrix(batch.column("vector"), held.shape[1]) if len(held) else (np.empty((0, 0)), None)
            home, angle = np.full(batch.num_rows, NO_ANGLE, dtype=np.int32), np.zeros(batch.num_rows)
            if len(rows):
                turned = angles(vectors._unit(rows), held)
                nearest = turned.argmin(axis=1)
                usable = np.isfinite(rows).all(axis=1) & ((rows * rows).sum(axis=1) > 0)
                places = np.flatnonzero(good)[usable]
                home[places], angle[places] = nearest[usable], turned[np.arange(len(rows)), nearest][usable]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(angle)], names=[*batch.schema.names, "cluster", "angle"])

    return corpus.mapInArrow(run, f"scope string, key {types['key']}, vector array<float>, cluster int, angle double")


def build_index(corpus: DataFrame, path: str | None = None, block: int | None = None, centres: int | None = None) -> Index:
    """Index of rows (scope, key, vector): vectors and blocks are written to `path` (or a new shared folder)."""
    spark, block = corpus.sparkSession, block or BLOCK
    path = path or new_workspace(spark, "vector-index")
    count = min(centres or CENTRES, max(1, 4 * corpus.count() // block))
    fitted = fit_centres(_sample(corpus, SAMPLE), count)
    homes = assigned(corpus, fitted)
    sizes = homes.groupBy(F.col("scope").alias("s"), F.col("cluster").alias("c")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    chunked = homes.join(sizes, F.col("scope").eqNullSafe(F.col("s")) & (F.col("cluster") == F.col("c")))
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    chunked.select("scope", "key", "vector", "cluster", chunk.alias("chunk"), "angle").write.parquet(path + "/vectors")
    table = spark.read.parquet(path + "/vectors")
    held = table.groupBy("scope", "cluster", "chunk").agg(
        F.min("angle").alias("least"), F.max("angle").alias("greatest"), F.count(F.lit(1)).alias("n")
    )
    held.write.parquet(path + "/blocks")
    pdf = [(i, c.tolist()) for i, c in enumerate(fitted)]
    spark.createDataFrame(pdf, "cluster int, centre array<double>").coalesce(1).write.parquet(path + "/centres")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index written before."""
    rows = spark.read.parquet(path + "/centres").orderBy("cluster").collect()
    centres = np.array([r["centre"] for r in rows]) if rows else np.empty((0, 0))
    return Index(spark.read.parquet(path + "/vectors").drop("angle"), spark.read.parquet(path + "/blocks"), centres)


class BlockTable:
    """Blocks by scope as arrays, held by the tasks that plan."""

    def __init__(self, table: pa.Table, centres: np.ndarray, scoped: bool):
        self.centres = centres
        columns = {n: table.column(n).to_pylist() for n in table.column_names}
        scopes, self.blocks = columns["scope"], list(zip(columns["scope"], columns["cluster"], columns["chunk"]))
        self.cluster = np.array(columns["cluster"], dtype=np.int64)
        self.least, self.greatest = np.array(columns["least"], dtype=float), np.array(columns["greatest"], dtype=float)
        self.n = np.array(columns["n"], dtype=np.int64)
        self.by_scope: dict = {}
        for at, scope in enumerate(scopes):
            self.by_scope.setdefault(scope if scoped else None, []).append(at)
        self.by_scope = {s: np.array(p) for s, p in self.by_scope.items()}

    def bounds(self, unit: np.ndarray | None, places: np.ndarray) -> np.ndarray:
        """The greatest cosine a vector of each block can have with the query; a query without an angle scores 0."""
        none = self.cluster[places] == NO_ANGLE
        if unit is None or len(unit) != (self.centres.shape[1] if len(self.centres) else -1):
            # another width than the centres': nothing is known of the blocks without an angle, all others score 0
            return np.where(none, FULL, 0.0) if unit is not None else np.zeros(len(places))
        turn = angles(unit[None, :], self.centres)[0][np.where(none, 0, self.cluster[places])]
        nearest = np.maximum(np.maximum(turn - self.greatest[places], self.least[places] - turn), 0.0)
        return np.where(none, 0.0, np.cos(nearest))

    def plan(self, scope, vector, top: int, floor: float, bar: float | None) -> np.ndarray:
        """Places of the blocks a query meets: without a bar the first pass, with one the second."""
        places = self.by_scope.get(scope, np.empty(0, dtype=np.int64))
        if not len(places):
            return places
        row = np.array(vector, dtype=np.float64)
        length = np.sqrt(row @ row)
        bounds = self.bounds(row / length if length > 0 else None, places)
        order = np.lexsort((places, -bounds))
        # one more than asked for, should the query's own row be among them
        enough = int(np.searchsorted(np.cumsum(self.n[places[order]]), top + 1)) + 1
        if bar is None:
            chosen = order[:enough]
            return places[chosen[bounds[chosen] > floor - SLACK]]
        chosen = order[enough:]
        return places[chosen[bounds[chosen] >= max(bar, floor) - SLACK]]


def planned(queries: DataFrame, stats: pa.Table, centres: np.ndarray, scoped: bool, parts: int) -> DataFrame:
    """Rows (scope, cluster, chunk, part, kind 1, key, vector, query_id, top, floor): queries with the blocks they meet.

    queries: query_id, scope, vector, top, floor, own_key and bar (null in the first pass).
    """
    shared = queries.sparkSession.sparkContext.broadcast((stats, centres))
    types = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    second = "bar" in queries.columns

    def run(batches):
        table = BlockTable(*shared.value, scoped)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("scope", "vector", "top", "floor")]
            bars = batch.column("bar").to_pylist() if second else [None] * batch.num_rows
            rows, met = [], []
            for at, (scope, vector, top, floor, bar) in enumerate(zip(*columns, bars)):
                low = -np.inf if floor is None else floor
                found = table.plan(scope if scoped else None, vector, top, low, (-np.inf if bar is None else bar) if second else None)
                rows += [at] * len(found)
                met += [table.blocks[f] for f in found.tolist()]
            take = pa.array(rows, type=pa.int64())
            blocks = list(zip(*met)) if met else ([], [], [])
            floors = batch.column("floor").take(take)
            if second and len(take):
                # hits below the bar can't get in; the bar itself can, by its key
                held = [max(-np.inf if f is None else f, -np.inf if bars[r] is None else bars[r] - 2e-9) for f, r in zip(floors.to_pylist(), rows)]
                floors = pa.array([None if h == -np.inf else h for h in held], type=pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(blocks[0]), type=pa.string()), pa.array(list(blocks[1]), type=pa.int32()),
                    pa.array(list(blocks[2]), type=pa.int32()), pa.array(np.full(len(rows), 1, dtype=np.int32)),
                    batch.column("own_key").take(take), batch.column("vector").take(take), batch.column("query_id").take(take),
                    batch.column("top").take(take), floors,
                ],
                names=["scope", "cluster", "chunk", "kind", "key", "vector", "query_id", "top", "floor"],
            )

    schema = f"scope string, cluster int, chunk int, kind int, key {types['own_key']}, vector array<float>, query_id {types['query_id']}, top int, floor double"
    out = queries.mapInArrow(run, schema)
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
    return out.withColumn("part", part)


def meet(index: Index, plan: DataFrame, schema: str) -> DataFrame:
    """Hits of the planned queries: a block's vectors are held, its queries stream past."""
    block = ["scope", "cluster", "chunk"]
    wanted = plan.select(*block, "part").distinct()
    same = [index.table[c].eqNullSafe(wanted[c]) if c == "scope" else index.table[c] == wanted[c] for c in block]
    sides = index.table.join(wanted, same[0] & same[1] & same[2]).select(
        *[index.table[c] for c in block], "part", F.lit(0).alias("kind"), "key", "vector",
        F.lit(None).cast(plan.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast("int").alias("top"),
        F.lit(None).cast("double").alias("floor"),
    )
    order = [*block, "part", "kind"]
    stream = sides.unionByName(plan.select(*sides.columns)).repartition(*block, "part").sortWithinPartitions(*order)
    build = vectors.block_from_table

    def run(batches):
        held, at = [], None
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in order]
            runs = list(zip(*names))
            start = 0
            for end in range(1, len(runs) + 1):
                if end < len(runs) and runs[end] == runs[start]:
                    continue
                piece, run_of = batch.slice(start, end - start), runs[start]
                start = end
                if run_of[:-1] != at:
                    held, at = [], run_of[:-1]
                if run_of[-1] == 0:
                    held.append(piece.select(["scope", "key", "vector"]))
                    continue
                table = pa.Table.from_batches([piece]).rename_columns(["own_key" if c == "key" else c for c in piece.schema.names])
                block_of = build(table.select(["query_id", "scope", "vector", "top", "floor", "own_key"]), False)
                best, totals = block_of.scan(held, False)
                key_type, id_type = piece.schema.field("key").type, piece.schema.field("query_id").type
                yield block_of.rows(best, zlib.crc32(repr(run_of[:-1]).encode()) % 256, totals, key_type, id_type)

    return stream.mapInArrow(run, schema)
