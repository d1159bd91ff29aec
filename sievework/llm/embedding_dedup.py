"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are turned into the order of their principal directions. For a pair, the product of the leading
coordinates plus the product of the norms of what follows bounds the cosine; a pair goes on to the remaining coordinates only if
the bound reaches the threshold. Whole blocks are bounded by one matrix product, the suffix norm being one more coordinate.

Equal vectors are grouped first and compared once, with their number. The distinct ones are dealt by hash into tiles of
bounded size, and each pair of tiles is one unit of work. A unit gives link counts and a spanning forest, never the pairs
themselves, so a large group of near copies costs rows in proportion to its members. Exact all-pairs comparison grows with the
square of the distinct vectors; the tiles only bound memory and spread it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind, named, rows, shape, steady, written
from .components import components
from .simhash import forest

THRESHOLD = 0.9
TILE_BYTES = 16 << 20
BLOCK = 512
MANY = 0.05
PAIRS = 1 << 16
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """A direction exists: no null or non-finite component, not all zero."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~broken & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column, all of one width, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(vectors: np.ndarray) -> np.ndarray:
    # the largest component is brought to 1 first, so squares neither overflow nor vanish
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per width the principal directions of the unit vectors, strongest first, from second moments over all rows."""

    @steady
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            widths = batch.column("width").to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                found = units(matrix(batch.column("v").filter(pa.array(widths == width))))
                sums[width] = sums.get(width, 0.0) + found.T @ found
        for width, total in sums.items():
            yield rows(width=np.full(total.size, width, dtype=np.int32), place=np.arange(total.size), value=total.ravel())

    moments = vectors.select("width", "v").mapInArrow(run, "width int, place long, value double")
    table = moments.groupBy("width", "place").agg(F.sum("value").alias("value")).toArrow()
    widths, place, value = (table.column(c).to_numpy() for c in ("width", "place", "value"))
    found = {}
    for width in np.unique(widths).tolist():
        own = widths == width
        moment = np.zeros(width * width)
        moment[place[own]] = value[own]
        _, basis = np.linalg.eigh(moment.reshape(width, width))
        found[width] = np.ascontiguousarray(basis[:, ::-1])
    return found


def close_pairs(left: np.ndarray, right: np.ndarray, threshold: float, same: bool):
    """Index arrays (i, j) of pairs with cosine >= threshold, block by block; with same, left is right and i < j."""
    width = left.shape[1]
    head = max(1, width // 4)
    low = threshold - SLACK

    def leading(x):
        return np.column_stack([x[:, :head], np.sqrt((x[:, head:] ** 2).sum(axis=1))])

    lead_left, lead_right = leading(left), leading(right)
    steps = [*range(head, width, max(1, width // 8)), width]
    for start in range(0, len(left), BLOCK):
        stop = min(start + BLOCK, len(left))
        first = start if same else 0
        bound = lead_left[start:stop] @ lead_right[first:].T
        near = bound >= low
        count = np.count_nonzero(near)
        if not count:
            continue
        if count > MANY * near.size:
            near = left[start:stop] @ right[first:].T >= low
        i, j = np.nonzero(near)
        i, j = i + start, j + first
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), PAIRS):
            a, b = i[part : part + PAIRS], j[part : part + PAIRS]
            total = np.einsum("ij,ij->i", left[a, :head], right[b, :head])
            for begin, end in zip(steps, steps[1:]):
                total = total + np.einsum("ij,ij->i", left[a, begin:end], right[b, begin:end])
                rest = np.sqrt((left[a, end:] ** 2).sum(axis=1) * (right[b, end:] ** 2).sum(axis=1))
                going = total + rest >= low
                a, b, total = a[going], b[going], total[going]
            if len(a):
                yield a, b, total


def unit_links(v_left, v_right, basis, threshold, same):
    """Links of two tiles: pairs near the threshold are decided on the vectors as given, not as turned."""
    left, right = units(v_left), units(v_right)
    turned_left = left @ basis
    turned_right = turned_left if same else right @ basis
    for a, b, total in close_pairs(turned_left, turned_right, threshold, same):
        unsure = np.abs(total - threshold) <= SLACK
        if unsure.any():
            total[unsure] = np.einsum("ij,ij->i", left[a[unsure]], right[b[unsure]])
        sure = total >= threshold
        yield a[sure], b[sure]


def tiles_for(count: int, width: int, cores: int) -> int:
    """Tiles of bounded bytes, and enough pairs of them to keep all cores at work."""
    least = -(-count * width * 8 // TILE_BYTES)
    busy = 1
    while busy * (busy + 1) // 2 < 3 * cores and count // busy > BLOCK:
        busy += 1
    return max(1, least, busy)


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tiles: int | None = None
) -> DataFrame:
    """Rows (key, n_links long, component_id): vectors with cosine >= threshold (above 0), and the smallest key reachable.

    A vector that is null, zero or has null or non-finite components links with nothing and is its own component, so is
    a row with a null key. Only vectors of equal width link. Equal vectors link with each other; repeated rows count as
    further vectors.
    """
    spark = df.sparkSession
    given = shape(df, key, vector).toDF("k", "v")
    good = given.where(usable(F.col("v")) & F.col("k").isNotNull())
    classes = good.groupBy("v").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("width", F.size("v").cast("int")), "classes")
    sizes = {r["width"]: r["count"] for r in classes.groupBy("width").count().collect()}
    cores = spark.sparkContext.defaultParallelism
    count = {w: tiles or tiles_for(c, w, cores) for w, c in sizes.items()}
    bases = spark.sparkContext.broadcast(directions(classes))

    parts = F.create_map(*[F.lit(x) for pair in count.items() for x in pair]) if count else F.create_map(F.lit(0), F.lit(1))
    dealt = classes.withColumn("tiles", parts[F.col("width")]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    partners = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, "tile").alias("a"), F.greatest(o, "tile").alias("b"))
    )
    work = dealt.withColumn("unit", F.explode(partners)).select("width", "unit.a", "unit.b", "tile", "rep", "n", "v")
    rep_type = kind(classes, "rep")

    def compare(keys, table):
        width, a, b = (k.as_py() for k in keys)
        table = table.combine_chunks()
        tile = table.column("tile").to_numpy()
        at_left, at_right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        vectors, numbers = matrix(table.column("v")), table.column("n").to_numpy()
        counts, links = np.zeros(len(tile), dtype=np.int64), [(np.empty(0, dtype=np.int64),) * 2]
        basis = bases.value[width]
        if len(at_left) and len(at_right):
            for i, j in unit_links(vectors[at_left], vectors[at_right], basis, threshold, a == b):
                i, j = at_left[i], at_right[j]
                counts += np.bincount(i, weights=numbers[j], minlength=len(tile)).astype(np.int64)
                counts += np.bincount(j, weights=numbers[i], minlength=len(tile)).astype(np.int64)
                links.append(forest(i, j))
        node, root = forest(*(np.concatenate(x) for x in zip(*links)))
        linked = np.flatnonzero(counts)
        reps = table.column("rep").combine_chunks() if isinstance(table.column("rep"), pa.ChunkedArray) else table.column("rep")
        ends = np.concatenate([linked, node]), np.concatenate([linked, root])
        return pa.table(
            {
                "rep": reps.take(pa.array(ends[0])),
                "more": pa.array(np.concatenate([counts[linked], np.zeros(len(node), dtype=np.int64)])),
                "root": reps.take(pa.array(ends[1])),
            }
        )

    found = work.groupBy("width", "a", "b").applyInArrow(compare, f"rep {rep_type}, more long, root {rep_type}")
    found = written(found, "links")
    linked = found.groupBy(F.col("rep").alias("r1")).agg(F.sum("more").alias("more"))
    rooted = components(found.select("rep", "root"), "rep", "root").toDF("r2", "root")
    classed = (
        classes.join(linked, F.col("rep") == F.col("r1"), "left")
        .join(rooted, F.col("rep") == F.col("r2"), "left")
        .select(F.col("v").alias("same"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("component"))
    )
    answer = good.join(classed, F.col("v") == F.col("same")).select("k", "links", "component")
    alone = given.where(~usable(F.col("v")) | F.col("k").isNull()).select("k", F.lit(0).cast("long"), "k")
    return answer.union(alone).toDF("k", "n_links", "component_id").select(F.col("k").alias(key), "n_links", "component_id")
