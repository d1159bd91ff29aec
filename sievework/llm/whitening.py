"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers, floor(256 * entry). The model is fitted on every different whole vector once. Spark adds up
the sums per coordinate and, in a second pass, the scatter of the centred vectors; what reaches the driver is a matrix of
the vectors' width per width, whatever the number of rows. There it is factored, V = L L', and the columns of L are
rotated against each other until they are orthogonal: their squared norms are V's eigenvalues, the normalised columns its
eigenvectors. No product with L is formed, so small eigenvalues keep their relative precision.

Vectors of different widths are separate tables of vectors, each with its own model. The models are made in blocks of
bounded size. Left out: null vectors and those with null, NaN or infinite entries. A width whose vectors are all equal
has no component, an empty vector neither: no rows. Components end where the scatter's rank does, equal eigenvalues come
in some order. Entries beyond a long count as the nearest one; a deviation beyond a long is null. Repeated rows and null
keys come out as they came in, an empty table gives an empty one, further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, named, rows, shape, steady, written

COMPONENTS = 4
SCALE = 256.0
BLOCK_NUMBERS = 1 << 24
SWEEPS = 60


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): matrix[order][:, order] = factor @ factor.T; the factor has as many columns as the rank."""
    d = len(matrix)
    order, factor = np.arange(d), np.zeros((d, d))
    left = np.diag(matrix).astype(float)
    stop = d * np.finfo(float).eps * left.max(initial=0.0)
    for k in range(d):
        best = k + int(np.argmax(left[k:]))
        if not left[best] > stop:
            return factor[:, :k], order
        for rowwise in (order, left, factor):
            rowwise[[k, best]] = rowwise[[best, k]]
        factor[k, k] = np.sqrt(left[k])
        column = matrix[order[k + 1 :], order[k]] - factor[k + 1 :, :k] @ factor[k, :k]
        factor[k + 1 :, k] = column / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def rounds(columns: int):
    """Pairs of columns, each pair once, dealt into rounds in which no column occurs twice (a round-robin tournament)."""
    seats = np.arange(columns + columns % 2)
    for _ in range(len(seats) - 1):
        first, second = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
        real = (first < columns) & (second < columns)
        yield np.minimum(first, second)[real], np.maximum(first, second)[real]
        seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])


def rotated(factor: np.ndarray) -> np.ndarray:
    """The factor times the rotations that make its columns orthogonal."""
    now = np.array(factor, order="F")
    small = np.finfo(float).eps * np.sqrt(len(now))
    for _ in range(SWEEPS):
        moved = False
        for p, q in rounds(now.shape[1]):
            left, right = now[:, p], now[:, q]
            a, b, c = (np.einsum("ij,ij->j", x, y) for x, y in ((left, left), (right, right), (left, right)))
            turn = np.abs(c) > small * np.sqrt(a * b)
            if not turn.any():
                continue
            moved = True
            p, q, left, right, a, b, c = p[turn], q[turn], left[:, turn], right[:, turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cosine = 1 / np.hypot(1.0, tangent)
            sine = cosine * tangent
            now[:, p], now[:, q] = cosine * left - sine * right, sine * left + cosine * right
        if not moved:
            break
    return now


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of a positive semidefinite matrix up to its rank. The entry of a vector
    that is largest by amount is positive."""
    factor, order = pivoted_cholesky(matrix)
    turned = rotated(factor)
    norms = np.linalg.norm(turned, axis=0)
    place = np.argsort(-norms, kind="stable")
    place = place[norms[place] > 0]
    vectors = np.empty((len(matrix), len(place)))
    vectors[order] = turned[:, place] / norms[place]
    if len(place):
        vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(place))])
    return norms[place] ** 2, vectors


def by_width(batch):
    """(width, places, whole numbers as a matrix) for each width in an Arrow batch with the lists in column x."""
    lists = batch.column("x")
    widths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    ends = np.cumsum(widths)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        yield width, at, flat[(ends[at] - width)[:, None] + np.arange(width)]


def centred(x: np.ndarray, model: dict) -> np.ndarray:
    """x minus the mean; the whole part of the mean is taken off exactly."""
    base, rest = model["base"], model["rest"]
    if len(x) and max(abs(int(x.min())), abs(int(x.max()))) >= 1 << 62:
        return (x.astype(np.longdouble) - base.astype(np.longdouble)).astype(float) - rest / model["n"]
    return (x - base).astype(float) - rest / model["n"]


def deviations(x: np.ndarray, model: dict) -> pa.Array:
    """The sum over coordinates of (n * x - S)^2, exact, null where it is beyond a long."""
    n, out = model["n"], []
    guess = (n * n * (centred(x, model) ** 2).sum(axis=1)).tolist()
    safe = np.array([g < 4e18 for g in guess], dtype=bool)
    # below 2^62 in all each n * x - S is below 2^31, so whole numbers of 64 bits hold every step
    steps = n * (x[safe] - model["base"]) - model["rest"].astype(np.int64)
    quick = iter((steps * steps).sum(axis=1).tolist())
    for row, ok, about in zip(x, safe, guess):
        if ok:
            out.append(next(quick))
            continue
        # twice the largest long is far beyond any rounding of the guess
        total = None if about > 2e19 else sum((n * a - s) ** 2 for a, s in zip(row.tolist(), model["sums"]))
        out.append(total if total is not None and total < 1 << 63 else None)
    return pa.array(out, type=pa.int64())


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (key, x array<long>) of the vectors that count."""
    entries = shape(df, key, vector).select(named(key), named(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    whole = F.transform("v", lambda c: F.floor(c * F.lit(SCALE)).cast("long"))
    return entries.where(F.col("v").isNotNull() & finite).select(named(key), whole.alias("x"))


def added(fit: DataFrame, numbers) -> dict[tuple[int, int], int | float]:
    """Sums over all vectors of what numbers(width, matrix) gives per batch, as {(width, place): sum}."""

    @steady
    def run(batches):
        for batch in batches:
            for width, _, x in by_width(batch):
                for kind_of, values in numbers(width, x):
                    n = len(values)
                    yield rows(
                        width=np.full(n, width), part=np.full(n, kind_of, dtype=np.int32), place=np.arange(n), value=values,
                    )

    got = fit.mapInArrow(run, "width long, part int, place long, value double").groupBy("width", "part", "place")
    return {(r["width"], r["part"], r["place"]): r["s"] for r in got.agg(F.sum("value").alias("s")).collect()}


def sums(fit: DataFrame) -> dict[int, list[int]]:
    """Exact sums per coordinate and width."""

    @steady
    def run(batches):
        for batch in batches:
            for width, _, x in by_width(batch):
                low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
                yield rows(width=np.full(width, width), place=np.arange(width), low=low, high=high)

    parts = fit.mapInArrow(run, "width long, place long, low long, high long").groupBy("width", "place")
    whole = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("low", "high")]
    out: dict[int, list[int]] = {}
    for r in parts.agg(*whole).orderBy("width", "place").collect():
        out.setdefault(r["width"], []).append(int(r["low"]) + (int(r["high"]) << 32))
    return out


def matrices(found: dict, models: dict, side) -> dict[int, np.ndarray]:
    """The symmetric matrices whose upper triangles were added up, over n."""
    out = {}
    for width, model in models.items():
        size = side(model)
        matrix, (i, j) = np.zeros((size, size)), np.triu_indices(size)
        matrix[i, j] = [found.get((width, 0, p), 0.0) for p in range(len(i))]
        out[width] = (matrix + np.triu(matrix, 1).T) / model["n"]
    return out


def upper(values: np.ndarray) -> np.ndarray:
    product = values.T @ values
    return product[np.triu_indices(len(product))]


def fit_models(fit: DataFrame, counts: dict[int, int], components: int) -> dict[int, dict]:
    """Per width: n, sums, mean, components over square roots, shares of the trace and the identity error."""
    models = {}
    for width, total in sums(fit).items():
        n = counts[width]
        base = np.array([s // n for s in total], dtype=np.int64)
        rest = np.array([s % n for s in total], dtype=float)
        models[width] = {"n": n, "sums": total, "base": base, "rest": rest}
    scatter = matrices(added(fit, lambda w, x: [(0, upper(centred(x, models[w])))]), models, lambda m: len(m["sums"]))
    for width, model in models.items():
        values, vectors = eigen(scatter[width])
        values, vectors = values[:components], vectors[:, :components]
        model["turn"], model["share"] = vectors / np.sqrt(values), values / np.trace(scatter[width]) if len(values) else values
    held = added(fit, lambda w, x: [(0, upper(centred(x, models[w]) @ models[w]["turn"]))])
    for width, matrix in matrices(held, models, lambda m: m["turn"].shape[1]).items():
        models[width]["error"] = float(np.abs(matrix - np.eye(len(matrix))).max(initial=0.0))
    return models


def blocks(widths: list[int]):
    """Widths in blocks whose matrices hold BLOCK_NUMBERS numbers at most; a wider one is a block by itself."""
    block, held = [], 0
    for width in sorted(widths):
        if block and held + width * width > BLOCK_NUMBERS:
            yield block
            block, held = [], 0
        block.append(width)
        held += width * width
    if block:
        yield block


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (key, component int, n long, deviation long, whitened double, explained double, identity_error double).

    n counts the different whole vectors of the row's width; whitened is the centred vector on the component over the
    square root of its eigenvalue; explained is the eigenvalue over the trace; identity_error is the largest amount by
    which the covariance of the whitened vectors differs from the identity.
    """
    given = whole_vectors(df, key, vector)
    fit = written(given.select("x").distinct(), "whole-vectors")
    # different widths are few: k of them take k(k + 1)/2 entries at least
    counts = {r["w"]: r["n"] for r in fit.groupBy(F.size("x").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts.pop(0, None)
    schema = (
        f"`{key}` {kind(df, key)}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    parts = []
    for block in blocks(list(counts)):
        models = fit_models(fit.where(F.size("x").isin(block)), counts, components)
        parts.append(given.where(F.size("x").isin(block)).mapInArrow(projection(models, key), schema))
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def projection(models: dict[int, dict], key: str):
    @steady
    def run(batches):
        for batch in batches:
            for width, at, x in by_width(batch):
                model = models[width]
                k = model["turn"].shape[1]
                if not k:
                    continue
                times = pa.array(np.repeat(np.arange(len(at)), k))
                values = centred(x, model) @ model["turn"]
                yield rows(**{
                    key: batch.column(key).take(pa.array(at)).take(times),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)),
                    "n": np.full(len(times), model["n"]),
                    "deviation": deviations(x, model).take(times),
                    "whitened": values.ravel(),
                    "explained": np.tile(model["share"], len(at)),
                    "identity_error": np.full(len(times), model["error"]),
                })

    return run
