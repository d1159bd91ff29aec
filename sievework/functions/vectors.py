"""Vector expressions, the embedding hook, and the exact scan run inside Spark tasks."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCORE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns of one row; 0 where it is undefined."""
    lengths = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (lengths > 0)
    return F.coalesce(F.when(usable, dot(a, b) / F.when(lengths > 0, lengths)), F.lit(0.0))


def mock_embed(c: Column) -> Column:
    """Three numbers made of the text's length; stands in for a model in tests."""
    n = F.length(rx.text_or_empty(c))
    return F.array((n % 10) / F.lit(10.0), (n % 7) / F.lit(7.0), (n % 5) / F.lit(5.0))


def embed_with(model):
    """Turn model(list of texts) -> list of vectors into a column function; blank texts get an empty vector.

    The model is called once per Arrow batch, so batches spread over all executors.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        filled = texts.fillna("").str.strip(rx.WHITE_CHARACTERS) != ""
        vectors = iter(model(texts[filled].tolist()) if filled.any() else [])
        return pd.Series([next(vectors) if use else [] for use in filled], index=texts.index, dtype=object)

    return run


# --- exact top-k scan -----------------------------------------------------------------------------------------------


def _matrix(column, width):
    """Rows of an Arrow list column as float64, and which rows have the width; no Python object per vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    good = lengths == width
    values = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(int(good.sum()), width), good


def _unit(rows):
    lengths = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(lengths > 0, lengths, 1.0)[:, None]


class BestHits:
    """The k best (score, key) per query seen so far; ties go to the smaller key. bars holds the k-th best scores."""

    def __init__(self, limits):
        self.limits = limits
        self.scores = [np.empty(0)] * len(limits)
        self.keys = [None] * len(limits)  # of the keys' own type once there are some
        self.bars = np.full(len(limits), -np.inf)

    def offer(self, query, scores, keys):
        limit = self.limits[query]
        if self.keys[query] is not None:
            scores, keys = np.concatenate([self.scores[query], scores]), np.concatenate([self.keys[query], keys])
        if len(scores) > 4 * limit:
            # ties at the cut stay in, the sort below decides them
            bar = np.partition(scores, len(scores) - limit)[len(scores) - limit]
            scores, keys = scores[scores >= bar], keys[scores >= bar]
        order = np.lexsort((keys, -scores))[:limit]
        self.scores[query], self.keys[query] = scores[order], keys[order]
        if len(order) == limit:
            self.bars[query] = scores[order[-1]]


class QueryBlock:
    """Query vectors held by a task: ids, scopes, unit vectors, limits, floors, own keys.

    Whether scopes count is said for the whole call, never by a value: with scoped, a null scope matches nothing.
    """

    def __init__(self, ids, scopes, vectors, limits, floors, own_keys, scoped):
        self.ids, self.limits, self.scoped = ids, limits, scoped
        self.floors = np.array([-np.inf if f is None else f for f in floors], dtype=np.float64)
        self.has_own = np.array([k is not None for k in own_keys], dtype=bool)
        self.own_keys = own_keys
        self.width = vectors.shape[1] if len(vectors) else 0
        self.units = _unit(vectors) if len(vectors) else None
        self.by_scope = {}
        for position, scope in enumerate(scopes):
            self.by_scope.setdefault(scope if scoped else None, []).append(position)
        if scoped:
            self.by_scope.pop(None, None)

    def scan(self, batches, sums):
        """Read Arrow batches of (scope, key, vector); return the best hits and, if asked, sums over all scores."""
        best = BestHits(self.limits)
        totals = np.zeros((len(self.ids), 2)) if sums else None
        if self.ids:
            for batch in batches:
                # slices keep the float64 copies small however wide the vectors are
                for start in range(0, batch.num_rows, 2048):
                    self._scan_slice(batch.slice(start, 2048), best, totals)
        return best, totals

    def _scan_slice(self, batch, best, totals):
        rows, good = _matrix(batch.column("vector"), self.width)
        # a vector of another width has no angle to the query: score 0
        units = np.zeros((batch.num_rows, self.width))
        units[good] = _unit(rows)
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        if not self.scoped:
            self._scan_scope(None, keys, units, best, totals)
            return
        codes, scopes = pd.factorize(batch.column("scope").to_pandas())
        for code, scope in enumerate(scopes):
            if scope in self.by_scope:
                inside = codes == code
                self._scan_scope(scope, keys[inside], units[inside], best, totals)

    def _scan_scope(self, scope, keys, units, best, totals):
        positions = np.array(self.by_scope[scope])
        sorted_rows = np.argsort(keys, kind="stable")
        for start in range(0, len(positions), 256):
            block = positions[start : start + 256]
            table = np.round(units @ self.units[block].T, SCORE_DIGITS) + 0.0
            # a vector that is no vector of numbers is no hit and hides none beside it
            table[np.isnan(table)] = -np.inf
            for column in np.flatnonzero(self.has_own[block]):
                own = self.own_keys[block[column]]
                low, high = (np.searchsorted(keys, own, side, sorter=sorted_rows) for side in ("left", "right"))
                table[sorted_rows[low:high], column] = -np.inf
            if totals is not None:
                totals[block, 0] += np.isfinite(table).sum(axis=0)
                totals[block, 1] += np.exp(table).sum(axis=0)
            # once k good hits are held, few slices have anything to add
            for column in np.flatnonzero(table.max(axis=0) >= best.bars[block]):
                query, scores = block[column], table[:, column]
                kept = (scores >= best.bars[query]) & (scores > self.floors[query])
                if kept.any():
                    best.offer(query, scores[kept], keys[kept])

    def rows(self, best, part, totals, key_type, id_type):
        """Arrow batch of what one task found: hits, and with totals one row per query (key null) with its sums."""
        counts = [0 if k is None else len(k) for k in best.keys]
        positions = np.repeat(np.arange(len(self.ids)), counts)
        keys = [pa.array(k, key_type) for k in best.keys if k is not None and len(k)]
        scores = np.concatenate([best.scores[i] for i, n in enumerate(counts) if n] or [np.empty(0)])
        extra = len(self.ids) if totals is not None else 0
        ids = pa.array(self.ids, id_type)
        places = np.concatenate([positions, np.arange(extra)])
        sums = totals if extra else np.empty((0, 2))
        none = np.arange(len(places)) >= len(positions)
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(places)),
                pa.concat_arrays([*keys, pa.nulls(extra, key_type)]),
                pa.array(np.concatenate([scores, np.zeros(extra)]), pa.float64(), mask=none),
                pa.array(np.asarray(self.limits, dtype=np.int64)[places], pa.int32()),
                pa.array(np.full(len(places), part % 256), pa.int32()),
                pa.array(np.concatenate([np.zeros(len(positions)), sums[:, 0]]).astype(np.int64), pa.int64(), mask=~none),
                pa.array(np.concatenate([np.zeros(len(positions)), sums[:, 1]]), pa.float64(), mask=~none),
            ],
            names=["query_id", "key", "similarity", "top", "part", "scored", "exp_sum"],
        )


def block_from_table(table, scoped):
    """Query block from an Arrow table with query_id, scope, vector, top, floor, own_key; vectors stay in NumPy."""
    columns = {name: table.column(name).to_pylist() for name in table.column_names if name != "vector"}
    lists = table.column("vector").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    widths = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = int(widths[0]) if len(widths) else 0
    if (widths != width).any():
        raise ValueError("query vectors differ in width")
    vectors = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if width else np.empty((0, 0))
    return QueryBlock(
        columns["query_id"],
        columns["scope"],
        vectors,
        columns["top"],
        columns["floor"],
        columns["own_key"],
        scoped,
    )
