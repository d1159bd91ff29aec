"""Helpers shared by the operators: shaping inputs, cutting Arrow batches, shared folders, bounded reads."""

from __future__ import annotations

import functools
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, new_workspace

SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(name: str) -> Column:
    """A column by its exact name, dots and other signs included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shape(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Only the columns an operator reads, in this order; further columns of any name never meet the operator's own."""
    return df.select(*[named(c) for c in (key, *columns)])


def kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def slices(batches, column, limit: int = SLICE_BYTES):
    """Arrow batches cut so that a piece holds about `limit` bytes of the column; a longer value is a piece alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def steady(run):
    """Task function without passes of the cycle collector: its many small values form no cycles."""

    @functools.wraps(run)
    def wrapped(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return wrapped


def texts(batch, column) -> list[str]:
    """The strings of a column; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns)
    )


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["cut_lineage", "kind", "named", "read", "rows", "shape", "slices", "steady", "texts", "written"]
