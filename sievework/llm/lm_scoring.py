"""Cross-entropy difference scoring with matched n-gram models.

Target and background model share everything but their counts: the vocabulary (the 256 byte values of UTF-8 text, 0xFF, which
no text holds, marking both ends), the order (three), and the smoothing (each order interpolated with the next lower one by
the same weight). A token's loss difference is log P_background - log P_target; a text's score is its mean, lower means more
like the target.

Counts are taken over every text in the tasks and added up by Spark, so what is gathered grows with the input; the finished table
cannot exceed 256^3 entries, which bounds the broadcast. Scoring is one narrow pass: a look-up per byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, rows, shape, slices, steady, texts

EDGE = 0xFF
SMOOTH = 20.0


def trigrams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all byte triples, and their number per text: one per byte and one for the end, none for an empty text."""
    parts = [t.encode("utf-8", "replace") for t in found]
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join(edge * 2 + p + edge if p else b"" for p in parts), dtype=np.uint8).astype(np.int32)
    sizes = np.array([len(p) + 3 if p else 0 for p in parts], dtype=np.int64)
    if not len(data):
        return np.empty(0, dtype=np.int32), np.zeros(len(parts), dtype=np.int64)
    codes = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    # triples that reach from one text into the next are left out
    keep = np.ones(len(codes), dtype=bool)
    ends = np.cumsum(sizes)[sizes > 0][:-1]
    keep[ends - 1] = keep[ends - 2] = False
    return codes[keep], np.where(sizes > 0, sizes - 2, 0)


@dataclass
class Counts:
    codes: np.ndarray  # ascending
    target: np.ndarray
    background: np.ndarray


def count(df: DataFrame, text: str, in_target: str) -> Counts:
    """Counts of all triples in df (background) and in rows where in_target is true (target)."""

    @steady
    def run(batches):
        for batch in slices(batches, "t", 8 << 20):
            codes, sizes = trigrams(texts(batch, "t"))
            chosen = np.repeat(batch.column("chosen").to_numpy(zero_copy_only=False).astype(bool), sizes)
            both = np.bincount(codes, minlength=1)
            place = np.flatnonzero(both)
            own = np.bincount(codes[chosen], minlength=len(both))
            yield rows(code=place.astype(np.int32), background=both[place], target=own[place])

    given = df.select(F.col(text).alias("t"), F.coalesce(F.col(in_target), F.lit(False)).alias("chosen"))
    counted = given.mapInArrow(run, "code int, background long, target long")
    table = counted.groupBy("code").agg(F.sum("background").alias("background"), F.sum("target").alias("target")).toArrow()
    code = table.column("code").to_numpy()
    order = np.argsort(code)
    return Counts(code[order], table.column("target").to_numpy()[order], table.column("background").to_numpy()[order])


def log_probabilities(codes: np.ndarray, counts: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """log P(third byte | first two) for all 256^3 triples, each order interpolated with the lower one."""
    pairs = np.bincount(codes & 0xFFFF, weights=counts, minlength=1 << 16).reshape(256, 256)
    single = pairs.sum(axis=0)
    p1 = (single + 1) / (single.sum() + 256)
    p2 = (pairs + smooth * p1[None, :]) / (pairs.sum(axis=1, keepdims=True) + smooth)
    out = np.empty((256, 256, 256), dtype=np.float32)
    # codes are in order: one first byte at a time
    cuts = np.searchsorted(codes, np.arange(257) << 16)
    for first in range(256):
        part = slice(cuts[first], cuts[first + 1])
        own = np.zeros(1 << 16)
        own[codes[part] & 0xFFFF] = counts[part]
        own = own.reshape(256, 256)
        out[first] = np.log((own + smooth * p2) / (own.sum(axis=1, keepdims=True) + smooth))
    return out.reshape(-1)


def score(df: DataFrame, counts: Counts, key: str = "doc_id", text: str = "text", smooth: float = SMOOTH) -> DataFrame:
    """Rows (key, n_tokens long, target_loss, background_loss, difference): mean losses in nats per token.

    Null and empty texts have no tokens and null losses.
    """
    shared = df.sparkSession.sparkContext.broadcast(counts)

    @steady
    def run(batches):
        found = shared.value
        # both tables together: 128 MB whatever the corpus
        target, background = (log_probabilities(found.codes, c, smooth) for c in (found.target, found.background))
        for batch in slices(batches, text):
            codes, sizes = trigrams(texts(batch, text))
            ends = np.cumsum(sizes)
            means = []
            for table in (target, background):
                total = np.concatenate([[0.0], np.cumsum(table[codes], dtype=np.float64)])
                means.append(-(total[ends] - total[ends - sizes]) / np.maximum(sizes, 1))
            none = sizes == 0
            columns = [pa.array(m, mask=none) for m in (*means, means[0] - means[1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(sizes), *columns],
                names=[key, "n_tokens", "target_loss", "background_loss", "difference"],
            )

    schema = f"`{key}` {kind(df, key)}, n_tokens long, target_loss double, background_loss double, difference double"
    return shape(df, key, text).mapInArrow(run, schema)


def cross_entropy_difference(
    df: DataFrame, target_keys: DataFrame, key: str = "doc_id", text: str = "text", smooth: float = SMOOTH
) -> DataFrame:
    """Score df against the texts of df whose key is in target_keys (first column; repeats and nulls count for nothing)."""
    own = target_keys.select(F.col(target_keys.columns[0]).alias("wanted")).distinct().withColumn("chosen", F.lit(True))
    # the keys grow with the texts: one plan for all sizes, both sides dealt by key
    own = own.hint("merge")
    marked = shape(df, key, text).toDF("k", "t").join(own, F.col("k") == F.col("wanted"), "left").select("t", "chosen")
    return score(df, count(marked, "t", "chosen"), key, text, smooth)
