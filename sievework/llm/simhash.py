"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made in one narrow pass. The distinct ones are cut into segments; by the pigeonhole rule two
fingerprints within `distance` bits are within a small radius t of each other in one segment at least, where the radii
plus one add up to distance + 1. Every fingerprint is entered once per segment under the segment's value and looks
up the values of the Hamming ball of radius t around it; what meets is compared in full.

Only connectivity is asked for, so a bucket yields a spanning forest of its links, never all pairs. A bucket with more
than BLOCK entries is cut into blocks that meet one by one. Segments get wider as the number of fingerprints grows, which
keeps buckets short and changes no result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind, named, rows, shape, slices, steady, texts, written
from .components import components

BITS = 64
SEED = 42
SHINGLE = 4
DISTANCE = 4
BLOCK = 4096
PAIRS = 1 << 21
HASHES = 1 << 18


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `size` words; the whole sequence if there are fewer words, nothing if there are none."""
    # bytes.lower and bytes.split know ASCII letters and ASCII white space only, as asked for
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Per array the number whose bits are 1 where more than half of its hashes have a 1; 0 for an empty array."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    place = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))
    for i, found in enumerate(hashes):
        ones = np.zeros(BITS, dtype=np.int64)
        for start in range(0, len(found), HASHES):
            part = found[start : start + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[i] = place[2 * ones > len(found)].sum(dtype=np.uint64)
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows (key, fp long): the 64 bits as a signed number. Null text counts as empty; no words give 0."""

    @steady
    def run(batches):
        for batch in slices(batches, text):
            found = majority([shingle_hashes(t, size) for t in texts(batch, text)])
            yield rows(**{key: batch.column(key), "fp": found.view(np.int64)})

    return shape(df, key, text).mapInArrow(run, f"`{key}` {kind(df, key)}, fp long")


def layout(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) per segment; radii plus one add up to distance + 1, so one segment must be within its own."""
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    shares = [(distance + 1) // segments + (i < (distance + 1) % segments) for i in range(segments)]
    return [(sum(widths[:i]), widths[i], shares[i] - 1) for i in range(segments) if shares[i]]


def segments_for(count: int, distance: int) -> int:
    """As many segments as leave each wide enough to tell `count` fingerprints apart."""
    return min(distance + 1, max(2, BITS // max(1, int(count).bit_length())))


def bucket_rows(fps: DataFrame, plan: list[tuple[int, int, int]], more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (bucket, fp, *more, probe): table entries (probe false) and look-ups of the ball around them (probe true).

    Of two values that differ, the one with a 0 at the lowest differing bit looks up the other.
    """

    def value(shift: int, width: int) -> Column:
        moved = F.shiftrightunsigned("fp", shift)
        return moved if width == BITS else moved.bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    def bucket(i: int, at: Column) -> Column:
        return F.xxhash64(F.lit(i), at)

    own, balls = [], []
    for i, (shift, width, radius) in enumerate(plan):
        own.append(F.struct(bucket(i, value(shift, width)).alias("bucket"), F.lit(False).alias("probe")))
        masks = [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]
        if masks:
            at = value(shift, width)
            lits = F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long") for m in masks])
            low = F.filter(lits, lambda m: at.bitwiseAND(m).bitwiseAND(-m) == 0)
            balls.append(F.transform(low, lambda m: F.struct(bucket(i, at.bitwiseXOR(m)).alias("bucket"), F.lit(True).alias("probe"))))
    entries = F.array(*own)
    exploded = fps.select("fp", *more, F.explode(F.concat(entries, *balls) if balls else entries).alias("e"))
    return exploded.select("e.bucket", "fp", *more, "e.probe")


def cut_blocks(table: DataFrame, block: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (bucket, tile, fp, *more, probe): buckets of over `block` entries are cut; an entry looks up the later tiles too."""
    heavy = table.where(~F.col("probe")).groupBy(F.col("bucket").alias("heavy")).agg(F.count(F.lit(1)).alias("n"))
    heavy = written(heavy.where(F.col("n") > block).select("heavy", F.ceil(F.col("n") / block).cast("int").alias("tiles")), "heavy")
    if heavy.isEmpty():
        return table.select("bucket", F.lit(0).alias("tile"), "fp", *more, "probe")
    joined = table.join(heavy, F.col("bucket") == F.col("heavy"), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    home = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    first = F.when(F.col("probe"), F.lit(0)).otherwise(home)
    spread = joined.withColumn("home", home).withColumn("tile", F.explode(F.sequence(first, F.col("tiles") - 1)))
    return spread.select("bucket", "tile", "fp", *more, (F.col("probe") | (F.col("tile") != F.col("home"))).alias("probe"))


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the given links connect, at most one per node."""
    nodes, codes = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = codes[: len(left)], codes[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def pairs_within(group, fp, left_ok, is_table, distance: int):
    """Places (left, right) of rows and table rows of the same group within `distance` bits; rows are sorted by group, tables first."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(starts, len(group)))
    tables = np.add.reduceat(is_table.astype(np.int64), starts) if len(starts) else np.empty(0, dtype=np.int64)
    # per row: how many table rows it meets
    meets = np.where(left_ok, np.repeat(tables, sizes), 0)
    base = np.repeat(starts, sizes)
    row, ends = 0, np.cumsum(meets)
    while row < len(fp):
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        n = meets[row:stop]
        left = np.repeat(np.arange(row, stop), n)
        right = np.repeat(base[row:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = np.bitwise_count(fp[left] ^ fp[right]) <= distance
        if near.any():
            yield left[near], right[near]
        row = stop


def links_within(group, fp, left_ok, is_table, distance: int):
    """Links between different fingerprints that `pairs_within` finds, as arrays (a, b)."""
    for left, right in pairs_within(group, fp, left_ok, is_table, distance):
        differ = fp[left] != fp[right]
        if differ.any():
            yield forest(fp[left[differ]].view(np.int64), fp[right[differ]].view(np.int64))


def near_links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK, segments: int | None = None) -> DataFrame:
    """Rows (a, b) over distinct fingerprints that connect all pairs within `distance` bits, and no others."""
    plan = layout(distance, segments or segments_for(fps.count(), distance))
    table = cut_blocks(bucket_rows(fps, plan), block)
    table = table.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "probe")

    @steady
    def run(batches):
        last, carried = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, tile, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "tile", "fp"))
            probe = batch.column("probe").to_numpy(zero_copy_only=False)
            change = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])])
            old = carried if last == (bucket[0], tile[0]) else carried[:0]
            group = np.concatenate([np.zeros(len(old), dtype=np.int64), np.cumsum(change) - 1])
            fp = np.concatenate([old, fp.view(np.uint64)])
            is_table = np.concatenate([np.ones(len(old), dtype=bool), ~probe])
            fresh = np.arange(len(fp)) >= len(old)
            for a, b in links_within(group, fp, fresh, is_table, distance):
                yield rows(a=a, b=b)
            # a bucket may go on in the next batch: its entries, at most a block, come along
            last, carried = (bucket[-1], tile[-1]), fp[(group == group[-1]) & is_table]

    return table.mapInArrow(run, "a long, b long")


def simhash_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE,
    block: int = BLOCK, segments: int | None = None,
) -> DataFrame:
    """Rows (key, fp long, fingerprint string, component_id): the smallest key reachable by links, own key included.

    Null and empty texts have fingerprint 0, linked like any other. A null key takes part and never names a component
    that has another key. Repeated rows come out repeated. `segments` fixes the number of segments, else it follows the
    number of fingerprints.
    """
    prints = written(fingerprints(df, key, text, size), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min(named(key)).alias("least")), "distinct")
    linked = components(near_links(distinct.select("fp"), distance, block, segments), "a", "b")
    rooted = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named_by = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    answer = rooted.join(named_by, F.col("root") == F.col("r")).select(F.col("fp").alias("print"), "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(answer, F.col("fp") == F.col("print")).select(named(key), "fp", digits.alias("fingerprint"), "component_id")
