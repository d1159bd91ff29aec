"""Near copies by shingle similarity: SimHash groups first, then texts that share least hashes; exact sets decide.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is LEAST or more; texts without words
are copies of each other. Every link is verified on the exact sets. Candidates come in two ways:

1. five-word SimHash fingerprints within four bits, by multi-index hashing. This joins most near copies
   at the cost of a spanning forest.
2. At similarity 0.8 fingerprints differ in up to 14 bits and more, where no table of segments is selective. So the rest is
   searched by least hashes: two sets of similarity s agree in the least member under a random order with probability s.
   Texts that agree in two of MINIMA orders share a list; at s = 0.8 all but one pair in 12,000 do.

A text can have a partner only if four fifths of its shingles occur in another text of the lists: the others, as texts that
share no more than a common passage, go before any are compared.

Only connectivity is asked for. In each list every text is first compared with PIVOTS of its texts, others each round, and what
that links is one component and is not compared again: texts that a few others of their group link cost comparisons in
the number of texts, not its square. What is left over after the rounds (texts of a list in different components) meets in tiles
of bounded size, by counting common shingles; no pair becomes a row. Passed over are sizes that can't have the similarity,
fingerprints more than FAR bits apart (one pair of similarity 0.8 in 100,000) and sketches of 1,024 least hashes, a bit
each, that differ in more than UNLIKE places (one in 60,000). Equal texts are compared once, whatever their number.

Null texts count as empty; a null key takes part; repeated rows come out repeated; an empty table gives an empty one;
further columns are left out. Long texts are held one at a time.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind, named, rows, shape, slices, steady, texts, written
from .components import components
from .simhash import majority, near_links, shingle_hashes

SHINGLE = 5
LEAST = 0.8
MINIMA = 8
FAR = 22
PLACES = 1024
UNLIKE = 143
PIVOTS = 6
ROUNDS = 1
TILE = 1 << 17
ODD = np.random.default_rng(5).integers(1, 1 << 63, size=MINIMA, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def text_id(text: str) -> int:
    """The same number for texts of the same words."""
    line = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def minima(found: np.ndarray) -> list[int]:
    """The least member under MINIMA orders, as signed numbers; nothing for an empty set."""
    if not len(found):
        return []
    out = []
    for i, odd in enumerate(ODD):
        mixed = found * odd
        mixed = (mixed ^ (mixed >> np.uint64(31))) * odd
        out.append(int(mixed.min() ^ np.uint64(i)))
    return np.array(out, dtype=np.uint64).view(np.int64).tolist()


ORDERS = np.random.default_rng(6).integers(1, 1 << 63, size=PLACES, dtype=np.int64).astype(np.uint64) | np.uint64(1)
SKETCHED = 1 << 9


def sketch(found: np.ndarray) -> list[int]:
    """One bit of the least member under each of PLACES orders, 64 to a number; nothing for an empty set."""
    if not len(found):
        return []
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), SKETCHED):
        mixed = found[start : start + SKETCHED, None] * ORDERS
        mixed ^= mixed >> np.uint64(29)
        mixed *= ORDERS
        np.minimum(least, mixed.min(axis=0), out=least)
    # the low bits of an odd multiple say little; a middle one does
    return np.packbits(((least >> np.uint64(21)) & np.uint64(1)).astype(np.uint8)).view("<i8").tolist()


def prints(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, tid long, fp long, n int, minima array<long>): n is the number of different shingles."""

    @steady
    def run(batches):
        for batch in slices(batches, text):
            found = texts(batch, text)
            hashes = [shingle_hashes(t, SHINGLE) for t in found]
            sets = [np.unique(h) for h in hashes]
            yield rows(**{
                key: batch.column(key),
                "tid": pa.array([text_id(t) for t in found], type=pa.int64()),
                "fp": majority(hashes).view(np.int64),
                "n": np.array([len(s) for s in sets], dtype=np.int32),
                "minima": pa.array([minima(s) for s in sets], type=pa.list_(pa.int64())),
            })

    return shape(df, key, text).mapInArrow(run, f"`{key}` {kind(df, key)}, tid long, fp long, n int, minima array<long>")


def text_ids(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows (tid, text): each text once per task."""

    @steady
    def run(batches):
        seen = set()
        for batch in slices(batches, "text"):
            found = [text_id(t) for t in texts(batch, "text")]
            fresh = []
            for tid in found:
                fresh.append(tid not in seen)
                seen.add(tid)
            at = pa.array(fresh, type=pa.bool_())
            yield rows(tid=pa.array(found, type=pa.int64()).filter(at), text=batch.column("text").filter(at))

    return df.select(named(text).alias("text")).mapInArrow(run, "tid long, text string")


def only(df: DataFrame, kept: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df whose key and text id are among kept (key, tid), one of each; columns as in df."""

    @F.pandas_udf("long")
    def tid(found: pd.Series) -> pd.Series:
        return pd.Series([text_id(t or "") for t in found], dtype="int64")

    own = "__tid"
    while own in df.columns:
        own += "_"
    held = df.withColumn(own, tid(named(text)))
    wanted = kept.select(named(key).alias("wanted_key"), F.col("tid").alias("wanted_tid"))
    met = held.join(wanted, (held[f"`{key}`"] == F.col("wanted_key")) & (held[own] == F.col("wanted_tid")), "left_semi")
    return met.dropDuplicates([key, own]).drop(own)


def unlike(left: Column, right: Column) -> Column:
    """In how many bits two sketches differ; null if one is empty."""
    apart = [F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))) for i in range(PLACES // 64)]
    return functools.reduce(lambda x, y: x + y, apart)


def comparable(left: str, right: str) -> Column:
    """Sizes (n) can have the similarity LEAST; fingerprints (fp) and sketches are not too far apart for it."""
    n, m = F.col(left + ".n"), F.col(right + ".n")
    bits = F.bit_count(F.col(left + ".fp").bitwiseXOR(F.col(right + ".fp")))
    apart = unlike(F.col(left + ".sketch"), F.col(right + ".sketch"))
    return (F.least(n, m) >= LEAST * F.greatest(n, m)) & (bits <= FAR) & (apart <= UNLIKE)


def verified(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows (a, b) of pairs of text ids whose shingle sets have similarity LEAST or more; held has each text once."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(held.toDF("a", "left"), "a").join(held.toDF("b", "right"), "b").select("a", "b", "left", "right")

    @steady
    def run(batches):
        known: dict[int, np.ndarray] = {}

        def sets(batch, name, column):
            for tid, text in zip(batch.column(name).to_pylist(), texts(batch, column)):
                if tid not in known:
                    # a pivot meets many texts: its set is made once
                    if len(known) >= 64:
                        known.clear()
                    known[tid] = shingle_set(text)
                yield known[tid]

        for batch in slices(batches, "left"):
            near = []
            for x, y in zip(sets(batch, "a", "left"), sets(batch, "b", "right")):
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common >= LEAST * (len(x) + len(y) - common))
            near = pa.array(near, type=pa.bool_())
            yield rows(a=batch.column("a").filter(near), b=batch.column("b").filter(near))

    return written(both.mapInArrow(run, "a long, b long"), "links")


def shared_shingles(held: DataFrame) -> DataFrame:
    """Rows (tid, k): how many shingles of a text occur in other texts too; texts without any have no row.

    Shingles that several texts of a slice hold are counted there and go on as one mark, so a shingle that all texts hold is
    no hot key. Of the others every one that met another becomes one row at most and is added up by Spark, so rows grow with the
    shingles, however these fall into batches.
    """

    @steady
    def run(batches):
        for batch in slices(batches, "text"):
            tids = batch.column("tid").to_numpy(zero_copy_only=False)
            sets = [shingle_set(t) for t in texts(batch, "text")]
            found = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
            owner = np.repeat(np.arange(len(tids)), [len(x) for x in sets])
            _, first, code, times = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
            alone = times[code] == 1
            k = np.bincount(owner[~alone], minlength=len(tids))
            marks = found[first[times > 1]].view(np.int64)
            yield rows(
                h=pa.array(np.concatenate([found[alone].view(np.int64), marks, np.zeros(len(tids), dtype=np.int64)])),
                tid=pa.array(np.concatenate([tids[owner[alone]], np.zeros(len(marks), dtype=np.int64), tids])),
                # 0: a shingle of one text, 1: a shingle known to be shared, 2: a text's count
                part=pa.array(np.repeat(np.array([0, 1, 2], dtype=np.int8), [alone.sum(), len(marks), len(tids)])),
                k=pa.array(np.concatenate([np.zeros(alone.sum() + len(marks), dtype=np.int64), k])),
            )

    @steady
    def meet(batches):
        carried = None
        for batch in batches:
            h, tid, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "tid", "part"))
            if carried is not None:
                h, tid, part = (np.concatenate(pair) for pair in zip(carried, (h, tid, part)))
            if not len(h):
                continue
            # the last run may go on in the next batch
            cut = int(np.searchsorted(h, h[-1]))
            carried = h[cut:], tid[cut:], part[cut:]
            yield shared(h[:cut], tid[:cut], part[:cut])
        if carried is not None:
            yield shared(*carried)

    def shared(h, tid, part):
        if len(h):
            # h is sorted: a run of one value is one shingle
            start = np.concatenate([[True], h[1:] != h[:-1]])
            code = np.cumsum(start) - 1
            known = (np.bincount(code) > 1) | (np.bincount(code, weights=part) > 0)
            tid = tid[known[code] & (part == 0)]
        return rows(tid=pa.array(tid, type=pa.int64()))

    made = written(held.mapInArrow(run, "h long, tid long, part byte, k long"), "shingles")
    sorted_ = made.where("part < 2").select("h", "tid", "part").repartition("h").sortWithinPartitions("h")
    met = sorted_.mapInArrow(meet, "tid long").select("tid", F.lit(1).cast("long").alias("k"))
    counts = met.union(made.where("part = 2").select("tid", "k"))
    return counts.groupBy("tid").agg(F.sum("k").alias("k"))


def print_pairs(distinct: DataFrame) -> DataFrame:
    """Rows (a, b): texts that a spanning forest of near fingerprints connects, by multi-index hashing."""
    first = written(distinct.groupBy("fp").agg(F.min("tid").alias("least"), F.max("tid").alias("most")), "prints-distinct")
    shared = first.where("least <> most").select("fp", "least")
    equal = distinct.select("fp", "tid").join(shared, "fp").where("tid <> least").select(F.col("tid").alias("a"), F.col("least").alias("b"))
    links = near_links(first.select("fp"))
    ends = first.select("fp", "least")
    near = links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return equal.union(near)


def shared_lists(distinct: DataFrame) -> DataFrame:
    """Rows (at, tid, degree): the lists of two or more texts that agree in two least hashes; degree adds up the sizes of a
    text's lists."""
    at = F.array(*[F.xxhash64(F.lit(i), F.lit(j), F.col("minima")[i], F.col("minima")[j]) for i, j in combinations(range(MINIMA), 2)])
    entries = distinct.where("n > 0").select("tid", F.explode(at).alias("at"))
    met = entries.groupBy("at").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo <> hi").select("at")
    found = written(entries.join(met, "at").select("at", "tid"), "met")
    sizes = found.groupBy("at").agg(F.count(F.lit(1)).alias("size"))
    degree = found.join(sizes, "at").groupBy("tid").agg(F.sum("size").alias("degree"))
    return found.join(degree, "tid").select("at", "tid", "degree")


def sketches(held: DataFrame, distinct: DataFrame) -> DataFrame:
    """Rows (tid, fp, n, sketch) of the texts held."""

    @steady
    def run(batches):
        for batch in slices(batches, "text"):
            found = [sketch(shingle_set(t)) for t in texts(batch, "text")]
            yield rows(tid=batch.column("tid"), sketch=pa.array(found, type=pa.list_(pa.int64())))

    made = held.mapInArrow(run, "tid long, sketch array<long>")
    return written(made.join(distinct.select("tid", "fp", "n"), "tid").select("tid", "fp", "n", "sketch"), "sketches")


def with_roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (tid, fp, n, sketch, root) of the nodes."""
    found = components(links, "a", "b")
    rooted = nodes.join(found, F.col("tid") == F.col("node"), "left")
    return written(rooted.select("tid", "fp", "n", "sketch", F.coalesce("root", "tid").alias("root")), "rooted")


def split_lists(lists: DataFrame, rooted: DataFrame) -> DataFrame:
    """Rows (at, tid, degree, fp, n, sketch, root) of the lists that still hold texts of different components, one row per list and text."""
    entries = lists.join(rooted, "tid")
    mixed = entries.groupBy(F.col("at").alias("list")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("list")
    return written(entries.join(mixed, F.col("at") == F.col("list")).select("at", "tid", "degree", "fp", "n", "sketch", "root"), "entries")


def pivot_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """Rows (a, b): each text of a list with the list's pivots of this round that are of other components."""
    # the first is the text that meets most others, as the original of a group of edited copies does; the rest are drawn per
    # round, the same ones for all lists that hold them
    drawn = [F.struct(F.xxhash64("tid", F.lit(turn * PIVOTS + i)), F.col("tid")) for i in range(PIVOTS - 1)]
    drawn.append(F.struct(-F.col("degree"), F.col("tid")))
    chosen = [F.min_by(F.struct("tid", "fp", "n", "sketch", "root"), d).alias(f"p{i}") for i, d in enumerate(drawn)]
    pivot = entries.groupBy(F.col("at").alias("list")).agg(*chosen)
    pivot = pivot.select("list", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("p"))
    met = entries.alias("e").join(pivot, F.col("at") == F.col("list"))
    met = met.where((F.col("e.root") != F.col("p.root")) & comparable("e", "p"))
    return met.select(F.col("e.tid").alias("a"), F.col("p.tid").alias("b"))


def tile_links(tids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what pairs of similarity LEAST or more connect beyond the roots; no set is empty."""
    sizes = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    part = np.unique(roots, return_inverse=True)[1]
    mark = np.zeros(code.max() + 1, dtype=bool)
    links = []
    for i in range(len(sets) - 1):
        small, great = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        other = np.flatnonzero((part[i + 1 :] != part[i]) & (small >= LEAST * great)) + i + 1
        if not len(other):
            continue
        own = code[starts[i] : starts[i + 1]]
        mark[own] = True
        rest = starts[i + 1]
        common = np.add.reduceat(mark[code[rest:]], starts[i + 1 :] - rest, dtype=np.int64)[other - i - 1]
        mark[own] = False
        for j in other[common >= LEAST * (sizes[i] + sizes[other] - common)].tolist():
            if part[j] != part[i]:
                links.append((int(tids[i]), int(tids[j])))
                part[part == part[j]] = part[i]
    return links


def left_links(held: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (a, b): verified links between texts of a list that are of different components.

    A list is cut into parts of TILE shingles by the text's id; a tile holds two parts, so no task holds a whole list.
    Texts without a comparable partner in their list don't go into a tile. Pairs are met in the tile and never become rows.
    """
    other = entries.alias("o")
    own = entries.alias("e")
    met = own.join(other, (F.col("e.at") == F.col("o.at")) & (F.col("e.root") != F.col("o.root")) & comparable("e", "o"), "left_semi")
    met = written(met.select("at", "tid", "n", "root"), "left")

    @steady
    def sets(batches):
        for batch in slices(batches, "text"):
            found = [shingle_set(t).view(np.int64) for t in texts(batch, "text")]
            yield rows(tid=batch.column("tid"), found=pa.array(found, type=pa.list_(pa.int64())))

    def tile(table):
        table = table.sort_by("tid")
        found = [x.values.to_numpy() for x in table.column("found")]
        links = tile_links(table.column("tid").to_numpy(), table.column("root").to_numpy(), found)
        return pa.table({
            "a": pa.array([a for a, _ in links], type=pa.int64()),
            "b": pa.array([b for _, b in links], type=pa.int64()),
        })

    parts = met.groupBy(F.col("at").alias("list")).agg(F.ceil(F.sum("n") / TILE).cast("int").alias("parts"))
    cut = met.join(parts, F.col("at") == F.col("list")).withColumn("own", F.pmod(F.xxhash64("tid"), "parts").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("tid", "root", "at", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    wanted = met.select(F.col("tid").alias("wanted")).distinct()
    made = held.join(wanted, F.col("tid") == F.col("wanted"), "left_semi").mapInArrow(sets, "tid long, found array<long>")
    given = cut.join(made, "tid").select("at", "x", "y", "tid", "root", "found")
    return written(given.groupBy("at", "x", "y").applyInArrow(tile, "a long, b long"), "left-links")


def roots(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Two written tables: rows (key, tid) of all rows, and rows (tid, root) of all different texts."""
    given = written(prints(df, key, text), "near-prints")
    distinct = written(given.groupBy("tid").agg(*[F.first(c).alias(c) for c in ("fp", "n", "minima")]), "near-distinct")
    lists = written(shared_lists(distinct), "lists")
    pairs = written(print_pairs(distinct), "print-pairs")
    wanted = lists.select("tid").union(pairs.select("a")).union(pairs.select("b")).distinct().toDF("wanted")
    held = text_ids(df, text).join(wanted, F.col("tid") == F.col("wanted"), "left_semi")
    held = written(held.groupBy("tid").agg(F.first("text").alias("text")), "near-texts")
    kept = shared_shingles(held).join(distinct.select("tid", "n"), "tid").where(F.col("k") >= LEAST * F.col("n")).select("tid")
    kept = written(kept, "sharing")
    held, lists = written(held.join(kept, "tid"), "sharing-texts"), written(lists.join(kept, "tid"), "sharing-lists")
    pairs = pairs.join(kept.toDF("a"), "a", "left_semi").join(kept.toDF("b"), "b", "left_semi")
    nodes = sketches(held, distinct)
    links = verified(held, pairs)
    rooted = with_roots(nodes, links)
    entries = split_lists(lists, rooted)
    for turn in range(ROUNDS):
        more = verified(held, pivot_pairs(entries, turn))
        links = links.union(more)
        rooted = with_roots(nodes, links)
        entries = split_lists(entries.select("at", "tid", "degree"), rooted)
    found = components(links.union(left_links(held, entries)), "a", "b")
    whole = distinct.join(found, F.col("tid") == F.col("node"), "left").select("tid", F.coalesce("root", "tid").alias("root"))
    return given.select(named(key), "tid"), written(whole, "near-roots")


def near_copy_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, tid, component): component is a number shared by the texts that links connect."""
    given, rooted = roots(df, key, text)
    return given.join(rooted, "tid").select(named(key), "tid", F.col("root").alias("component"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables of rows (key, tid): all of df, and per component the one of smallest key, then smallest text id.

    Rows without a key represent nothing. Keys are first reduced per text, so a text with many copies is no hot group.
    """
    given, rooted = roots(df, key, text)
    least = given.where(named(key).isNotNull()).groupBy("tid").agg(F.min(named(key)).alias("least"))
    best = F.min(F.struct("least", "tid")).alias("best")
    chosen = least.join(rooted.select("tid", "root"), "tid").groupBy("root").agg(best)
    return given, chosen.select(F.col("best.least").alias(key), F.col("best.tid").alias("tid"))
