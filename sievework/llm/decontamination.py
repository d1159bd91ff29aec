"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of n words may differ from its place in a text by k = floor(rate * n) word edits. Cut into k + 1 pieces, one
piece at least stands unchanged in any such place. Exact piece hits are found on arrays of word numbers; the words
around a hit are compared with the item by Myers' bit-parallel distance, the item's words being the bits.

Texts are read in place, without shuffle. The items' index is broadcast in blocks of at most ITEM_BYTES of text; more
items mean more passes, so the broadcast never outgrows the bound.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, named, shape, slices, steady, texts

RATE = 0.2
SHORTEST = 5
ITEM_BYTES = 32 << 20
WORD = re.compile(r"\w+")
MIX = 0x9E3779B97F4A7C15
TOP = (1 << 64) - 1


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def cut(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of `parts` pieces of n words, as equal as can be."""
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def distance(item: dict[int, int], n: int, text) -> tuple[int, int]:
    """(least edits, end of the earliest best place) of an item of n words anywhere in a row of word numbers.

    item maps a word number to the bits of the places where the item has it.
    """
    full, high = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, at = full, 0, n, n, 0
    for i, word in enumerate(text):
        same = item.get(word, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = down | ~(horizontal | up)
        minus = up & horizontal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1, minus << 1
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical & full
        if score < best:
            best, at = score, i + 1
    return best, at


def bits(numbers: list[int]) -> dict[int, int]:
    found: dict[int, int] = {}
    for i, number in enumerate(numbers):
        found[number] = found.get(number, 0) | 1 << i
    return found


class Index:
    """Items with their vocabulary (numbers from 1; 0 is any other word) and the hashes of their pieces by length."""

    def __init__(self, items: list[tuple], rate: float, shortest: int):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for key, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")]
            n = len(numbers)
            if n < shortest or not n:
                continue
            edits = int(rate * n)
            place = len(self.items)
            self.items.append((key, n, edits, bits(numbers), bits(numbers[::-1])))
            for start, end in cut(n, edits + 1):
                value = 0
                for number in numbers[start:end]:
                    value = (value * MIX + number) & TOP
                pieces.setdefault(end - start, {}).setdefault(value, []).append((place, start))
        self.by_length = {}
        for length, table in pieces.items():
            order = np.array(sorted(table), dtype=np.uint64)
            self.by_length[length] = (order, [table[v] for v in order.tolist()])

    def hits(self, numbers: np.ndarray):
        """(item place, start the item would have) of every exact piece hit."""
        for length, (order, places) in self.by_length.items():
            size = len(numbers) - length + 1
            if size <= 0:
                continue
            known = np.ones(size, dtype=bool)
            value = np.zeros(size, dtype=np.uint64)
            for i in range(length):
                part = numbers[i : i + size]
                known &= part > 0
                value = value * np.uint64(MIX) + part.astype(np.uint64)
            at = np.flatnonzero(known)
            slot = np.searchsorted(order, value[at])
            slot[slot == len(order)] = 0
            good = order[slot] == value[at]
            for position, s in zip(at[good].tolist(), slot[good].tolist()):
                for item, start in places[s]:
                    yield item, position - start

    def matches(self, texts_: list[str]):
        """(row, item place, edits, first word, end word) of each item found in each text, at its earliest best place."""
        found = [words(t) for t in texts_]
        sizes = np.array([len(w) for w in found], dtype=np.int64)
        # a word of no item between texts keeps pieces from reaching over
        line = np.fromiter(
            (n for of in found for n in (*map(self.vocabulary.get, of, repeat(0)), 0)), dtype=np.int64, count=int((sizes + 1).sum())
        )
        begins = np.cumsum(sizes + 1) - (sizes + 1)
        hits = sorted(set(self.hits(line)))
        ranges: dict[tuple[int, int], list[list[int]]] = {}
        for item, start in hits:
            _, n, edits, *_ = self.items[item]
            low, high = max(0, start - edits), min(len(line), start + n + edits)
            # the range may touch several texts; each is searched for itself
            first = int(np.searchsorted(begins, low, side="right")) - 1
            last = int(np.searchsorted(begins, high - 1, side="right")) - 1
            for row in range(first, last + 1):
                begin, end = int(begins[row]), int(begins[row] + sizes[row])
                a, b = max(low, begin), min(high, end)
                if b - a < n - edits:
                    continue
                held = ranges.setdefault((row, item), [])
                if held and a <= held[-1][1]:
                    held[-1][1] = max(held[-1][1], b)
                else:
                    held.append([a, b])
        for (row, item), held in sorted(ranges.items()):
            _, n, edits, forward, backward = self.items[item]
            best = None
            for a, b in held:
                part = line[a:b].tolist()
                if sum(map(forward.__contains__, part)) < n - edits:
                    continue
                score, end = distance(forward, n, part)
                if score <= edits and (best is None or score < best[0]):
                    # the same search from the end backwards gives the start
                    _, back = distance(backward, n, part[:end][::-1])
                    shift = a - int(begins[row])
                    best = (score, shift + end - back, shift + end)
            if best:
                yield row, item, *best


def item_blocks(items: DataFrame, key: str, text: str, limit: int = ITEM_BYTES):
    """Items as lists of (key, text), each of about `limit` bytes of text at most, one list in memory at a time."""
    shaped = shape(items, key, text).where(named(text).isNotNull())
    total = shaped.agg(F.sum(F.octet_length(named(text)))).first()[0] or 0
    blocks = -(-total // limit)
    for block in range(blocks):
        part = shaped.where(F.pmod(F.xxhash64(named(text)), F.lit(blocks)) == block)
        table = part.toArrow()
        yield list(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))


def find_items(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    rate: float = RATE, shortest: int = SHORTEST,
) -> DataFrame:
    """Rows (key, item, edits long, item_words long, first_word long, end_word long): items found in texts.

    Words are runs of letters, digits and underscores in lower case, counted from 0, end exclusive. One row per text and
    item, for its best place (earliest of equals). Null or empty texts and items match nothing, nor do items of fewer
    than `shortest` words, which would be found by chance. Repeated rows of either side give repeated rows.
    """
    schema = f"`{key}` {kind(df, key)}, `{item}` {kind(items, item)}, edits long, item_words long, first_word long, end_word long"
    out = df.sparkSession.createDataFrame([], schema)
    names = [key, item, "edits", "item_words", "first_word", "end_word"]
    item_type = items.select(named(item)).limit(0).toArrow().schema.field(0).type
    for block in item_blocks(items, item, item_text):
        shared = df.sparkSession.sparkContext.broadcast(Index(block, rate, shortest))

        @steady
        def run(batches, shared=shared):
            index = shared.value
            for batch in slices(batches, text):
                found = list(index.matches(texts(batch, text)))
                columns = [batch.column(key).take(pa.array([f[0] for f in found], type=pa.int64()))]
                columns.append(pa.array([index.items[f[1]][0] for f in found], type=item_type))
                columns.append(pa.array([f[2] for f in found], type=pa.int64()))
                columns.append(pa.array([index.items[f[1]][1] for f in found], type=pa.int64()))
                columns += [pa.array([f[i] for f in found], type=pa.int64()) for i in (3, 4)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        out = out.union(shape(df, key, text).mapInArrow(run, schema))
    return out


def without_items(
    df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    rate: float = RATE, shortest: int = SHORTEST,
) -> DataFrame:
    """The rows of df whose text holds no item, all columns as they were; same rules as find_items."""
    for block in item_blocks(items, item, item_text):
        shared = df.sparkSession.sparkContext.broadcast(Index(block, rate, shortest))

        @steady
        def run(batches, shared=shared):
            for batch in slices(batches, text):
                found = {f[0] for f in shared.value.matches(texts(batch, text))}
                yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)]))

        df = df.mapInArrow(run, df.schema)
    return df
