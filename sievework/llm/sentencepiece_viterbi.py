"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The distinct marked words of a slice of texts are sorted, which lays them out as a trie read depth first. Going from a
word to the next, the forward scores of their common prefix stay on the stack, only the rest is computed. A narrow
pass without shuffle: words recur within a slice and, through a bounded cache, within a task.

Nulls: a null text has null pieces. An empty text has none. Texts of any length are encoded whole; cost is linear in
the text. A literal U+2581 in a text decodes as a space (round_trip is then false). Repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kind, shape, slices, steady
from .pieces import MODEL, Pieces, Tokens, WordCache, load_pieces, word_finder

END = ""  # in a node of the trie of pieces: the score of the piece that ends here


def piece_trie(scores: dict[str, float]) -> dict:
    root: dict = {}
    for piece, score in scores.items():
        node = root
        for letter in piece:
            node = node.setdefault(letter, {})
        node[END] = score
    return root


def best_segments(words: list[str], root: dict, unknown: float):
    """(word, starts of its best pieces) for sorted words.

    best, begins and open_at are the stack of the walk: per prefix its forward score, the start of its last piece, and
    the pieces begun but not ended, as (start, node).
    """
    best, begins, open_at, before = [0.0], [0], [[]], ""
    for word in words:
        keep, most = 0, min(len(before), len(word))
        while keep < most and before[keep] == word[keep]:
            keep += 1
        del best[keep + 1 :], begins[keep + 1 :], open_at[keep + 1 :]
        for last in range(keep, len(word)):
            letter, top, at, going, alone = word[last], None, last, [], False
            for begin, node in [*open_at[last], (last, root)]:
                node = node.get(letter)
                if node is None:
                    continue
                going.append((begin, node))
                if END in node:
                    alone = alone or begin == last
                    score = best[begin] + node[END]
                    # starts come in order; only a better sum replaces an earlier one
                    if top is None or score > top:
                        top, at = score, begin
            if not alone and (top is None or best[last] + unknown > top):
                top, at = best[last] + unknown, last
            best.append(top)
            begins.append(at)
            open_at.append(going)
        cuts, end = [], len(word)
        while end:
            end = begins[end]
            cuts.append(end)
        yield word, cuts[::-1]
        before = word


def piece_ids(word: str, starts: list[int], pieces: Pieces) -> list[int]:
    found = []
    for start, end in zip(starts, [*starts[1:], len(word)]):
        piece = word[start:end]
        i = pieces.ids.get(piece)
        found += [i] if i is not None else [pieces.byte_ids[b] for b in piece.encode("utf-8", "replace")]
    return found


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces, self.find, self.cache = pieces, word_finder(pieces), WordCache()
        self.trie = piece_trie(pieces.scores)
        self.blob = np.frombuffer(b"".join(pieces.surfaces), dtype=np.uint8)
        self.sizes = np.array([len(s) for s in pieces.surfaces], dtype=np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes

    def solve(self, words: list[str]):
        for word, starts in best_segments(words, self.trie, self.pieces.unknown):
            yield word, np.array(piece_ids(word, starts, self.pieces), dtype=np.int32).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many belong to each."""
        tokens = Tokens(column)
        found = self.cache.look_up(tokens.distinct, self.find, self.solve, b"".join)
        ids = np.frombuffer(b"".join(found), dtype=np.int32)
        sizes = np.array([len(f) // 4 for f in found], dtype=np.int64)
        return ids[gather(np.cumsum(sizes) - sizes, sizes, tokens.codes)], tokens.sums(sizes)

    def decode(self, ids: np.ndarray) -> str:
        """Text of a row of ids; invalid bytes become U+FFFD, ids outside the vocabulary the unknown sign."""
        if not len(ids):
            return ""
        ids = np.where((ids >= 0) & (ids < len(self.sizes)), ids, self.pieces.unknown_id)
        text = self.blob[gather(self.places, self.sizes, ids)].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def gather(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of the runs (starts[c], sizes[c]) for all c of codes, one after the other."""
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    return np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Rows (key, ids array<int>, n_pieces long, round_trip boolean): pieces of each text, and whether they decode to it."""
    pieces = df.sparkSession.sparkContext.broadcast(load_pieces(model))

    @steady
    def run(batches):
        encoder = Encoder(pieces.value)
        for batch in slices(batches, text):
            column = batch.column(text)
            ids, sizes = encoder.encode(column)
            ends = np.cumsum(sizes)
            values = column.to_pylist()
            same = [
                None if v is None else encoder.decode(ids[end - size : end]) == v
                for v, size, end in zip(values, sizes.tolist(), ends.tolist())
            ]
            absent = column.is_null()
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, type=pa.int32()), mask=absent),
                    pa.array(sizes, type=pa.int64(), mask=absent.to_numpy(zero_copy_only=False)),
                    pa.array(same, type=pa.bool_()),
                ],
                names=[key, "ids", "n_pieces", "round_trip"],
            )

    schema = f"`{key}` {kind(df, key)}, ids array<int>, n_pieces long, round_trip boolean"
    return shape(df, key, text).mapInArrow(run, schema)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Rows (key, text): the text of each row of ids; null ids give null text, null entries are skipped."""
    pieces = df.sparkSession.sparkContext.broadcast(load_pieces(model))

    @steady
    def run(batches):
        encoder = Encoder(pieces.value)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            out = [
                None if x is None else encoder.decode(np.array([i for i in x if i is not None], dtype=np.int64))
                for x in lists
            ]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, type=pa.string())], names=[key, "text"])

    return shape(df, key, ids).mapInArrow(run, f"`{key}` {kind(df, key)}, text string")
