"""Token counts by count-only Viterbi.

An Aho-Corasick automaton of the vocabulary lists, for every end in a marked word, the pieces that end there, longest
first. The forward pass keeps the best score and the number of pieces on the path to it, no path; as the longest piece
comes first and only a better sum replaces it, ties fall as in the tokenizer (see pieces.py). Words are counted once per
slice and cached within a bound; a narrow pass without shuffle, linear in the text.

A null text counts null, an empty one 0. A character outside the vocabulary counts one per UTF-8 byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kind, shape, slices, steady
from .pieces import MODEL, Pieces, Tokens, WordCache, load_pieces, word_finder


def automaton(pieces: Pieces):
    import ahocorasick

    built = ahocorasick.Automaton()
    for piece, score in pieces.scores.items():
        built.add_word(piece, (len(piece), score))
    built.make_automaton()
    return built


def count_pieces(word: str, matches, pieces: Pieces) -> int:
    """matches(word) yields (last position, (length, score)) by position, longest first."""
    scores, unknown = pieces.scores, pieces.unknown
    best, counts = [0.0], [0]

    def close(end: int, top, count: int) -> None:
        """Settle one end; a character that is no piece may stand alone."""
        letter = word[end - 1]
        if letter not in scores and (top is None or best[end - 1] + unknown > top):
            top, count = best[end - 1] + unknown, counts[end - 1] + len(letter.encode("utf-8", "replace"))
        best.append(top)
        counts.append(count)

    end, top, count = 1, None, 0
    for last, (length, score) in matches(word):
        while end <= last:
            close(end, top, count)
            end, top, count = end + 1, None, 0
        begin = end - length
        if top is None or best[begin] + score > top:
            top, count = best[begin] + score, counts[begin] + 1
    while end <= len(word):
        close(end, top, count)
        end, top, count = end + 1, None, 0
    return counts[-1]


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Rows (key, n_tokens long): pieces of each text."""
    pieces = df.sparkSession.sparkContext.broadcast(load_pieces(model))

    @steady
    def run(batches):
        vocabulary = pieces.value
        matches, find, cache = automaton(vocabulary).iter, word_finder(vocabulary), WordCache()

        def solve(words):
            return ((word, count_pieces(word, matches, vocabulary)) for word in words)

        for batch in slices(batches, text):
            column = batch.column(text)
            tokens = Tokens(column)
            counts = cache.look_up(tokens.distinct, find, solve, sum)
            totals = tokens.sums(np.array(counts, dtype=np.int64))
            absent = column.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(totals, type=pa.int64(), mask=absent)], names=[key, "n_tokens"]
            )

    return shape(df, key, text).mapInArrow(run, f"`{key}` {kind(df, key)}, n_tokens long")
