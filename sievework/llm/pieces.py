"""A unigram vocabulary read from a SentencePiece model file, and how texts fall apart into marked words.

The file's pieces and scores are used as they stand, nothing is trained. One placeholder is replaced: pieces scored
below -1e8 (runs of spaces in merge-ranked files) rank one behind all others. Best segmentation: highest sum of scores;
a character without a piece of its own costs `unknown`; of equal sums the one whose last piece starts earliest wins, for
every prefix (the public unigram encoder's rule). Sums are exact doubles per word, where that encoder adds 32-bit floats
over a whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"  # stands for a space, and is put before the text
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
PLACEHOLDER = -1e8


@dataclass
class Pieces:
    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    surfaces: list[bytes]  # by id: what a piece is in the text
    unknown_id: int
    unknown: float
    longest: int
    pattern: str  # finds marked words


def load_pieces(path: str = MODEL) -> Pieces:
    """Read a model file on the driver; its size is fixed by the file, so it may be broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, ids, surfaces, byte_ids = {}, {}, [], [model.unk_id()] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_unknown(i):
            surfaces.append(" ⁇ ".encode())
        elif model.is_control(i) or model.is_unused(i):
            surfaces.append(b"")
        elif model.is_byte(i):
            surfaces.append(bytes([int(piece[3:-1], 16)]))
            byte_ids[int(piece[3:-1], 16)] = i
        else:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} reaches over a word's start; words can't be cut apart")
            scores[piece], ids[piece] = float(model.get_score(i)), i
            surfaces.append(piece.replace(MARK, " ").encode())
    lowest = min((x for x in scores.values() if x > PLACEHOLDER), default=0.0)
    scores = {p: x if x > PLACEHOLDER else lowest - 1 for p, x in scores.items()}
    return Pieces(
        scores, ids, byte_ids, surfaces, model.unk_id(), min(scores.values(), default=0.0) - UNKNOWN_PENALTY,
        max(map(len, scores), default=1), word_pattern(scores),
    )


def word_pattern(scores) -> str:
    """Pattern of marked words: marks, then letters of one kind.

    Characters are of one kind if they stand side by side in a piece, directly or by way of others. No piece reaches
    over a change of kind, so words are segmented one by one. A character of no piece is a word of its own.
    """
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for piece in scores:
        letters = piece.lstrip(MARK)
        for left, right in zip(letters, letters[1:]):
            parent[root(left)] = root(right)
        if piece != letters:
            root(letters[:1] or MARK)
    kinds: dict[str, list[str]] = {}
    for c in sorted(parent):
        if c != MARK:
            kinds.setdefault(root(c), []).append(c)
    largest = sorted(kinds.values(), key=len, reverse=True)
    runs = [f"{MARK}*[{''.join(map(re.escape, k))}]+" for k in largest]
    return "(?s:" + "|".join([*runs, f"{MARK}+", "."]) + ")"


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def word_finder(pieces: Pieces):
    """Function from a marked text to its marked words."""
    return re.compile(pieces.pattern).findall


class Tokens:
    """The space-separated tokens of some texts, each distinct one once.

    codes: for each token its place in distinct; sizes: tokens per text. A token stands for itself behind one mark.
    """

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "")
        odd = pc.or_(pc.or_(pc.match_substring(column, "  "), pc.starts_with(column, " ")), pc.match_substring(column, MARK))
        # runs of spaces belong to the word behind them: such texts are cut by pattern
        lists = pc.split_pattern(pc.if_else(odd, "", column), " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # splitting an empty text gives one empty token
        sizes[pc.or_(odd, pc.equal(column, "")).to_numpy(zero_copy_only=False)] = 0
        keep = np.repeat(sizes > 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        encoded = pc.dictionary_encode(lists.flatten().filter(pa.array(keep)))
        self.distinct: list[str] = encoded.dictionary.to_pylist()
        plain = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        places = {}
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rows):
            places = {t: i for i, t in enumerate(self.distinct)}
            found = {}
            for row in rows.tolist():
                of = [u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", marked(column[row].as_py()))]
                found[row] = np.array([places.setdefault(t, len(places)) for t in of], dtype=np.int64)
            self.distinct = list(places)
            starts = np.cumsum(sizes) - sizes
            parts, last = [], 0
            for row, codes in found.items():
                parts += [plain[last : starts[row]], codes]
                last, sizes[row] = starts[row], len(codes)
            plain = np.concatenate([*parts, plain[last:]])
        self.codes, self.sizes = plain, sizes

    def sums(self, by_distinct: np.ndarray) -> np.ndarray:
        """Per text, the sum of a number per token."""
        total = np.concatenate([[0], np.cumsum(by_distinct[self.codes] if len(self.codes) else [], dtype=np.int64)])
        ends = np.cumsum(self.sizes)
        return total[ends] - total[ends - self.sizes]


class WordCache:
    """What is known of words and tokens, kept from slice to slice up to a number of bytes."""

    def __init__(self, limit: int = 192 << 20):
        self.words, self.tokens, self.held, self.limit = {}, {}, 0, limit

    def begin(self) -> None:
        if self.held > self.limit:
            self.words, self.tokens, self.held = {}, {}, 0

    def look_up(self, tokens: list[str], find, solve, join) -> list:
        """Values of tokens: find cuts a marked token into words, solve yields (word, value) for sorted new words."""
        self.begin()
        known, words = self.tokens, self.words
        new = [t for t in tokens if t not in known]
        cut = [find(MARK + t) for t in new]
        for word, value in solve(sorted({w for of in cut for w in of}.difference(words))):
            words[word] = value
            self.held += 2 * len(word) + 160
        for token, of in zip(new, cut):
            known[token] = words[of[0]] if len(of) == 1 else join([words[w] for w in of])
            self.held += 6 * len(token) + 160
        return [known[t] for t in tokens]
