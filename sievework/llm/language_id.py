"""Language identification: script ranges narrow the candidates, Viterbi over words labels spans.

A word is a run of ASCII letters and bytes from 0x80 on (text in lower case, UTF-8). A language scores a word by the sum over its
bytes of log P(byte with its two neighbours | language), on BUCKETS hashed triples with add-ALPHA smoothing; only languages seen in
the word's script with at least SCRIPT_SHARE of their words are candidates. The best path over a text's words pays SWITCH
for each change of language, so spans of mixed texts come out; the language with most words is the text's.

Counts for the model are taken over all training texts in the tasks and added up by Spark; the model is bounded by
languages x BUCKETS numbers. Prediction is one narrow pass without shuffle that uses the text only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind, named, rows, shape, slices, steady, texts

BUCKETS = 1 << 15
ALPHA = 0.1
SWITCH = 8.0
SCRIPT_SHARE = 0.001
UNKNOWN = "und"

# Scripts by the first byte of a letter's UTF-8 form (first, last, script); ASCII letters are Latin.
LATIN, GREEK, CYRILLIC, HEBREW, ARABIC, INDIC, ASIAN, HANGUL, OTHER = range(9)
LEADS = (
    (0xC3, 0xCA, LATIN), (0xCD, 0xCF, GREEK), (0xD0, 0xD4, CYRILLIC), (0xD6, 0xD7, HEBREW), (0xD8, 0xDD, ARABIC),
    (0xE0, 0xE0, INDIC), (0xE1, 0xE2, OTHER), (0xE3, 0xE9, ASIAN), (0xEA, 0xED, HANGUL), (0xEE, 0xF4, OTHER),
)
SCRIPTS = 9
SCRIPT_OF = np.zeros(256, dtype=np.int8)
for low, high, script in LEADS:
    SCRIPT_OF[low : high + 1] = script
LETTER = np.zeros(256, dtype=bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[0x80:] = True


class Words:
    """Words of some texts: hashed triple per letter byte, first letter and script of each word, words per text."""

    def __init__(self, found: list[str]):
        # a space before, between and behind texts keeps words apart
        parts = [t.lower().encode("utf-8", "replace") for t in found]
        data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
        letter = LETTER[data]
        clean = np.where(letter, data, 0x20).astype(np.uint32)
        at = np.flatnonzero(letter)
        triple = (clean[at - 1] << np.uint32(16)) | (clean[at] << np.uint32(8)) | clean[at + 1]
        self.bucket = ((triple * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
        begins = ~letter[at - 1]
        self.first = np.flatnonzero(begins)  # place of a word's first letter among letters
        self.script = np.maximum.reduceat(SCRIPT_OF[data[at]], self.first) if len(at) else np.empty(0, dtype=np.int8)
        ends = np.cumsum([len(p) + 1 for p in parts]) + 1
        self.counts = np.diff(np.searchsorted(at[self.first], ends), prepend=0) if parts else np.empty(0, dtype=np.int64)


@dataclass
class Languages:
    names: list[str]
    log_p: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages

    def scores(self, words: Words) -> np.ndarray:
        """Words x languages; languages that a word's script rules out are far below the others."""
        if not len(words.first):
            return np.empty((0, len(self.names)))
        total = np.add.reduceat(self.log_p[words.bucket], words.first, axis=0, dtype=np.float64)
        allowed = self.allowed[words.script]
        none = ~allowed.any(axis=1, keepdims=True)
        return np.where(allowed | none, total, total - 1e4)


def best_paths(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language number of every word. All texts advance together, longest first, one word a step; of equal ways a path
    stays, then takes the first language."""
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    starts = (np.cumsum(counts) - counts)[order]
    label = np.zeros(len(scores), dtype=np.int64)
    if not len(scores):
        return label
    came = np.zeros(len(scores), dtype=np.int64)  # best language before the word
    moved = np.zeros(scores.shape, dtype=bool)
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    value = scores[starts[: alive[0]]]
    last = np.zeros(len(counts), dtype=np.int64)
    for t in range(1, lengths[0]):
        ended = slice(alive[t], len(value))
        last[ended] = value[ended].argmax(axis=1)
        value = value[: alive[t]]
        at = starts[: alive[t]] + t
        best = value.argmax(axis=1)
        jump = value[np.arange(len(value)), best][:, None] - switch
        came[at], moved[at] = best, jump > value
        value = np.maximum(value, jump) + scores[at]
    last[: len(value)] = value.argmax(axis=1)
    for t in range(lengths[0] - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        label[at] = last[:n]
        last[:n] = np.where(moved[at, last[:n]], came[at], last[:n])
    return label


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Languages | None:
    """Model of the languages of df; rows with null language or text, or without words, teach nothing. None if none do."""

    @steady
    def run(batches):
        for batch in slices(batches, "t"):
            langs = np.array(batch.column("l").to_pylist(), dtype=object)
            found = np.array(texts(batch, "t"), dtype=object)
            for name in sorted(set(langs.tolist())):
                words = Words(found[langs == name].tolist())
                triples = np.bincount(words.bucket, minlength=BUCKETS)
                scripts = np.bincount(words.script, minlength=SCRIPTS)
                numbers = np.concatenate([triples, scripts])
                place = np.flatnonzero(numbers)
                yield rows(l=pa.array([name] * len(place), type=pa.string()), place=place, n=numbers[place])

    given = df.select(named(lang).cast("string").alias("l"), named(text).alias("t")).where("l IS NOT NULL AND t IS NOT NULL")
    counted = given.mapInArrow(run, "l string, place long, n long").groupBy("l", "place").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    names = sorted(set(table.column("l").to_pylist()))
    if not names:
        return None
    counts = np.zeros((BUCKETS + SCRIPTS, len(names)))
    of = {n: i for i, n in enumerate(names)}
    counts[table.column("place").to_numpy(), [of[n] for n in table.column("l").to_pylist()]] = table.column("n").to_numpy()
    triples, scripts = counts[:BUCKETS], counts[BUCKETS:]
    log_p = np.log(triples + ALPHA) - np.log(triples.sum(axis=0) + ALPHA * BUCKETS)
    return Languages(names, log_p.astype(np.float32), scripts >= SCRIPT_SHARE * scripts.sum(axis=0))


def spans_of(label: np.ndarray) -> list[tuple[int, int, int]]:
    """(language, first word, end word) of runs of equal labels."""
    cuts = np.flatnonzero(np.diff(label, prepend=-1))
    return list(zip(label[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(label)]))


def label_texts(df: DataFrame, model: Languages | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred string, score double, spans): spans are (lang, start, end) in words, score the share of words.

    `und` with score 0 and no spans if the text is null or has no letter, or nothing was learned. Of languages with equally
    many words the first in order of name is taken.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @steady
    def run(batches):
        known = shared.value
        for batch in slices(batches, text):
            # text without any letter has no words either
            found = [t if any(c.isalpha() for c in t) else "" for t in texts(batch, text)]
            names, shares, spans = [], [], []
            if known is None:
                names, shares, spans = [UNKNOWN] * len(found), [0.0] * len(found), [[]] * len(found)
            else:
                words = Words(found)
                labels = best_paths(known.scores(words), words.counts)
                end = 0
                for count in words.counts.tolist():
                    own = labels[end : end + count]
                    end += count
                    if not count:
                        names.append(UNKNOWN), shares.append(0.0), spans.append([])
                        continue
                    votes = np.bincount(own, minlength=len(known.names))
                    best = int(votes.argmax())
                    names.append(known.names[best])
                    shares.append(float(votes[best] / count))
                    spans.append([{"lang": known.names[i], "start": a, "end": b} for i, a, b in spans_of(own)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(names, type=pa.string()), pa.array(shares, type=pa.float64()), pa.array(spans, type=span_type)],
                names=[key, "lang_pred", "score", "spans"],
            )

    return shape(df, key, text).mapInArrow(
        run, f"`{key}` {kind(df, key)}, lang_pred string, score double, spans array<struct<lang: string, start: long, end: long>>"
    )


def held_out(key: Column) -> Column:
    """Documents kept from training: crc32 of the key as text leaves 2 when divided by 4; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
