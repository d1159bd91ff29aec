"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(t_j - w.x), with one weight vector w for all grades and ordered thresholds t. x marks which hashed
words, beginnings of words and sign runs a text holds, and a few shape features (shares of capitals and signs, repetition, lengths) by steps.
From the grades follow the expected grade and the tail probability of the top grade, by which texts are selected.

The model is fitted on a bounded sample: the `sample` labelled rows with the smallest hash of their key (SAMPLE by
default). Kept are features in at least MIN_COUNT rows whose presence goes with a grade by more than CERTAIN standard
deviations. Scoring reads every whole text once, without shuffle; the broadcast model has at most BUCKETS weights.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, named, rows, shape, slices, steady, texts

SAMPLE = 8192
BUCKETS = 1 << 22
MIN_COUNT = 5
CERTAIN = 6.0
RIDGE = 1e-4
STRONG = 30.0
STEPS = 300
RATE = 0.1
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


def step(value: float, edges: tuple[float, ...]) -> int:
    return sum(value > e for e in edges)


STEMS = (4, 5, 6)
CACHED = 400_000
SHARES = (0.01, 0.03, 0.06, 0.1, 0.2, 0.4)
SIZES = (5, 20, 80, 320, 1280, 5120)


def word_buckets(word: str) -> list[int]:
    """Buckets of a word (or sign run) and of its beginnings, which stand for words that appear in many inflected forms."""
    crc, found = zlib.crc32, [zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS]
    if len(word) > 3:
        found += [crc(f"{word[:size]}\x00".encode("utf-8", "replace")) % BUCKETS for size in STEMS if size <= len(word)]
    return found


def shape_buckets(text: str) -> list[int]:
    tokens, lines = text.split(), text.split("\n")
    n = len(tokens) or 1
    capitals = sum(t.isupper() and len(t) > 1 for t in tokens) / n
    odd = sum(not t[-1].isalnum() and t[-1] not in ".,;:?)\"'" for t in tokens) / n
    repeats = 1 - len(set(lines)) / len(lines)
    alike = 1 - len(set(tokens)) / n
    names = (
        f"\x00caps{step(capitals, SHARES)}", f"\x00odd{step(odd, SHARES)}", f"\x00lines{step(repeats, SHARES)}",
        f"\x00alike{step(alike, SHARES)}", f"\x00size{step(n, SIZES)}",
    )
    return [zlib.crc32(t.encode()) % BUCKETS for t in names]


class Features:
    """Sorted distinct buckets of texts. With `known`, only those it holds; what a word gives is kept up to CACHED words."""

    def __init__(self, known=None):
        self.known, self.of_word = known, {}

    def __call__(self, text: str) -> list[int]:
        found, known, of_word = set(), self.known, self.of_word
        if len(of_word) > CACHED:
            of_word.clear()
        for word in set(TOKEN.findall(text.lower())):
            own = of_word.get(word)
            if own is None:
                own = of_word[word] = tuple(b for b in word_buckets(word) if known is None or b in known)
            if own:
                found.update(own)
        found.update(b for b in shape_buckets(text) if known is None or b in known)
        return sorted(found)


def features(text: str) -> list[int]:
    return Features()(text)


@dataclass
class Ordinal:
    grades: list[int]
    thresholds: np.ndarray  # ascending, one fewer than grades
    weights: dict[int, float]  # by bucket

    def predict(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of the top grade)."""
        below = sigmoid(self.thresholds[None, :] - scores[:, None])
        edges = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1)
        return np.diff(edges, axis=1) @ np.array(self.grades, dtype=float), 1 - edges[:, -2]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit_ordinal(ids: np.ndarray, sizes: np.ndarray, grades: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> Ordinal:
    """Fit by Adam on all rows at once; ids are the buckets of all rows, sizes how many belong to each."""
    levels = sorted(set(grades.tolist()))
    codes = np.searchsorted(levels, grades)
    n, k = len(codes), len(levels)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    # only features that go with some grade beyond chance; the others would learn single rows by heart
    seen = np.bincount(ids, minlength=BUCKETS)
    strength = np.zeros(BUCKETS)
    for code in range(k):
        share = (codes == code).mean()
        with_it = np.bincount(ids[(codes == code)[row]], minlength=BUCKETS)
        spread = np.sqrt(seen * (1 - seen / n) * share * (1 - share) + 1e-9)
        np.maximum(strength, np.abs(with_it - seen * share) / spread, out=strength)
    kept = np.flatnonzero((strength > CERTAIN) & (seen >= MIN_COUNT))
    # the less a feature tells, the more its weight is held down
    penalty = ridge * (STRONG / strength[kept]) ** 2
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    column = place[ids]
    row, column = row[column >= 0], column[column >= 0]
    shares = np.bincount(codes, minlength=k) / n
    cumulative = np.cumsum(shares)[:-1]
    first = np.log(cumulative / (1 - cumulative))
    # thresholds as a start and positive gaps keep their order
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3)), np.zeros(len(kept))])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        cuts = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1 : k - 1]))]) if k > 1 else np.empty(0)
        w = theta[k - 1 :]
        score = np.bincount(row, weights=w[column], minlength=n)
        edges = np.concatenate([[-50.0], cuts, [50.0]])
        high, low = sigmoid(edges[codes + 1] - score), sigmoid(edges[codes] - score)
        gap = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / gap, low * (1 - low) / gap
        by_cut = np.array([(d_low[codes == j + 1].sum() - d_high[codes == j].sum()) / n for j in range(k - 1)])
        gaps = np.exp(theta[1 : k - 1])
        tail = np.cumsum(by_cut[::-1])[::-1]
        g_w = np.bincount(column, weights=(d_high - d_low)[row], minlength=len(kept)) / n + penalty * w
        gradient = np.concatenate([tail[:1], tail[1:] * gaps, g_w])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta = theta - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    cuts = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1 : k - 1]))])
    return Ordinal(levels, cuts, dict(zip(kept.tolist(), theta[k - 1 :].tolist())))


def fit(
    df: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE
) -> Ordinal | None:
    """Model of whole-number grades by key, from at most `sample` rated rows; None if fewer than two grades are rated.

    Ratings with null key or grade are left out; a key rated twice counts twice.
    """
    rated = shape(ratings, key, grade).where(named(key).isNotNull() & named(grade).isNotNull()).toDF("rated", "grade")
    chosen = rated.orderBy(F.xxhash64("rated"), "rated", "grade").limit(sample)
    rows_ = shape(df, key, text).toDF("own", "text").join(F.broadcast(chosen), F.col("own") == F.col("rated"))

    @steady
    def run(batches):
        features_of = Features()
        for batch in slices(batches, "text"):
            found = [features_of(t) for t in texts(batch, "text")]
            yield rows(own=batch.column("own"), grade=batch.column("grade").cast(pa.int64()), ids=pa.array(found, type=pa.list_(pa.int32())))

    shaped = rows_.select("own", F.col("grade").cast("long").alias("grade"), "text")
    table = shaped.mapInArrow(run, f"own {kind(rows_, 'own')}, grade long, ids array<int>").toArrow().combine_chunks()
    grades = table.column("grade").to_numpy()
    if len(set(grades.tolist())) < 2:
        return None
    lists = table.column("ids").combine_chunks()
    # a fixed order of rows makes sums, and so the model, the same on every run
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy()
    sums = np.add.reduceat(flat.astype(np.int64), np.cumsum(sizes) - sizes)
    order = np.lexsort((sums, sizes, grades, np.array([hash_text(v) for v in table.column("own").to_pylist()])))
    ends = np.cumsum(sizes)
    ids = np.concatenate([flat[ends[i] - sizes[i] : ends[i]] for i in order.tolist()])
    return fit_ordinal(ids, sizes[order], grades[order])


def hash_text(value) -> int:
    return zlib.crc32(str(value).encode())


def grade_texts(df: DataFrame, model: Ordinal | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, expected_grade double, tail double): tail is the probability of the top grade.

    Null text is read as empty, which has shape features only. Without a model both are null.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @steady
    def run(batches):
        predict = predictor(shared.value)
        for batch in slices(batches, text):
            grade, tail = predict(texts(batch, text))
            yield rows(**{key: batch.column(key), "expected_grade": grade, "tail": tail})

    return shape(df, key, text).mapInArrow(run, f"`{key}` {kind(df, key)}, expected_grade double, tail double")


def predictor(model: Ordinal | None):
    """Function from texts to their (expected grades, probabilities of the top grade); nulls without a model."""
    if model is None:
        return lambda found: (pa.nulls(len(found), pa.float64()),) * 2
    features_of, weights = Features(model.weights), model.weights

    def predict(found: list[str]) -> tuple[pa.Array, pa.Array]:
        grade, tail = model.predict(np.array([sum([weights[b] for b in features_of(t)]) for t in found], dtype=float))
        return pa.array(grade), pa.array(tail)

    return predict


def select_texts(df: DataFrame, model: Ordinal | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df whose top grade has probability `least` or more, columns as they were; all rows without a model."""
    if model is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)

    @steady
    def run(batches):
        predict = predictor(shared.value)
        for batch in slices(batches, text):
            _, tail = predict(texts(batch, text))
            yield batch.filter(pa.array(tail.to_numpy() >= least))

    return df.mapInArrow(run, df.schema)


def ratings_from_labels(labels: DataFrame) -> DataFrame:
    """Graded ratings of the label table: 0 low quality, 1 sound but toxic, 2 sound and clean. Null labels give null."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))
