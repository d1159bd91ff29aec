"""Language identification, quality grades and language-model scores: plain versions and held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import language_id, lm_scoring, quality

from .conftest import ODD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_path(scores, switch):
    """Best path by trying all changes, ties as documented."""
    value, back = list(scores[0]), []
    for row in scores[1:]:
        best = max(range(len(value)), key=lambda i: (value[i], -i))
        came = [best if value[best] - switch > v else i for i, v in enumerate(value)]
        value = [max(v, value[best] - switch) + s for v, s in zip(value, row)]
        back.append(came)
    label = [max(range(len(value)), key=lambda i: (value[i], -i))]
    for came in back[::-1]:
        label.append(came[label[-1]])
    return label[::-1]


def test_paths_equal_plain_viterbi():
    pick = np.random.default_rng(4)
    counts = np.array([0, 5, 1, 0, 30, 12, 30, 0])
    scores = pick.integers(-6, 1, size=(counts.sum(), 3)).astype(float)
    got = language_id.best_paths(scores, counts, 4.0)
    ends = np.cumsum(counts)
    for count, end in zip(counts, ends):
        if count:
            assert got[end - count : end].tolist() == plain_path(scores[end - count : end].tolist(), 4.0)
    assert len(language_id.best_paths(np.empty((0, 3)), np.array([0, 0]))) == 0


def test_languages_of_held_out_documents(docs):
    held = language_id.held_out(F.col("doc_id"))
    for r in docs.select("doc_id", held.alias("h")).limit(50).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    model = language_id.train(docs.where(~held))
    found = language_id.label_texts(docs.where(held), model).join(docs, "doc_id")
    right, count = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert count > 150 and right / count > 0.97
    assert found.where("score < 0 OR score > 1").count() == 0


def test_mixed_text_falls_into_spans(docs, table):
    model = language_id.train(docs)
    parts = {r["lang"]: " ".join(r["text"].split()[:40]) for r in docs.where("n_chars > 900").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    row = language_id.label_texts(table([(1, parts["de"] + " " + parts["fr"])]), model).first()
    spans = [s for s in row["spans"] if s["end"] - s["start"] > 10]
    assert [s["lang"] for s in spans] == ["de", "fr"]


def test_scripts_narrow_the_candidates(table):
    train = table([(1, "привет мир как дела"), (2, "hello world how are you")]).withColumn(
        "lang", F.when(F.col("doc_id") == 1, "ru").otherwise("en")
    )
    model = language_id.train(train)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.label_texts(table([(1, "xyz"), (2, "юла"), (3, "!! 12"), (4, "—"), (5, None)]), model).collect()}
    assert got == {1: "en", 2: "ru", 3: "und", 4: "und", 5: "und"}


def test_odd_rows_language(odd, nothing, docs):
    model = language_id.train(docs)
    assert language_id.label_texts(odd, model).count() == len(ODD)
    assert language_id.label_texts(nothing, model).count() == 0
    assert language_id.train(nothing.withColumn("lang", F.lit("en"))) is None
    assert {r["lang_pred"] for r in language_id.label_texts(odd, None).collect()} == {"und"}


def test_quality_of_held_out_documents(spark, docs):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    ratings = quality.ratings_from_labels(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    held = F.xxhash64("doc_id") % 4 == 0
    model = quality.fit(docs, ratings.where(~held))
    assert model.thresholds[0] < model.thresholds[1]
    graded = quality.grade_texts(docs, model).join(ratings.where(held), "doc_id").toPandas()
    kept = graded["tail"] >= 0.5
    assert kept[graded.grade == 2].mean() > 0.98
    assert kept[graded.grade == 0].mean() < 0.02
    assert kept[graded.grade == 1].mean() < 0.5
    means = graded.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2]


def test_probabilities_follow_the_link():
    model = quality.Ordinal([0, 1, 2], np.array([-1.0, 2.0]), {})
    grade, tail = model.predict(np.array([0.5]))
    below = [1 / (1 + math.exp(1.5)), 1 / (1 + math.exp(-1.5))]
    assert abs(tail[0] - (1 - below[1])) < 1e-12
    assert abs(grade[0] - ((below[1] - below[0]) + 2 * (1 - below[1]))) < 1e-12


def test_odd_rows_quality(odd, nothing, docs, spark):
    ratings = quality.ratings_from_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    model = quality.fit(docs, ratings)
    assert quality.grade_texts(odd, model).where("tail IS NULL").count() == 0
    assert quality.grade_texts(nothing, model).count() == 0
    assert quality.fit(docs, ratings.limit(0)) is None and quality.fit(nothing, ratings) is None
    assert quality.grade_texts(odd, None).where("tail IS NULL").count() == len(ODD)
    assert quality.select_texts(odd, None).count() == len(ODD)
    assert quality.select_texts(odd, model).columns == odd.columns
    # the same rows give the same model however they are split
    again = quality.fit(docs.repartition(7), ratings)
    assert again.weights == model.weights


def plain_loss(text, counts, smooth=lm_scoring.SMOOTH):
    three, two, one = Counter(), Counter(), Counter()
    for gram, n in counts.items():
        three[gram] += n
        two[gram[1:]] += n
        one[gram[2:]] += n
    context2, context1, total = Counter(), Counter(), sum(one.values())
    for gram, n in three.items():
        context2[gram[:2]] += n
        context1[gram[1:2]] += n
    data = b"\xff\xff" + text.encode() + b"\xff"
    losses = []
    for i in range(len(data) - 2):
        a = data[i : i + 3]
        p1 = (one[a[2:]] + 1) / (total + 256)
        p2 = (two[a[1:]] + smooth * p1) / (context1[a[1:2]] + smooth)
        losses.append(-math.log((three[a] + smooth * p2) / (context2[a[:2]] + smooth)))
    return sum(losses) / len(losses)


def test_losses_equal_plain_models(table, spark):
    texts = {1: "the cat sat", 2: "the dog ünder", 3: "a $$$ b", 4: "", 5: None, 6: "the cat"}
    good = [1, 2]
    grams = {True: Counter(), False: Counter()}
    for i, t in texts.items():
        if t:
            data = b"\xff\xff" + t.encode() + b"\xff"
            for k in range(len(data) - 2):
                grams[False][data[k : k + 3]] += 1
                if i in good:
                    grams[True][data[k : k + 3]] += 1
    keys = spark.createDataFrame([(1,), (2,), (2,), (None,), (99,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(table(texts.items()), keys).collect()}
    for i, t in texts.items():
        if not t:
            assert got[i]["n_tokens"] == 0 and got[i]["difference"] is None
            continue
        assert got[i]["n_tokens"] == len(t.encode()) + 1
        target, background = plain_loss(t, grams[True]), plain_loss(t, grams[False])
        assert abs(got[i]["target_loss"] - target) < 1e-5 and abs(got[i]["background_loss"] - background) < 1e-5
        assert abs(got[i]["difference"] - (target - background)) < 1e-5
    assert got[6]["difference"] < got[3]["difference"]


def test_odd_rows_scoring(odd, nothing, spark):
    keys = spark.createDataFrame([(7,)], "doc_id long")
    assert lm_scoring.cross_entropy_difference(odd, keys).count() == len(ODD)
    assert lm_scoring.cross_entropy_difference(odd, keys.limit(0)).where("difference IS NULL").count() == 2
    assert lm_scoring.cross_entropy_difference(nothing, keys).count() == 0
