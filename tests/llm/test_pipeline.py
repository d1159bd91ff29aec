"""Stages against plain versions, and the whole pipeline on the smallest tables."""

import corpus_pipeline as cp
import pytest

from sievework.llm import decontamination, pii, quality
from sievework.llm.catalog import ORACLES, QUERIES

from tests.compare import check, connect

from .conftest import ODD
from .test_decontamination import plain_distance
from .test_near_copies import plain_links
from .test_pii import plain as plain_spans
from .test_simhash import plain_roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_equal_plain_versions(spark, docs):
    now = docs
    after = cp.keep_quality(spark, now, SF)
    model = quality.fit(now, quality.ratings_from_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    assert ids(after) == ids(quality.grade_texts(now, model).where("tail >= 0.5"))
    assert after.columns == docs.columns

    now, rows = after, [(r["doc_id"], r["text"]) for r in after.collect()]
    after = cp.drop_near_copies(spark, now, SF)
    root = plain_roots([i for i, _ in rows], plain_links(rows))
    assert ids(after) == sorted(set(root.values()))
    assert after.columns == docs.columns

    now, rows = after, [(r["doc_id"], r["text"]) for r in after.collect()]
    after = cp.drop_benchmark_passages(spark, now, SF)
    items = [decontamination.words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # a plain table of edits only where many words are shared; elsewhere the item can't be there
    dirty = set()
    for i, t in rows:
        words = decontamination.words(t)
        held = set(words)
        for item in items:
            if sum(w in held for w in item) >= len(item) - int(0.2 * len(item)) and plain_distance(item, words) <= int(0.2 * len(item)):
                dirty.add(i)
    assert ids(after) == sorted({i for i, _ in rows} - dirty)

    now, rows = after, {r["doc_id"]: r["text"] for r in after.collect()}
    after = cp.mask_personal_data(spark, now, SF)
    assert ids(after) == sorted(rows) and after.columns == docs.columns
    automaton = pii.anchors()
    for r in after.collect():
        assert not plain_spans(r["text"]) or rows[r["doc_id"]] != r["text"]
        assert r["text"] == pii.masked(rows[r["doc_id"]], pii.find_spans(rows[r["doc_id"]], automaton))
        assert r["n_chars"] == len(r["text"])

    last = cp.encode_pieces(spark, after, SF)
    assert ids(last) == ids(after) and last.where("NOT round_trip").count() == 0


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "pii", "sentencepiece"]
    got = cp.run(spark, SF)
    assert 0 < got.count() < 200 and got.select("doc_id").distinct().count() == got.count()


def test_stages_on_odd_rows(spark, odd, nothing):
    for df in (odd, nothing):
        for name, stage in cp.STAGES:
            out = stage(spark, df, SF)
            if name != "sentencepiece":
                assert out.columns == df.columns
            assert out.count() <= df.count()
    # a repeated row stays once, rows without a key stay
    kept = cp.drop_near_copies(spark, odd, SF).groupBy("doc_id").count().collect()
    got = {r["doc_id"]: r["count"] for r in kept}
    assert got[5] == 1 and got[None] == 1 and got[1] == 1 and 2 not in got


def test_queries_run_on_whole_tables(spark):
    for name, build in QUERIES.items():
        df = build(spark, SF)
        n = df.count()
        if name == "op3_decontamination":
            assert n > 0
        else:
            assert n == {"op4": 500, "op11": 2000, "op12": 100}.get(name.split("_")[0], 200)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    for folder in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{folder}"
        *_, problem, wrong_types = check(spark, connect(path), name, QUERIES[name], ORACLES[name], path)
        assert problem is None and not wrong_types


def test_queries_have_one_number_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
