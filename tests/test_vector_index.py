"""Search over clustered blocks: the rows of a full scan, and blocks that are skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import vector_index as vi
from sievework.operators import vector_search as vs

from .test_operators import brute, vectors_and_queries


def clustered(spark, groups=12, size=150, width=24, queries=40):
    pick = np.random.default_rng(9)
    centres = pick.normal(size=(groups, width))
    rows = []
    for g in range(groups):
        for v in centres[g] + 0.15 * pick.normal(size=(size, width)):
            rows.append((len(rows), "a", v.astype("float32").tolist()))
    # one vector a third of all
    rows += [(len(rows) + i, "a", rows[0][2]) for i in range(groups * size // 2)]
    asked = [(q, "a", (centres[q % groups] + 0.15 * pick.normal(size=width)).astype("float32").tolist(), 5) for q in range(queries)]
    corpus = spark.createDataFrame(rows, "id long, namespace string, embedding array<float>").repartition(6)
    return corpus, spark.createDataFrame(asked, "query_id long, namespace string, query_vector array<float>, k int"), rows, asked


def brute_wide(rows, asked):
    ids, table = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    table /= np.linalg.norm(table, axis=1)[:, None]
    out = {}
    for q, _, v, k in asked:
        scores = np.round(table @ (np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))), 9)
        out[q] = ids[np.lexsort((ids, -scores))[:k]].tolist()
    return out


def hits(found, asked):
    got = {q: [] for q, *_ in asked}
    for r in found.orderBy("query_id", "pos").collect():
        got[r["query_id"]].append(r["id"])
    return got


@pytest.mark.parametrize("scope", ["namespace", None])
@pytest.mark.parametrize("floor", [None, -0.5, 0.2])
@pytest.mark.parametrize("block", [20, 150, 5000])
def test_index_gives_the_rows_of_a_scan(spark, scope, floor, block, tmp_path):
    corpus, queries, raw, asked = vectors_and_queries(spark)
    vs.store_index(corpus, str(tmp_path / "i"), key="id", scope=scope, block=block)
    index = vi.open_index(spark, str(tmp_path / "i"))
    assert index.table.count() == len(raw) and index.blocks.agg(F.sum("n")).first()[0] == len(raw)
    found = vs.match_index(queries, index, key="id", scope=scope, top=4, floor=floor)
    flat = [(q, s if scope else "a", v, 4) for q, s, v, _ in asked]
    want = brute(raw if scope else [(i, "a", v) for i, _, v in raw], flat, floor)
    assert hits(found, asked) == want


def test_most_blocks_are_skipped(spark, monkeypatch):
    corpus, queries, rows, asked = clustered(spark)
    planned, real = [], vi.planned

    def counted(*args):
        out = real(*args)
        planned.append(out.count())
        return out

    monkeypatch.setattr(vi, "planned", counted)
    monkeypatch.setattr(vi, "BLOCK", 60)
    found = vs.match_vectors(queries, corpus, key="id", top=5, floor=None, broadcast_limit=0)
    assert hits(found, asked) == brute_wide(rows, asked)
    blocks = vi.build_index(vs._shape_vectors(corpus, "id", "embedding", "namespace")).blocks.count()
    assert blocks > 40 and len(planned) == 2 and sum(planned) < 0.35 * blocks * len(asked)


def test_queries_in_parts(spark, monkeypatch):
    corpus, queries, rows, asked = clustered(spark, groups=4, size=60)
    monkeypatch.setattr(vi, "QUERY_PART", 7)
    monkeypatch.setattr(vi, "BLOCK", 50)
    found = vs.match_vectors(queries, corpus, key="id", top=5, floor=None, broadcast_limit=0)
    assert hits(found, asked) == brute_wide(rows, asked)


def test_too_many_blocks_fall_back(spark, monkeypatch):
    corpus, queries, raw, asked = vectors_and_queries(spark)
    monkeypatch.setattr(vi, "STATS_ROWS", 1)
    monkeypatch.setattr(vi, "BLOCK", 20)
    found = vs.match_vectors(queries, corpus, key="id", top=F.col("k"), largest=6, floor=0.2, broadcast_limit=0)
    assert hits(found, asked) == brute(raw, asked, 0.2)


def test_odd_vectors_and_empty_tables(spark):
    schema = "id long, namespace string, embedding array<float>"
    queries = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "b", [1.0, 1.0])], "query_id long, namespace string, query_vector array<float>")
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [float("nan"), 1.0]), (3, "a", [1.0, 2.0, 3.0]), (4, "a", None), (5, None, [1.0, 0.0]), (6, "a", [])]
    found = vs.match_vectors(queries, spark.createDataFrame(rows, schema), key="id", top=9, floor=None, broadcast_limit=0)
    near = vs.match_vectors(queries, spark.createDataFrame(rows, schema), key="id", top=9, floor=None)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, near.collect()))
    assert vs.match_vectors(queries, spark.createDataFrame([], schema), key="id", top=2, broadcast_limit=0).count() == 0
