"""Links and components of vectors against a full table of cosines."""

import numpy as np
import pytest

from sievework.llm import embedding_dedup as ed

from .test_simhash import plain_roots


def plain(rows, threshold=0.9):
    good = {}
    for i, (key, v) in enumerate(rows):
        if key is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float64)
    links = []
    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]):
                a, b = good[i] / np.abs(good[i]).max(), good[j] / np.abs(good[j]).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links.append((i, j))
    root = plain_roots(good, links)
    least = {}
    for i in good:
        least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    out = []
    for i, (key, _) in enumerate(rows):
        out.append((key, sum(i in pair for pair in links), least[root[i]] if i in good else key))
    return sorted(out, key=repr)


def made(seed, width=16):
    pick = np.random.default_rng(seed)
    rows = []
    for _ in range(12):
        centre = pick.normal(size=width)
        for _ in range(int(pick.integers(1, 9))):
            rows.append(centre + pick.choice([0.0, 0.05, 0.25, 0.5]) * pick.normal(size=width))
    rows += [rows[0], rows[0], 3 * rows[0], -rows[0], rows[5] * 1e-20]
    vectors = [[float(np.float32(x)) for x in v] for v in rows]
    vectors += [None, [], [0.0] * width, [None] + [1.0] * (width - 1), [float("nan")] * width, [float("inf")] * width, [1.0, 2.0], [2.0, 4.0]]
    keys = pick.permutation(len(vectors)).tolist()
    keys[3] = None
    return [*zip(keys, vectors), (keys[0], vectors[0])]


@pytest.mark.parametrize("tiles", [None, 1, 3])
def test_equals_all_pairs(spark, tiles):
    rows = made(tiles or 9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rep", "2 AS v", "3 AS k", "4 AS root")
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in ed.near_duplicates(df, tiles=tiles).collect()]
    assert sorted(got, key=repr) == plain(rows)


def test_pruned_pairs_are_the_right_ones(monkeypatch):
    pick = np.random.default_rng(1)
    base = ed.units(pick.normal(size=(700, 32)))
    close = ed.units(np.concatenate([base, base[:40] + 0.05 * pick.normal(size=(40, 32))]))
    for many in (0.05, 2.0, -1.0):
        monkeypatch.setattr(ed, "MANY", many)
        found = [np.stack(p[:2], 1) for p in ed.close_pairs(close, close, 0.9, True)]
        i, j = np.nonzero(np.triu(close @ close.T >= 0.9, 1))
        assert {tuple(x) for part in found for x in part.tolist()} >= set(zip(i.tolist(), j.tolist()))


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ed.near_duplicates(df).count() == 0
