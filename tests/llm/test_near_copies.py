"""Links by exact five-word shingle similarity against a plain comparison of all pairs."""

import random

import corpus_pipeline as cp
import numpy as np

from sievework.llm import near_copies, simhash

from .test_simhash import plain_roots


def plain_links(rows):
    sets = {i: near_copies.shingle_set(t) for i, t in rows}
    links = []
    for a in sets:
        for b in sets:
            common = len(np.intersect1d(sets[a], sets[b]))
            union = len(sets[a]) + len(sets[b]) - common
            if a < b and (not union or common >= 0.8 * union):
                links.append((a, b))
    return links


def edited(seed, groups=20, size=6):
    pick, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{pick.randrange(5000)}" for _ in range(pick.choice([60, 150, 300]))]
        for _ in range(size):
            words = list(base)
            for _ in range(pick.randrange(0, max(2, len(words) // 60))):
                words[pick.randrange(len(words))] = f"x{pick.randrange(10**6)}"
            out.append((len(out), " ".join(words)))
    return out


def test_near_copies_beyond_four_bits_go(spark, table):
    rows = edited(1)
    links = plain_links(rows)
    prints = {i: simhash.majority([simhash.shingle_hashes(t)])[0] for i, t in rows}
    assert sum(int(np.bitwise_count(prints[a] ^ prints[b])) > 4 for a, b in links) > 50
    root = plain_roots([i for i, _ in rows], links)
    kept = sorted(r["doc_id"] for r in cp.drop_near_copies(spark, table(rows), "").select("doc_id").collect())
    assert kept == sorted(set(root.values()))


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda i: (i is None, i))


def test_components_equal_the_plain_comparison(spark, table):
    rows = edited(2, groups=15, size=9) + [(1000 + i, t) for i, t in enumerate(["", None, " ", "one", "one", "ONE", "two words", "a b c d e"])]
    rows += [(2000 + i, "shared passage of words that many texts hold in common " * 2 + " ".join(f"y{i}x{k}" for k in range(40))) for i in range(30)]
    plain = [(i, t or "") for i, t in rows]
    root = plain_roots([i for i, _ in plain], plain_links(plain))
    got = {r["doc_id"]: r["component"] for r in near_copies.near_copy_components(table(rows)).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        for j, _ in rows:
            assert (root[i] == root[j]) == (got[i] == got[j]), (i, j)


def test_tiles_alone_find_all_links(spark, table, monkeypatch):
    # no pivots, several tiles a list
    monkeypatch.setattr(near_copies, "ROUNDS", 0)
    monkeypatch.setattr(near_copies, "TILE", 400)
    rows = edited(3, groups=10, size=8)
    root = plain_roots([i for i, _ in rows], plain_links(rows))
    got = {r["doc_id"]: r["component"] for r in near_copies.near_copy_components(table(rows)).collect()}
    for i, _ in rows:
        for j, _ in rows:
            assert (root[i] == root[j]) == (got[i] == got[j]), (i, j)


def test_tile_links_equal_plain_pairs():
    pick = np.random.default_rng(7)
    sets = [np.unique(pick.choice(40, size=pick.integers(1, 40))) for _ in range(60)]
    sets += [np.unique(np.concatenate([x, pick.choice(40, size=2)])) for x in sets[:30]]
    tids, roots = np.arange(len(sets)), np.arange(len(sets))
    roots[5] = 3
    near = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    ]
    links = near_copies.tile_links(tids, roots, sets)
    assert {(max(x), min(x)) for x in links} <= set(near)
    ids = tids.tolist()
    assert plain_roots(ids, [*links, (5, 3)]) == plain_roots(ids, [*near, (5, 3)])


def test_sketches_differ_by_dissimilarity():
    pick = np.random.default_rng(8)
    for common, own in ((800, 100), (300, 350)):
        pool = pick.integers(1, 1 << 63, size=common + 2 * own).astype(np.uint64)
        x, y = pool[: common + own], np.concatenate([pool[:common], pool[common + own :]])
        bits = sum((a ^ b).bit_count() if a >= 0 and b >= 0 else ((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(near_copies.sketch(x), near_copies.sketch(y)))
        apart = 1 - common / (common + 2 * own)
        assert abs(bits - near_copies.PLACES * apart / 2) < 60
        assert (bits <= near_copies.UNLIKE) == (apart <= 0.2)


def test_a_large_group_needs_few_comparisons(spark, table, monkeypatch):
    pick = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        # every text is near the base, few are near each other: no pivot alone links them all
        for at in pick.sample(range(0, 120, 10), 2):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows.append((150, " ".join(base)))
    asked = []
    real = near_copies.verified

    def counted(held, pairs):
        asked.append(pairs.select("a", "b").distinct().count())
        return real(held, pairs)

    monkeypatch.setattr(near_copies, "verified", counted)
    assert ids(cp.drop_near_copies(spark, table(rows), "")) == [0]
    # in the number of texts: all pairs grow with its square
    assert sum(asked) < (2 * near_copies.ROUNDS * near_copies.PIVOTS + 4) * len(rows)


def test_shared_shingles_make_rows_in_proportion(spark, monkeypatch):
    def halves(pairs):
        # two texts that share all shingles but one lie in different slices
        base = [" ".join(f"w{i}x{j}" for j in range(150)) for i in range(pairs)]
        rows = list(enumerate(base + [t + " tail" for t in base]))
        return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "tid long, text string")

    held, met = [halves(10), halves(200)], []
    whole = type(held[0]).mapInArrow

    def kept(self, func, *given, **named):
        out = whole(self, func, *given, **named)
        if func.__name__ == "meet":
            met.append(out)
        return out

    monkeypatch.setattr(type(held[0]), "mapInArrow", kept)
    for pairs, df in zip((10, 200), held):
        assert {tuple(r) for r in near_copies.shared_shingles(df).collect()} == {(i, 146) for i in range(2 * pairs)}
    small, large = (df.count() for df in met)
    assert 0 < large <= 20 * small


def test_rows_that_share_an_id(spark, table):
    pick = random.Random(6)
    long = lambda s: " ".join(f"{s}{pick.randrange(10**6)}" for _ in range(80))
    a, b, c = long("a"), long("b"), long("c")
    rows = [(5, a), (5, b), (5, b), (7, a), (8, c), (8, c + " end"), (9, b), (None, a), (None, a)]
    out = cp.drop_near_copies(spark, table(rows), "")
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    kept_c = [t for i, t in got if i == 8]
    assert len(kept_c) == 1 and kept_c[0] in (c, c + " end")
    assert sorted([g for g in got if g[0] != 8], key=repr) == sorted([(5, a), (5, b), (None, a), (None, a)], key=repr)


def test_odd_rows(odd, nothing):
    got = near_copies.near_copy_components(odd)
    assert got.count() == 10 and got.where("component IS NULL").count() == 0
    assert near_copies.near_copy_components(nothing).count() == 0
