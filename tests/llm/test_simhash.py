"""Fingerprints and components against plain loops over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from sievework.llm import simhash
from sievework.llm.components import components

from .conftest import ODD


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(pairs, links):
    root = {p: p for p in pairs}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def expected(rows):
    prints = {i: plain_print(t) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4]
    root = plain_roots(prints, links)
    return {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def documents():
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Ünit", " x"]
    rows, number = [], 0
    for group in range(12):
        base = [pick.choice(vocabulary) for _ in range(pick.choice([0, 1, 3, 4, 30, 200]))]
        for _ in range(pick.choice([1, 2, 9])):
            words = list(base)
            for _ in range(pick.choice([0, 0, 1, 2])):
                if words:
                    words[pick.randrange(len(words))] = pick.choice(vocabulary)
            rows.append((number, pick.choice([" ", "\n", "\t "]).join(words)))
            number += 1
    return rows


def test_equals_all_pairs(table):
    rows = documents()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(table(rows)).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
@pytest.mark.parametrize("block", [3, 4096])
def test_links_of_chains_and_hot_groups(spark, segments, block):
    pick = random.Random(segments)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        at = pick.getrandbits(64)
        prints.add(at)
        for _ in range(14):
            near = at
            for bit in pick.sample(range(64), pick.choice([1, 2, 4, 5])):
                near ^= 1 << bit
            prints.add(near)
            at = pick.choice([at, near])
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = components(simhash.near_links(df, 4, block, segments), "a", "b").collect()
    root = {p: p for p in signed} | {r["node"]: r["root"] for r in found}
    mask = (1 << 64) - 1
    links = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & mask).count("1") <= 4]
    assert root == plain_roots(signed, links)


def test_forest_connects_and_is_small():
    left, right = np.array([5, 7, 7, 9, 2]), np.array([7, 5, 9, 5, 3])
    node, root = simhash.forest(left, right)
    assert sorted(zip(node.tolist(), root.tolist())) == [(3, 2), (7, 5), (9, 5)]


def test_odd_rows(odd, nothing):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == len(ODD)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    # null, empty and blank texts all have the fingerprint 0
    assert all(got[i][0]["fingerprint"] == "0" * 16 and got[i][0]["component_id"] == 1 for i in (1, 2, 3, 8))
    assert [r["component_id"] for r in got[5]] == [5, 5]
    assert got[None][0]["component_id"] is None
    assert simhash.simhash_components(nothing).count() == 0
