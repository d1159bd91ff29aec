"""Items found in texts against a plain edit-distance table over words."""

import random

from sievework.llm import decontamination as dc

from .conftest import LONG, ODD


def plain_distance(item, text):
    """Least edits of the item against any run of words."""
    row = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        new = [i]
        for j, other in enumerate(text, 1):
            new.append(min(row[j - 1] + (word != other), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_equals_plain_search(table, spark):
    pick = random.Random(5)
    vocabulary = [f"v{i}" for i in range(25)]
    items = [(i, [pick.choice(vocabulary) for _ in range(pick.choice([3, 5, 9, 17, 40, 70]))]) for i in range(14)]
    texts = []
    for _ in range(60):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(0, 60))]
        for _ in range(pick.choice([0, 1, 2])):
            part = list(pick.choice(items)[1])
            for _ in range(pick.choice([0, 1, 3, 8])):
                at = pick.randrange(len(part)) if part else 0
                change = pick.random()
                part[at : at + 1] = [] if change < 0.3 else [pick.choice(vocabulary)] * (1 if change < 0.7 else 2)
                if not part:
                    break
            at = pick.randint(0, len(words))
            words[at:at] = part
        texts.append(words)
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items], "item_id long, text string")
    docs = table((i, ", ".join(w)) for i, w in enumerate(texts))
    found = dc.find_items(docs, bench).collect()
    want = {}
    for d, text in enumerate(texts):
        for i, item in items:
            if len(item) >= dc.SHORTEST and (edits := plain_distance(item, text)) <= int(dc.RATE * len(item)):
                want[d, i] = edits
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in found} == want
    by_id = dict(items)
    for r in found:
        part = texts[r["doc_id"]][r["first_word"] : r["end_word"]]
        assert plain_distance(by_id[r["item_id"]], part) == r["edits"]
        assert abs(len(part) - r["item_words"]) <= r["edits"]
    clean = {r["doc_id"] for r in dc.without_items(docs, bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in want}
    # several blocks of items give the same
    limit = 200
    blocks = list(dc.item_blocks(bench, "item_id", "text", limit))
    assert len(blocks) > 1 and sorted(i for b in blocks for i, _ in b) == [i for i, _ in items]


def test_odd_rows(odd, nothing, spark):
    bench = spark.createDataFrame(
        [(1, None), (2, ""), (3, "short one"), (4, "same text here now and more"), (None, "word " * 7), (6, "never seen " * 5)],
        "item_id long, text string",
    )
    rows = dc.find_items(odd, bench).collect()
    # the item without a key is found in the text of repeated words
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(4, None)]
    assert rows[0]["first_word"] == 0 and len(LONG) > 200000
    kept = dc.without_items(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert dc.find_items(nothing, bench).count() == 0
    assert dc.find_items(odd, bench.limit(0)).count() == 0
    assert dc.without_items(odd, bench.limit(0)).count() == len(ODD)
