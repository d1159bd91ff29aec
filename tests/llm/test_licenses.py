"""Phrases and template blocks against plain loops over every block."""

import random
import re

from sievework.llm import license_scan as ls

from .conftest import LONG, ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text):
    words = plain_words(text)
    places = [(i, label) for phrase, label in ls.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    shares = {}
    for label, template in ls.TEMPLATES.items():
        wanted, m = set(plain_words(template)), len(plain_words(template))
        best = max((len(wanted & set(words[s : s + 2 * m])) / len(wanted) for s in range(len(words))), default=0)
        if best >= ls.LEAST:
            shares[label] = best
    starts = [p for p, _ in places]
    base = sorted({label for _, label in places})
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
        ",".join(sorted({*base, *shares})), 1.0 if places else max(shares.values(), default=0.0),
    )


def report(df):
    names = "n_words n_base first_word last_word base_labels labels score".split()
    return {r["doc_id"]: tuple(r[n] for n in names) for r in ls.license_report(df).collect()}


def test_equals_plain_search(table):
    pick = random.Random(2)
    filler = ["mit", "License", "the", "of", "gnu", "Ärger", "x9", "apache", "general", "PUBLIC", "license!", "a-b", "licensed"]
    texts = ["MIT License", "mit-license mit license", "İmit license", "General\nPublic LICENSE general public license"]
    for _ in range(150):
        words = [pick.choice(filler) for _ in range(pick.randint(0, 40))]
        for _ in range(pick.choice([0, 1, 2])):
            part = pick.choice([*ls.TEMPLATES.values(), *ls.PHRASES]).split()
            part = [w for w in part if pick.random() > 0.08]
            at = pick.randint(0, len(words))
            words[at:at] = part
        texts.append(" ".join(words))
    got = report(table(enumerate(texts)))
    for i, text in enumerate(texts):
        want = plain(text)
        assert got[i][:-1] == want[:-1] and abs(got[i][-1] - want[-1]) < 1e-12, text


def test_a_notice_is_found_at_every_place(table):
    texts = ["w " * n + "Released under a b c d the MIT License" + " z" * k for n in range(12) for k in (0, 3)]
    got = report(table(enumerate(texts)))
    for i, text in enumerate(texts):
        assert got[i][:-1] == plain(text)[:-1] and got[i][5] == "mit,mit-notice", text


def test_of_overlapping_blocks_the_best_is_given(table):
    text = "z " * 4 + "Released under the MIT License " * 2 + "y " * 30 + "under the mit license"
    row = ls.license_blocks(table([(1, text)])).first()
    assert [(b["label"], b["start"], b["end"], b["containment"]) for b in row["blocks"]] == [("mit-notice", 4, 14, 1.0), ("mit-notice", 44, 48, 0.8)]


def test_odd_rows(odd, nothing):
    got = report(odd)
    assert got[1] == got[2] == (0, 0, None, None, "", "", 0.0)
    assert got[4][0] == len(LONG.split())
    assert ls.license_report(odd).count() == len(ODD)
    assert ls.license_report(nothing).count() == 0
