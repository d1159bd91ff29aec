"""Rules against hand-made lines, counts against a plain version."""

import random
import re

from sievework.llm import quality_rules as qr

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    held = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(words)
    return {
        "n_words": n, "word_chars": len("".join(words)), "n_symbols": len(re.findall("[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(held),
        "base_failed": n < 50 or 100 * len(held) > 50 * n,
    }


PROSE = " ".join(f"word{i} comes before number{i}." for i in range(30))


def test_lines_and_their_rules():
    cases = {
        "A plain sentence.": None,
        "« Une phrase. »": None,
        "她说:“好。”": None,
        "Really? \t": None,
        "A heading": "punctuation",
        "x*** y### z$$$ w&&& end.": "punctuation",
        "What?! he said, and then (what?!) it was ... nothing.": None,
        "Home | News | Sport | Weather.": "navigation",
        "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen | sixteen | seventeen.": None,
        "Login Search Help.": "navigation",
        "All Rights Reserved.": "boilerplate",
        "We use cookies to serve you.": "boilerplate",
        "The cookies are on the table.": None,
    }
    for line, rule in cases.items():
        assert qr.broken_rule(line, qr.split_words(line), qr.signs_of(line)) == rule, line


def test_texts_that_lose_too_much_go():
    assert qr.judge(PROSE)["kept"] and qr.judge(PROSE)["lost_chars"] == 0
    some = PROSE + "\nShare this article with all.\nA heading\n\nEnd."
    found = qr.judge(some)
    assert found["kept"] and (found["n_boilerplate"], found["n_punctuation"], found["n_lines"]) == (1, 1, 4)
    assert found["cleaned"] == PROSE + "\n\nEnd."
    much = PROSE + "\n" + " ".join(f"no end {i}" for i in range(60))
    assert not qr.judge(much)["kept"] and not qr.judge(much)["base_failed"]
    assert qr.judge(much, most_lost=90)["kept"]
    assert not qr.judge("Too short.")["kept"]


def test_counts_equal_the_plain_version(spark, table):
    pick = random.Random(11)
    signs = ["a", "b", "cc", "a|b", "é", "#", "\n", "\n", " ", "\t", "\r", "\x0b", " ", " ", "\x85", "x.", "日本"]
    rows = [(i, "".join(pick.choice(signs) + pick.choice(["", " "]) for _ in range(pick.randrange(0, 160)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, PROSE), (1002, PROSE), (None, PROSE), (1003, "a b c " * 40), (1004, "\n".join(["same line."] * 30))]
    got = qr.clean_texts(table(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for key, text in rows:
        texts.setdefault(key, text)
    for r in got:
        want = plain_base(texts[r["doc_id"]])
        assert {c: r[c] for c in want} == want
        assert not (r["kept"] and r["base_failed"])


def test_odd_rows(odd, nothing):
    got = qr.clean_texts(odd, cleaned=False)
    assert got.count() == 10 and "cleaned" not in got.columns and got.where("kept").count() == 0
    assert qr.clean_texts(nothing).count() == 0
