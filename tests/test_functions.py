"""Crafted rows for the rules that are easy to get wrong."""

import re

import pytest
from pyspark.sql import functions as F

from sievework.functions import chunking, classify, entities, hashing, masking, rx, signals, text, vectors


def test_white_space_is_that_of_ecmascript(one):
    assert one(rx.trim, " ﻿ a b 　\n") == "a b"
    assert one(rx.collapse, " a  b\t\x0bc ") == "a b c"
    assert one(lambda c: rx.sub(c, r"[^\w\s]", ""), "a-b c é") == "ab c "


def test_boundary_is_ascii(one):
    assert one(lambda c: rx.sub(c, r"\b1\b", "x"), "é1 a1 1") == "éx a1 x"
    assert one(lambda c: rx.sub(c, r"\b(\+?1)\b", "x"), "a+1 +1 1") == "ax +x x"


def test_dollar_is_the_very_end(one):
    assert one(lambda c: rx.sub(c, "b$", "x"), "ab\n") == "ab\n"


@pytest.mark.parametrize("size,overlap", [(500, 50), (800, 200), (10, 7), (5, 0), (7, 4)])
def test_fixed_windows(one, size, overlap):
    t = "".join(chr(97 + i % 26) for i in range(1234)) + "\nä\n\nz"
    step = size - overlap
    want = [t[i : i + size] for i in range(0, len(t), step)]
    assert one(lambda c: chunking.fixed(c, size, overlap), t) == want


def test_fixed_window_tail_and_empty(one):
    assert [len(p) for p in one(chunking.fixed, "x" * 500)] == [500, 50]
    assert one(chunking.fixed, "") == []


def test_word_windows(one):
    words = [f"w{i}" for i in range(1500)]
    got = one(chunking.word_window, " \n".join(words))
    assert got == [" ".join(words[i : i + 750]) for i in range(0, 1500, 650)]
    assert one(chunking.word_window, "  ") == []


def test_word_pack(one):
    assert one(chunking.word_pack, "") == [""]
    assert one(lambda c: chunking.word_pack(c, 3), "xxxxx b") == ["", "xxxxx", "b"]
    assert one(lambda c: chunking.word_pack(c, 6), "aaa bbb") == ["aaa bbb"]
    assert one(lambda c: chunking.word_pack(c, 5), "aaa bbb") == ["aaa", "bbb"]


def test_line_pack_never_splits_a_line(one):
    long = "y" * 900
    assert one(chunking.line_pack, f"a\n\n{long}\nb") == ["a", long, "b"]
    assert one(chunking.line_pack, "  ") == []


def test_queries(one):
    assert one(text.normalize_query, "Café, résumé?") == "caf r sum "
    assert one(text.normalize_query, " Incdient canddate constructor ") == "incident candidate constructor"
    assert one(lambda c: text.query_terms(text.normalize_query(c)), "the notes about risk risk") == ["about", "risk", "risk"]


def test_typography_and_tokens(one):
    assert one(text.normalize_typography, "a well-known thing") == "a well- known thing"
    assert one(text.normalize_typography, "a\n\nb") == "ab"
    assert one(text.repair_tokens, "marketprivate") == "marketpri vate"
    assert one(text.repair_tokens, "x,y") == "x, y"
    assert one(text.repair_tokens, "can't") == "can' t"


def test_clean_full_normalises_compatibility_characters(one):
    assert one(text.clean_full, "\x00“ﬁ”\t• Ⅷ — ½") == '"fi" - VIII - 1⁄2'


def test_lines_and_sentences(one):
    assert one(text.unique_lines, "A\n\nb\n a \n\nB\nc") == "A\n\nb\n\nc"
    many = " ".join(f"S{i}." for i in range(12))
    assert one(text.cap_sentences, many) == " ".join(f"S{i}." for i in range(10))
    few = "One.  Two!\nThree?"
    assert one(text.cap_sentences, few) == few


def test_tone_keeps_protected_words(one):
    got = one(lambda c: text.tone_rewrite(c, F.lit("ventures")), "I think the Valuation and valuation just rose")
    assert got == "Ventures Analysis:\nI conclude the Valuation and Valuation rose"
    assert one(lambda c: text.tone_rewrite(c, F.lit("unknown")), "maybe") == "with certainty"


def test_phone_rules_differ(one):
    number = "+1 (310) 555-4510"
    assert one(masking.mask_pii, number) == "+[REDACTED_PHONE]"
    assert one(lambda c: masking.leak_scan(c)["sanitized"], number) == "[REDACTED_PHONE]"


def test_nothing_after_an_address_is_kept(one):
    assert one(masking.strip_sensitive, "a 12 Main Street x\n\ny\nz") == "a [REDACTED_ADDRESS]"
    assert one(masking.strip_sensitive, "n 123-45-6789") == masking.BLOCKED
    long = "a 12 Main Street\n" + "line\n" * 20000
    assert one(masking.strip_sensitive, long) == "a [REDACTED_ADDRESS]"


@pytest.mark.parametrize("rules", [masking.CLINICAL, masking.PII])
def test_masking_twice_changes_nothing(one, rules):
    t = "Mail a@b.co 310-555-4510 Dr. House Mr Smith 12 Old Oak Road."
    masked = one(lambda c: masking.mask(c, rules), t)
    assert masked != t
    assert one(lambda c: masking.mask(c, rules), masked) == masked


def test_scan_blocks_only_number_with_word(one):
    blocked = one(masking.leak_scan, "my SSN 123-45-6789 a@b.co")
    assert blocked["block"] and "a@b.co" in blocked["sanitized"]
    assert not one(masking.leak_scan, "code 123-45-6789")["block"]


def test_entities(spark, one):
    def entity(name, body=""):
        return (
            spark.createDataFrame([(name, body)], "n string, t string")
            .select(entities.primary_entity(F.col("n"), F.col("t")).alias("e"))
            .first()["e"]
        )

    assert entity("Jane Smith resume.pdf") == "Jane Smith"
    assert entity("John_Q. Public-cv.pdf") == "John Q. Public"
    assert entity("Security Policy.docx", "by Ann Lee") == "Ann Lee"
    assert entity("Security Policy.docx", "no name") is None
    assert entity("", "Ann Lee") is None
    assert one(entities.requested_token, "show JANE's resume") == "Jane"
    assert one(lambda c: entities.name_from_context(c, F.lit("jane")), "see Jane SMITH here") == "Jane Smith"


def test_classes(one):
    assert one(classify.decode_intent, "several things").asDict() == {"type": "incident", "maturity": "general"}
    assert one(classify.decode_intent, " Repeat exactly: x").asDict() == {"type": "literal", "maturity": "locked"}
    assert one(classify.decode_intent, "").asDict() == {"type": "general", "maturity": "general"}
    assert one(classify.query_profile, "systems")["type"] == "analytical"
    assert one(classify.abstraction_buckets, "strategy roadmap policy audit") == ["strategic", "governance"]
    assert one(classify.abstraction_buckets, "nothing") == ["contextual"]


def test_signals(one):
    assert one(signals.fingerprint, "AB  c") == "ab c| c|ab c"
    assert one(signals.synthetic_id, "") == "ecosystem_248"
    assert one(signals.semantic_density, " ") == 0.0
    assert one(signals.concept_terms, "Alpha, alpha 12345 abcde") == ["alpha", "abcde"]
    assert one(signals.specificity, "led 3 years of aws") == pytest.approx(0.40)


def test_cosine_is_zero_where_undefined(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_integrity(spark):
    df = spark.createDataFrame([("answer", None)], "m string, ts string")
    fields = {
        "finalAnswer": F.col("m"), "persona": F.lit("p"), "tone": F.lit("king"), "namespace": F.lit("n"),
        "intent": F.lit(""), "timestamp": F.col("ts"),
    }
    right = hashing.integrity_hash(fields)
    row = df.select(hashing.verify_integrity(fields, right).alias("a"), hashing.verify_integrity(fields, F.lit("x")).alias("b")).first()
    assert row["a"] is True and row["b"] is False


def test_every_leading_boundary_keeps_its_meaning():
    """The short form of a boundary is only used in front of a word character."""
    assert rx.ecma(r"\bjust") == r"(?<!\w)just"
    assert rx.ecma(r"\b(Mr|Ms)") == r"(?<!\w)(Mr|Ms)"
    for pattern in (r"\b[A-Z._]+@", r"\b(\+?1)", r"\b(?:1)?\(", r"\b\d*x", r"\ba?-"):
        assert rx.BOUNDARY in rx.ecma(pattern), pattern
    assert re.compile(rx.WHITE.replace("&&", "")) is not None


def test_linear_forms_find_the_same(spark, one):
    """Trim and the e-mail rules against their plain patterns in Python, and their time on long runs."""
    import random
    import re
    import time

    pick = random.Random(1)
    signs = "abZ9._%+-@@.. \n\t,;comnet"
    texts = ["a@b.com_c@d.com", "..x@y.de", "%_a@b.co-", *("".join(pick.choice(signs) for _ in range(60)) for _ in range(3000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rules = [masking.CLINICAL[0], masking.PII[0], masking.LEAK_EMAIL]
    columns = [r.apply(F.col("t")).alias(f"r{n}") for n, r in enumerate(rules)]
    counts = [r.hits(F.col("t")).alias(f"h{n}") for n, r in enumerate(rules)]
    for row in df.select("t", *columns, *counts, rx.trim(F.col("t")).alias("trimmed")).collect():
        assert row["trimmed"] == row["t"].strip()
        for n, rule in enumerate(rules):
            plain = re.compile(rule.pattern, re.ASCII | (re.I if "i" in rule.flags else 0))
            assert row[f"r{n}"] == plain.sub(rule.replacement, row["t"]), row["t"]
            assert row[f"h{n}"] == len(plain.findall(row["t"]))
    for build, text in (
        (rx.trim, "x" + " " * 60000 + "y"),
        (rules[0].apply, "a" * 60000 + " b@c.de"),
        (rules[2].apply, "a." * 30000 + " b@c.de"),
    ):
        start = time.perf_counter()
        one(build, text)
        assert time.perf_counter() - start < 5


def test_malformed_bytes_become_replacement_signs(spark):
    from sievework.sources.files import utf8

    df = spark.createDataFrame([(bytes([0x63, 0xE9]) + b" ok",)], "b binary")
    assert df.select(utf8(F.col("b")).alias("t")).first()["t"] == "c\ufffd ok"
