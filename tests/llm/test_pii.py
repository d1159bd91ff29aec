"""Spans against regular expressions run over whole texts."""

import hashlib
import random
import re
import time

from sievework.llm import pii

from .conftest import ODD

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain(text):
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and passes_luhn(digits):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return spans


def test_base_kinds_equal_the_patterns():
    pick = random.Random(11)
    automaton = pii.anchors()
    signs = "0123456789" * 3 + "@@..++-- ()ab%é😀"
    for _ in range(8000):
        text = "".join(pick.choice(signs) for _ in range(pick.randint(0, 90)))
        assert [s for s in pii.find_spans(text, automaton) if s[0] in pii.BASE] == plain(text), text


def test_cards_with_separators_and_their_neighbours():
    automaton = pii.anchors()
    text = "é 4111 1111-1111 1111, 4111111111111112 and 1.2.3.4.5.6.7.8 or 256.1.1.1 +1 (988) 555-2485. a@b a@b.c@d.e"
    assert pii.find_spans(text, automaton) == plain(text)
    assert ("card", 2, 21) in plain(text)


def test_cued_kinds():
    automaton = pii.anchors()
    text = "IBAN: DE89370400440532013000; iban DE89370400440532013001; account no. 12345678, SSN 123-45-6789 ssn 000-12-3456 http://ann:pw@host/x"
    got = {(k, text[a:b]) for k, a, b in pii.find_spans(text, automaton) if k not in pii.BASE}
    assert got == {("iban", "DE89370400440532013000"), ("account", "12345678"), ("ssn", "123-45-6789"), ("login", "ann:pw")}
    hidden = pii.masked(text, pii.find_spans(text, automaton))
    assert "12345678" not in hidden and "[IBAN]" in hidden and hidden.startswith("IBAN: [IBAN]; iban DE89")


def test_account_numbers_in_running_text_and_logins_of_any_length():
    automaton = pii.anchors()
    secret = "t" * 5000
    for text, wanted in [
        ("IBAN DE89370400440532013000 is fine", [("iban", "DE89370400440532013000")]),
        ("iBaN: DE89 3704 0044 0532 0130 00 and more words to come", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("IBAN DE893704004405320130001 no", []),
        ("IBAN NO9386011117947", [("iban", "NO9386011117947")]),
        ("iban XK05 1212 0123 4567 8906 was paid", [("iban", "XK05 1212 0123 4567 8906")]),
        ("Ssn 123-45-6789", [("ssn", "123-45-6789")]),
        (f"https://me:{secret}@host.example", [("login", f"me:{secret}")]),
    ]:
        assert [(k, text[a:b]) for k, a, b in pii.find_spans(text, automaton) if k not in (*pii.BASE, "account")] == wanted, text


def test_report_and_masking(table):
    texts = {1: "mail a.b@c.de now", 2: "nothing", 3: None, 4: "ip 10.0.0.1 and 10.0.0.2"}
    report = {r["doc_id"]: r for r in pii.pii_report(table(texts.items())).collect()}
    for i, text in texts.items():
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text or ""))
        assert report[i]["spans"] == spans
        assert report[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert (report[4]["n_email"], report[4]["n_ip"], report[4]["n_card"], report[4]["n_phone"]) == (0, 2, 0, 0)
    hidden = pii.mask_column(table(texts.items()))
    assert hidden.columns == table([]).columns
    got = {r["doc_id"]: r["text"] for r in hidden.collect()}
    assert got == {1: "mail [EMAIL] now", 2: "nothing", 3: None, 4: "ip [IP] and [IP]"}


def test_odd_rows(odd, nothing):
    assert pii.pii_report(odd).where("spans = ''").count() == len(ODD)
    assert pii.mask_column(odd).count() == len(ODD)
    assert pii.pii_report(nothing).count() == pii.mask_column(nothing).count() == 0


def test_long_runs_take_linear_time():
    automaton = pii.anchors()
    for run in ("1", "1.", "1 ", "+1", "a@", "account ", "IBAN DE89 ", "a.", "http://a:", "://a:b", "iban DE89 1234 "):
        times = []
        for size in (20_000, 80_000):
            start = time.perf_counter()
            pii.find_spans(run * (size // len(run)), automaton)
            times.append(time.perf_counter() - start)
        assert times[1] < max(0.5, 9 * times[0]), run
