"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, scheme signs and identifier cues. At each anchor
a local parser expands to the span's boundaries and checks it (octets, Luhn, digit counts, check sums). A kind never looks at
text behind the end of its last span or run, so the work is linear in the text. A narrow pass without shuffle.

Kinds: email, ip, card, phone (leftmost, not overlapping within a kind; a failing run is dropped whole), and found
by cue in any case: iban (country's length, mod 97), account (6 to 17 digits), ssn, login (user information of any length in
an address with a scheme).
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kind, shape, slices, steady, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "ssn", "login")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
RUN = re.compile(r"[0-9]+")
OCTETS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GAP = r"(?:[\x20]?(?i:number|no\.?|nr\.?))?[\x20:#=.]{0,4}"
IBAN = re.compile(GAP + r"([A-Za-z]{2}[0-9]{2}(?:[\x20]?[A-Za-z0-9]){11,30})")
ACCOUNT = re.compile(GAP + r"([0-9]{6,17})(?![0-9])")
SSN = re.compile(GAP + r"((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])")
# a stretch without slash or at-sign is read once: no limit on its length
LOGIN = re.compile(r"([^\s/?#@:]++:[^\s/?#@]++)@[A-Za-z0-9]")
CUES = ("iban", "account", "ssn")

# Characters of an IBAN by country; other countries are tried at every end of a group.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(number: str) -> bool:
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the account number from start ends, at most at end: at the country's length, else the last end of a group
    with a right check sum; None if there is none. A number goes on to no letter or digit."""
    size = IBAN_SIZES.get(text[start : start + 2].upper())
    number, passing = "", None
    for at in range(start, end):
        if text[at] == " ":
            continue
        number += text[at].upper()
        whole = at + 1 == len(text) or not (text[at + 1].isascii() and text[at + 1].isalnum())
        if whole and len(number) >= 15 and (size is None or len(number) == size) and mod97(number):
            passing = at + 1
    return passing


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def anchors():
    import ahocorasick

    built = ahocorasick.Automaton()
    for sign, what in (("@", "email"), ("+", "phone"), ("://", "login"), *((d, "digit") for d in "0123456789")):
        built.add_word(sign, what)
    for what in CUES:
        # capitals anywhere in a cue
        for form in itertools.product(*[(c, c.upper()) for c in what]):
            built.add_word("".join(form), what)
    built.make_automaton()
    return built


BY_CUE = {"iban": IBAN, "account": ACCOUNT, "ssn": SSN, "login": LOGIN}


def find_spans(text: str, automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where a kind may look again
    for last, what in automaton.iter(text):
        if what == "digit":
            if last >= free["card"] and (chain := CHAIN.match(text, last)):
                free["card"] = chain.end()
                # enough for the check without counting the digits of endless runs
                digits = chain[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(chain.span())
            if last >= free["ip"]:
                if address := OCTETS.match(text, last):
                    free["ip"] = address.end()
                    if all(map(octet, address.groups())):
                        found["ip"].append(address.span())
                else:
                    free["ip"] = RUN.match(text, last).end()
        elif what == "email":
            start = last
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (domain := DOMAIN.match(text, last + 1)):
                free["email"] = domain.end()
                found["email"].append((start, domain.end()))
        elif what == "phone":
            if number := PHONE.match(text, last):
                if 9 <= sum(map(number[0].count, "0123456789")) <= 15:
                    found["phone"].append(number.span())
        elif last >= free[what] and (cued := BY_CUE[what].match(text, last + 1)):
            start, end = cued.span(1)
            if what == "iban" and (end := iban_end(text, start, end)) is None:
                continue
            found[what].append((start, end))
            free[what] = end
    return [(k, *span) for k in KINDS for span in found[k]]


def written_out(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def merged(spans) -> list[tuple[int, int, str]]:
    """Spans in order of place; overlapping ones become one, named after the first."""
    out: list[list] = []
    for start, end, what in sorted((a, b, k) for k, a, b in spans):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, what])
    return [tuple(x) for x in out]


def masked(text: str, spans) -> str:
    parts, last = [], 0
    for start, end, what in merged(spans):
        parts += [text[last:start], f"[{what.upper()}]"]
        last = end
    return "".join([*parts, text[last:]])


SPAN = "array<struct<kind: string, start: long, end: long>>"


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, found array of (kind, start, end), masked string): the spans of each text and the text without them.

    Null text: no spans, masked null. Empty texts have none. Repeated rows give repeated rows.
    """

    @steady
    def run(batches):
        automaton = anchors()
        for batch in slices(batches, text):
            values = batch.column(text).to_pylist()
            spans = [find_spans(v or "", automaton) for v in values]
            cells = [[{"kind": k, "start": a, "end": b} for k, a, b in of] for of in spans]
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            hidden = [v if not of else masked(v, of) for v, of in zip(values, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(cells, type=kinds), pa.array(hidden, type=pa.string())],
                names=[key, "found", "masked"],
            )

    return shape(df, key, text).mapInArrow(run, f"`{key}` {kind(df, key)}, found {SPAN}, masked string")


def mask_column(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its text masked, all other columns as they were."""

    @steady
    def run(batches):
        automaton = anchors()
        for batch in slices(batches, text):
            hidden = [v if v is None else masked(v, find_spans(v, automaton)) for v in batch.column(text).to_pylist()]
            place = batch.schema.get_field_index(text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(hidden, type=batch.schema.field(place).type))

    return df.mapInArrow(run, df.schema)


def digest(spans) -> str:
    """SHA-256 of the base spans as text."""
    return hashlib.sha256(written_out(spans).encode()).hexdigest()


def pii_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text, from personal_data."""
    from pyspark.sql import functions as F

    spans = personal_data(df, key, text)

    def as_text(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(k):
        return F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    counts = [number(k) for k in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return spans.select(f"`{key}`", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))
