"""Line-first cleaning: lines that break a rule go, then texts that lost too much.

Every line with a word meets three rules in turn; the first one it breaks names it.

- punctuation: it does not end in a closing mark of a sentence, or marks are stacked (at least three runs of two or more
  of them, more than three in ten words);
- navigation: a row of short entries between separators, or menu words and nothing else;
- boilerplate: it holds a notice of web pages (rights, cookies, terms, newsletters).

A text is rejected if the lines removed hold more than `most_lost` percent of its word characters, or if it fails the base
rules: fewer than 50 words, or more than half of its words inside repeated windows of three words.

One narrow pass over whole texts. Memory follows the longest text. A null text counts as empty: no words, all counts 0,
not kept. Every row is judged by itself, so repeated rows and null or equal keys come out as they came in; an empty table
gives an empty one; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kind, rows, shape, slices, steady, texts

# fixed values: words by ASCII white space, symbols, windows and limits of the base rules
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50

MOST_LOST = 30
ENDS = ".!?…。！？؟।"
CLOSERS = "\"'”’»)]}」』\u00a0\u202f"
STACKED = "[#*$%&|<>!?=~^_+]{2,}"
SEPARATORS = "|»›•·>/"
MENU = (
    "about back blog careers cart categories checkout contact faq first forum gallery help home index last links log login logout "
    "menu more news next older newer out overview page previous print products register search share shop sign sitemap skip "
    "in up to us tags top"
).split()
NOTICES = (
    "all rights reserved", "accept cookies", "cookie policy", "use cookies", "uses cookies", "privacy policy", "terms of service",
    "terms of use", "terms and conditions", "enable javascript", "javascript is disabled", "subscribe to our newsletter",
    "sign up for our newsletter", "powered by wordpress", "lorem ipsum", "back to top", "share this article", "follow us on",
    "click here to", "page not found",
)

_stacked = re.compile(STACKED.encode())
_bars = re.compile(f"[{re.escape(SEPARATORS)}]")
_bar = re.compile("(?:" + "|".join(re.escape(c) for c in SEPARATORS) + ")+")
_menu = frozenset(MENU)
_notices = [n.encode() for n in NOTICES]
_ends = tuple(ENDS)


def split_words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, as bytes: there split knows no other white space."""
    return text.encode("utf-8", "surrogatepass").split()


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, WHITE))


def signs_of(text: str) -> tuple[bool, bool, list[bytes]]:
    """What of stacked marks, separators and notices the text holds anywhere; its lines need no search for the others."""
    raw = text.encode("utf-8", "surrogatepass")
    lower = raw.lower()
    return bool(_stacked.search(raw)), bool(_bars.search(text)), [n for n in _notices if n in lower]


def broken_rule(line: str, words: list[bytes], signs: tuple[bool, bool, list[bytes]]) -> str | None:
    """The first rule a line with words breaks; signs are those of its text."""
    stacked, barred, notices = signs
    if not line.rstrip(WHITE + CLOSERS).endswith(_ends):
        return "punctuation"
    if stacked:
        runs = len(_stacked.findall(line.encode("utf-8", "surrogatepass")))
        if runs >= 3 and 10 * runs > 3 * len(words):
            return "punctuation"
    if barred:
        bars = sum(_bar.fullmatch(w.decode("utf-8", "surrogatepass")) is not None for w in words)
        if bars >= 2 and len(words) <= 8 * bars:
            return "navigation"
    if all(w.lower().decode("utf-8", "surrogatepass").rstrip(ENDS) in _menu for w in words):
        return "navigation"
    if notices:
        lower = line.encode("utf-8", "surrogatepass").lower()
        if any(n in lower for n in notices):
            return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that the text holds twice or more."""
    if len(words) <= WINDOW:
        return 0
    seen = defaultdict(count().__next__)
    codes = np.array([*map(seen.__getitem__, words)], dtype=np.int64)
    windows = len(words) - WINDOW + 1
    key = codes[:windows]
    for i in range(1, WINDOW):
        # numbers of the windows so far stay below the number of words, so the product fits
        key = np.unique(key * len(seen) + codes[i : windows + i], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    held = np.zeros(len(words), dtype=bool)
    for i in range(WINDOW):
        held[i : windows + i] |= again
    return int(held.sum())


LONGS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punctuation", "n_navigation",
    "n_boilerplate", "lost_chars",
)


def judge(text: str, most_lost: int = MOST_LOST) -> dict:
    """Counts, cleaned text and verdict of one text."""
    counts, signs = dict.fromkeys(LONGS, 0), signs_of(text)
    words, seen, kept = [], set(), []
    for line in text.split("\n"):
        held = split_words(line)
        if held:
            words += held
            counts["n_lines"] += 1
            counts["n_dup_lines"] += line in seen
            seen.add(line)
            rule = broken_rule(line, held, signs)
            if rule:
                counts["n_" + rule] += 1
                counts["lost_chars"] += word_chars(line)
                continue
        kept.append(line)
    # no word holds a line end, so the lines' words are the text's
    out = counts | {
        "n_words": len(words),
        "word_chars": word_chars(text),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_repeat_words": repeated_words(words),
    }
    out["base_failed"] = out["n_words"] < LEAST_WORDS or 100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"]
    out["kept"] = not out["base_failed"] and 100 * out["lost_chars"] <= most_lost * out["word_chars"]
    out["cleaned"] = "\n".join(kept)
    return out


def clean_texts(df: DataFrame, key: str = "doc_id", text: str = "text", most_lost: int = MOST_LOST, cleaned: bool = True) -> DataFrame:
    """Rows (key, counts long, base_failed, kept, cleaned): cleaned is the text without the removed lines, for kept and
    rejected texts alike; leave it out with cleaned=False."""
    more = ", cleaned string" if cleaned else ""

    @steady
    def run(batches):
        for batch in slices(batches, text):
            found = [judge(t, most_lost) for t in texts(batch, text)]
            columns = {c: pa.array([f[c] for f in found], type=pa.int64()) for c in LONGS}
            columns |= {c: pa.array([f[c] for f in found], type=pa.bool_()) for c in ("base_failed", "kept")}
            if cleaned:
                columns["cleaned"] = pa.array([f["cleaned"] for f in found], type=pa.string())
            yield rows(**{key: batch.column(key)}, **columns)

    names = ", ".join(f"{c} long" for c in LONGS)
    return shape(df, key, text).mapInArrow(run, f"`{key}` {kind(df, key)}, {names}, base_failed boolean, kept boolean{more}")
