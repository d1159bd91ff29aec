r"""Regular expressions with ECMAScript meaning on Spark's Java engine.

Java differs in ``\b`` (Unicode-aware in Java 17), ``\s`` (ASCII only) and ``$`` (also matches before a final
newline). ``ecma`` spells the ECMAScript meaning out, so patterns can be stated in their usual form.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the members of the ECMAScript white-space class; the rare ones behind one range test
WHITE = r"\t-\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
# the same characters one by one, for Python
WHITE_CHARACTERS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Java's \w is the same ASCII class as ECMAScript's
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
WORD_START = re.compile(r"\w|\\d|\[(?:\w-\w|\w)+\]")


def _word_follows(rest: str) -> bool:
    """Whether a match of the pattern must begin with a word character; then a boundary is a single look-behind."""
    group = re.match(r"\((?:\?:)?([^()]*)\)(?![?*])", rest)
    if group:
        return all(WORD_START.match(branch) for branch in group.group(1).split("|"))
    token = WORD_START.match(rest)
    return bool(token) and rest[token.end() : token.end() + 1] not in ("?", "*")


@lru_cache(maxsize=None)
def ecma(pattern: str, flags: str = "") -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(WHITE if in_class else f"[{WHITE}]")
            i += 2
        elif pair == r"\S":
            out.append(f"[^{WHITE}]")
            i += 2
        elif pair == r"\b" and not in_class:
            out.append(r"(?<!\w)" if _word_follows(pattern[i + 2 :]) else BOUNDARY)
            i += 2
        elif pair.startswith("\\"):
            out.append(pair)
            i += 2
        else:
            ch = pattern[i]
            if ch == "[" and not in_class:
                in_class = True
            elif ch == "[":
                ch = r"\["
            elif ch == "]":
                in_class = False
            elif ch == "$" and not in_class and "m" not in flags:
                ch = r"\z"
            elif ch == "." and not in_class:
                ch = r"[^\n\r\u2028\u2029]" if "s" not in flags else "."
            out.append(ch)
            i += 1
    return (f"(?{flags})" if flags else "") + "".join(out)


def sub(c: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(c, ecma(pattern, flags), replacement)


def found(c: Column, pattern: str, flags: str = "") -> Column:
    return c.rlike(ecma(pattern, flags))


def first(c: Column, pattern: str, group: int = 0, flags: str = "") -> Column:
    """First match, NULL when there is none."""
    text = F.regexp_extract(c, ecma(pattern, flags), group)
    return F.when(found(c, pattern, flags), text)


def chain(c: Column, *rules: tuple) -> Column:
    """Apply (pattern, replacement[, flags]) one after the other."""
    for rule in rules:
        c = sub(c, *rule)
    return c


def chain_where(c: Column, words: tuple[str, ...], *rules: tuple) -> Column:
    """Apply the rules to texts that hold one of the words; no rule may match without them. Finding a literal takes far less
    than running a pattern over the text."""
    return let(c, lambda t: F.when(contains_any(t, words), chain(t, *rules)).otherwise(t))


def let(c: Column, body) -> Column:
    """Evaluate c once and hand it to body, which may use it many times."""
    return F.element_at(F.transform(F.array(c), body), 1)


def trim(c: Column) -> Column:
    # each run of white space is entered once, at its start: linear however long inner runs are
    return F.regexp_replace(c, f"^[{WHITE}]++|(?<![{WHITE}])[{WHITE}]++\\z", "")


def trim_rare(c: Column) -> Column:
    """`trim` for texts that seldom need it: the pattern runs only where an end is white space."""

    def where_white(t: Column) -> Column:
        ends = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
        return F.when(found(ends, r"\s"), trim(t)).otherwise(t)

    return let(c, where_white)


def trim_start(c: Column) -> Column:
    return sub(c, r"^\s+", "")


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space, none at the ends."""
    # a space between words is such a run already: only other runs are written anew
    return F.trim(F.regexp_replace(c, f" [{WHITE}]++|[{WHITE}&&[^ ]][{WHITE}]*+", " "))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """True when any of the words occurs anywhere in the text."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(c, F.lit(word))
    return hit


def count_present(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """How many of the words occur anywhere in the text."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(c, F.lit(word)).cast("int")
    return total
