"""Cutting texts into pieces; every function returns an array column, ``explode_chunks`` makes rows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rx
from .text import clean_light


def fixed(c: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of size characters, size - overlap apart; the text is walked once.

    The text is cut into steps; a window is its step followed by what it shares with the steps after it.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    steps = F.regexp_extract_all(rx.text_or_empty(c), F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    if overlap == 0:
        return steps
    reach = -(-size // step)
    return rx.let(
        steps,
        lambda parts: F.transform(
            parts, lambda _, i: F.substring(F.array_join(F.slice(parts, i + 1, F.lit(reach)), ""), 1, size)
        ),
    )


def fixed_collapsed(c: Column, size: int = 800, overlap: int = 200) -> Column:
    return fixed(rx.collapse(rx.text_or_empty(c)), size, overlap)


def word_window(c: Column, size: int = 750, overlap: int = 100) -> Column:
    """Windows of size words; windows of white space only are dropped."""
    step = size - overlap
    words = F.split(rx.text_or_empty(c), rx.ecma(r"\s+"), -1)
    windows = rx.let(
        words,
        lambda ws: F.transform(
            F.sequence(F.lit(0), F.size(ws) - 1, F.lit(step)),
            lambda start: F.array_join(F.slice(ws, start + 1, F.lit(size)), " "),
        ),
    )
    return F.filter(windows, lambda w: rx.trim(w) != "")


def word_pack(c: Column, limit: int = 800) -> Column:
    """Words joined by spaces; a piece closes when its length plus the next word's exceeds the limit.

    The separator before a piece is matched with it. A piece with the space before its last word is one longer than the limit
    at most; a longer word stands alone, and one that begins the text closes an empty piece.
    """
    piece = rf"(?s) (.{{0,{limit + 1}}}(?= |\z)|[^ ]*+)"
    found = F.regexp_extract_all(F.concat(F.lit(" "), rx.text_or_empty(c)), F.lit(piece), F.lit(1))
    return rx.let(found, lambda parts: F.when(F.length(F.get(parts, F.lit(0))) > limit, F.concat(led(c, limit), parts)).otherwise(parts))


def led(c: Column, limit: int) -> Column:
    """An empty piece in front if the first word is longer than the limit."""
    long_word = rx.text_or_empty(c).rlike(rf"\A[^ ]{{{limit + 1}}}")
    return F.when(long_word, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))


def line_pack(c: Column, limit: int = 800) -> Column:
    """Lines kept whole; a piece closes when it and the next line together exceed the limit.

    A piece takes all lines that fit into the limit. If these are white space only, it is not closed: it goes on to the end
    of the first line with anything else.
    """
    blank = f"[{rx.WHITE}&&[^\\n]]"
    fits = rf".{{0,{limit}}}(?=\n|\z)"
    # some line within the limit ends after more than white space
    inked = rf"(?={fits}(?<=[^{rx.WHITE}]{blank}{{0,{limit}}}))"
    piece = rf"(?s)\n({inked}{fits}|[{rx.WHITE}]*+[^\n]*+)"
    found = F.regexp_extract_all(F.concat(F.lit("\n"), clean_light(c)), F.lit(piece), F.lit(1))
    return F.filter(F.transform(found, rx.trim), lambda p: p != "")


def explode_chunks(df: DataFrame, chunks: Column, text: str = "chunk_text", index: str = "chunk_index") -> DataFrame:
    """One row per piece with its 0-based index; the column holding the whole text should be dropped before."""
    return df.select("*", F.posexplode(chunks).alias(index, text))


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat_ws("-", F.coalesce(source, F.lit("unknown")), (index + 1).cast("string"))


def header(entity: Column, file_name: Column) -> Column:
    source_line = F.concat(F.lit("SOURCE FILE: "), file_name, F.lit("\n\n"))
    return F.when(entity.isNotNull(), F.concat(F.lit("PRIMARY ENTITY: "), entity, F.lit("\n"), source_line)).otherwise(
        source_line
    )
