"""License scans by an exact set-similarity join of text blocks with templates.

A template is a set of words; a block of a text meets it if it holds at least `least` of them (containment). For a template of m
words in running text a block is any run of 2m words, at every start: a block that begins with another word holds no more
than the one that begins at its first template word, so those are looked at. Template words are ordered by how many texts hold them,
rarest first (counted over all texts). A block that meets the template must hold one of its first |T| - need + 1 words
(prefix), must have `need` template words at all (length), and what may still match behind its first word in that order must suffice (position);
the rest is counted in full, the words in a block being kept up to date from start to start.

Phrases are templates that must be contained whole; a block that passes is then searched for the places where the phrase's
words stand one after the other. Two narrow passes over the texts; the templates are fixed and small.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, rows, shape, slices, steady, texts

# Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# The opening words of common public licenses and notices, by label.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "cc-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation",
    "mit-notice": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
LEAST = 0.8

# ASCII letters are lower-cased before; all bytes from 0x80 on belong to words
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Template:
    def __init__(self, label: str, text: str, least: float, order: dict[bytes, tuple], phrase: bool):
        self.label, self.phrase, self.sequence = label, phrase, words(text)
        self.size = len(self.sequence)
        ranked = sorted(set(self.sequence), key=lambda w: order.get(w, (0, w)))
        self.place = {w: i for i, w in enumerate(ranked)}
        self.need = max(1, math.ceil(least * len(ranked) - 1e-9))
        self.prefix = frozenset(ranked[: len(ranked) - self.need + 1])

    def blocks(self, hits: list[tuple[int, bytes]]):
        """(start, containment) of all blocks that meet the template and start at a template word; hits are the places of known words."""
        own = [(i, self.place[w], w in self.prefix) for i, w in hits if w in self.place]
        if len(own) < self.need or not any(p for _, _, p in own):
            return
        times, distinct, prefixed, end = [0] * len(self.place), 0, 0, 0
        for start, (first, rank, is_prefix) in enumerate(own):
            while end < len(own) and own[end][0] < first + 2 * self.size:
                times[own[end][1]] += 1
                distinct += times[own[end][1]] == 1
                prefixed += own[end][2]
                end += 1
            # prefix and length; then position: all before the first common word are missing
            if prefixed and end - start >= self.need and distinct >= self.need:
                least = next(i for i, n in enumerate(times) if n)
                if len(times) - least >= self.need:
                    yield first, distinct / len(times)
            times[rank] -= 1
            distinct -= times[rank] == 0
            prefixed -= is_prefix


def apart(blocks: list[tuple[int, float]], length: int) -> list[tuple[int, float]]:
    """Of each run of overlapping blocks the one of highest containment, the first among equals."""
    out, last = [], -length
    for start, share in blocks:
        if out and start < last + length:
            if share > out[-1][1]:
                out[-1] = (start, share)
        else:
            out.append((start, share))
        last = start
    return out


def vocabulary(phrases=PHRASES, templates=TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for t in (*phrases, *templates.values()) for w in words(t))


def word_order(df: DataFrame, text: str, known: frozenset[bytes]) -> dict[bytes, tuple]:
    """Number of texts that hold each template word, over all texts; equal numbers go by the word."""

    @steady
    def run(batches):
        counts = dict.fromkeys(sorted(known), 0)
        for batch in slices(batches, text):
            for t in texts(batch, text):
                for word in known.intersection(words(t)):
                    counts[word] += 1
        yield rows(word=pa.array(list(counts), type=pa.binary()), n=pa.array(list(counts.values()), type=pa.int64()))

    counted = df.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): (r["n"], bytes(r["word"])) for r in counted.collect()}


def license_blocks(
    df: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None, least: float = LEAST,
) -> DataFrame:
    """Rows (key, n_words long, places, blocks): phrase places (label, start) and template blocks (label, start, end,
    containment), words counted from 0, end exclusive. Of blocks of one template that overlap the best is given.

    Null and empty texts have no words and nothing found. Repeated rows give repeated rows.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    shaped = shape(df, key, text)
    order = word_order(shaped.toDF("k", "text"), "text", vocabulary(phrases, templates))
    joined = [Template(label, t, 1.0, order, True) for t, label in phrases.items()]
    joined += [Template(label, t, least, order, False) for label, t in templates.items()]
    any_prefix = frozenset().union(*[t.prefix for t in joined])
    known = vocabulary(phrases, templates)
    place_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    block_type = pa.list_(
        pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
    )

    def search(found: list[bytes]):
        places, blocks = [], []
        if any_prefix.isdisjoint(found):
            return places, blocks
        hits = [(i, w) for i, w in enumerate(found) if w in known]
        held = {w for _, w in hits}
        for template in joined:
            if template.prefix.isdisjoint(held):
                continue
            met, n = list(template.blocks(hits)), template.size
            if template.phrase:
                places += [{"label": template.label, "start": i} for i, _ in met if found[i : i + n] == template.sequence]
            else:
                blocks += [
                    {"label": template.label, "start": i, "end": min(len(found), i + 2 * n), "containment": share}
                    for i, share in apart(met, 2 * n)
                ]
        return places, blocks

    @steady
    def run(batches):
        for batch in slices(batches, text):
            found = [words(t) for t in texts(batch, text)]
            hits = [search(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array([len(f) for f in found], type=pa.int64()),
                    pa.array([h[0] for h in hits], type=place_type),
                    pa.array([h[1] for h in hits], type=block_type),
                ],
                names=[key, "n_words", "places", "blocks"],
            )

    return shaped.mapInArrow(
        run,
        f"`{key}` {kind(df, key)}, n_words long, places array<struct<label: string, start: long>>, "
        "blocks array<struct<label: string, start: long, end: long, containment: double>>",
    )


def license_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: places and labels of the phrases, labels of the templates met, and the best containment."""
    found = license_blocks(df, key, text)
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    labels = F.concat(base, F.transform("blocks", lambda b: b["label"]))
    best = F.array_max(F.transform("blocks", lambda b: b["containment"]))

    def joined(names):
        return F.array_join(F.array_sort(F.array_distinct(names)), ",")

    return found.select(
        F.col(f"`{key}`"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(labels).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
