"""Hashes that prove a stored answer unchanged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGRITY_FIELDS = ("finalAnswer", "persona", "tone", "namespace", "intent", "timestamp")


def integrity_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the JSON of the six fields in fixed order; NULL fields are left out."""
    return F.sha2(F.to_json(F.struct(*[fields[name].alias(name) for name in INTEGRITY_FIELDS])), 256)


def verify_integrity(fields: dict[str, Column], stored: Column) -> Column:
    """NULL when a required field is missing, else whether the recomputed hash equals the stored one."""
    complete = (
        (F.coalesce(fields["finalAnswer"], F.lit("")) != "") & fields["persona"].isNotNull() & stored.isNotNull()
    )
    return F.when(complete, F.coalesce(integrity_hash(fields) == stored, F.lit(False)))


def document_id(*parts: Column) -> Column:
    """The same document gets the same id in every run; pass a row key too where equal documents must stay apart."""
    return F.sha2(F.concat_ws("\u241f", *[p.cast("string") for p in parts]), 256)
