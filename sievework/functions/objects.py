"""JSON texts as parsed values: what is an object, and what it holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """The value of a JSON text; NULL if it is none."""
    return F.try_parse_json(c)


def is_object(c: Column) -> Column:
    """Whether a text is a whole JSON object; arrays, scalars and broken texts are none."""
    # the parser stops after the first value: as the only member of an array nothing may follow it
    alone = parsed(F.concat(F.lit("["), c, F.lit("]")))
    kind = F.schema_of_variant(F.try_variant_get(alone, "$[0]", "variant"))
    only = F.try_variant_get(alone, "$[1]", "variant").isNull() & F.endswith(F.trim(c), F.lit("}"))
    return F.coalesce(F.startswith(kind, F.lit("OBJECT")) & only, F.lit(False))


def field(c: Column, name: str, kind: str) -> Column:
    """A field of an object's text, NULL if it is missing or of another kind."""
    return F.try_variant_get(parsed(c), f"$.{name}", kind)


def entries(c: Column) -> Column:
    """Array of (key, value): the fields of an object's text in order of their names, values as JSON texts."""
    held = F.map_entries(F.try_variant_get(parsed(c), "$", "map<string,variant>"))
    return F.transform(held, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))
