"""Columns of JSON of unknown and mixed types, as variants: their schema found from the data, and typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parsed(text: Column | str) -> Column:
    """A text as a variant; null for null and for text that is no JSON."""
    return F.try_parse_json(text)


def schema_of(df: DataFrame, variant: Column) -> str:
    """The schema of all variants together, as Spark names it; one text, from partial results of every task. ``OBJECT<>`` fields of mixed types are VARIANT."""
    return df.agg(F.schema_of_variant_agg(variant).alias("s")).first().s or "VOID"


def fields_of(df: DataFrame, variant: Column) -> dict[str, str]:
    """The names at the top of the objects, with the type of each; types that differ from row to row are ``variant``."""
    text = schema_of(df, variant)
    if not text.startswith("OBJECT<"):
        return {}
    fields = T._parse_datatype_string(text.replace("OBJECT<", "STRUCT<")).fields
    return {f.name: f.dataType.simpleString() for f in fields}


def typed(variant: Column, fields: dict[str, str]) -> list[Column]:
    """A column for each field: null where the field is absent or is not of the type, or no number of it."""
    return [F.try_variant_get(variant, f'$["{name}"]', kind).alias(name) for name, kind in fields.items()]


def kind_of(variant: Column, name: str) -> Column:
    """The type that a field has in this row, as Spark names it; null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(variant, f'$["{name}"]', "variant"))
