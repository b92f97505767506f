"""Absent, null and sentinel are three things: predicates that keep them apart, over typed columns and over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that state why nothing is known.
SENTINELS = ("unknown", "not_available", "not_applicable")


def is_sentinel(c: Column) -> Column:
    return F.coalesce(c.isin(*SENTINELS), F.lit(False))


def has_real_text(c: Column) -> Column:
    """Present, not null, no sentinel and not blank."""
    return F.coalesce(c.isNotNull() & ~c.isin(*SENTINELS) & (F.trim(c) != ""), F.lit(False))


def has_real_array(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def real_array_element(c: Column) -> Column:
    """Any element that is no sentinel."""
    return F.coalesce(F.exists(c, lambda x: has_real_text(x)), F.lit(False))


def keys(raw: Column) -> Column:
    """Names present in a JSON object, null values included; no array for what is no object."""
    return F.json_object_keys(raw)


def is_present(raw: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(keys(raw), name), F.lit(False))


def is_null_value(variant: Column, name: str) -> Column:
    """Present with the value null, as against absent."""
    return F.coalesce(F.is_variant_null(F.variant_get(variant, f"$.{name}", "variant")), F.lit(False))


def unknown_fields(raw: Column, known: list[str]) -> Column:
    return F.array_sort(F.array_except(keys(raw), F.array(*map(F.lit, known))))


def missing_fields(raw: Column, required: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys(raw), F.array().cast("array<string>"))))


def or_default(c: Column, default: str = "unknown") -> Column:
    return F.coalesce(c, F.lit(default))
