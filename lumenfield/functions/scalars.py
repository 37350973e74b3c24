"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: identifier pattern and reserved device names
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.-]*\z"
RESERVED = (
    ["CON", "PRN", "AUX", "NUL"]
    + [f"COM{i}" for i in range(1, 10)]
    + [f"LPT{i}" for i in range(1, 10)]
)


def total(condition: Column) -> Column:
    """How many rows satisfy ``condition`` (NULL counts as no)."""
    return F.count(F.when(condition, F.lit(1)))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``; NULL when there is nothing to divide by."""
    return F.try_divide(F.lit(100.0) * part, whole)


def yes(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def half_even(value: Column) -> Column:
    return F.rint(value).cast("int")


def is_close(a: Column, b: Column, rel: float = 1e-8, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(
        F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)
    )


def valid_id(value: Column) -> Column:
    return yes(value.rlike(ID_PATTERN))


def safe_filename(value: Column) -> Column:
    stem = F.upper(F.split_part(value, F.lit("."), F.lit(1)))
    return valid_id(value) & ~F.endswith(value, F.lit(".")) & ~stem.isin(RESERVED)


def sanitize_stem(name: Column) -> Column:
    """A file-safe stem, never empty and never a device name."""
    cleaned = F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_")
    stem = F.btrim(cleaned, F.lit("_.-"))
    stem = F.when(F.length(stem) > 0, stem).otherwise(F.lit("image"))
    first = F.upper(F.split_part(stem, F.lit("."), F.lit(1)))
    return F.when(first.isin(RESERVED), F.concat(F.lit("image_"), stem)).otherwise(stem)


def parse_ids(text: Column) -> Column:
    """``"1;2"`` -> sorted array of longs; blank -> empty array."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda s: s != "")
    return F.array_sort(F.transform(parts, lambda s: s.cast("bigint")))


def join_ids(ids: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(ids), lambda v: v.cast("string")), ";")


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", value)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
