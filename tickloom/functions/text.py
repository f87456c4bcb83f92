"""Column functions on names, keys and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: suffixes of renamed tickers, in the order in which they go
OLD_SUFFIXES = ["_old2", "_old1", "_old"]


def clean_ticker(x: Column) -> Column:
    """A ticker without the suffixes of old listings, with a dot for a dash."""
    for suffix in OLD_SUFFIXES:
        x = F.replace(x, F.lit(suffix), F.lit(""))
    return F.replace(x, F.lit("-"), F.lit("."))


def without_suffix(x: Column, suffix: str) -> Column:
    return F.when(x.endswith(suffix), F.substring(x, F.lit(1), F.length(x) - len(suffix))).otherwise(x)


def from_template(template: Column, index: Column) -> Column:
    """The template with the index in place of ``$index$``."""
    return F.replace(template, F.lit("$index$"), index)


def contains_ignoring_case(x: Column, part: str) -> Column:
    return F.contains(F.lower(x), F.lit(part.lower()))


def range_key(start: Column, end: Column) -> Column:
    return F.concat_ws("|", F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd"))


def range_of_key(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, r"\|")
    return F.to_date(F.get(parts, 0)), F.to_date(F.get(parts, 1))


def model_name(name: Column) -> tuple[Column, Column]:
    """(base, year) of a name such as ``base_2020`` or ``base_model_2020``; null where it has no year."""
    has_year = F.rlike(name, F.lit(r"_\d{4}$"))
    base = F.coalesce(F.nullif(F.regexp_extract(name, r"^(.*)_model_(\d{4})$", 1), F.lit("")), F.regexp_extract(name, r"(.+?)_(\d{4})$", 1))
    return F.when(has_year, base), F.when(has_year, F.right(name, F.lit(4)).cast("int"))


def filled(x: Column, default: str) -> Column:
    """A text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def lookup(x: Column, names: dict) -> Column:
    """The entry of a small dictionary, null where there is none."""
    return F.element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), x)
