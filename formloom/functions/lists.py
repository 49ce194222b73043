"""Delimited lists (empty items count; a blank list has none) and multiple choices (space separated)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import empty_text

NONE = F.array


def items(delimiter: str, field: Column) -> Column:
    return F.when(field.isNull() | (field == ""), F.array().cast("array<string>")).otherwise(F.split(field, "\\Q" + delimiter.replace("\\E", "") + "\\E"))


def count_items(delimiter: str, field: Column) -> Column:
    return F.size(items(delimiter, field)).cast("double")


def item_at(delimiter: str, field: Column, n: Column) -> Column:
    at = n.cast("int")
    return F.when(at >= 0, F.get(items(delimiter, field), at))


def item_index(delimiter: str, field: Column, value: Column) -> Column:
    return (F.array_position(items(delimiter, field), empty_text(value)) - 1).cast("double")


def item_present(delimiter: str, field: Column, value: Column) -> Column:
    return F.array_contains(items(delimiter, field), empty_text(value))


def de_duplicate(delimiter: str, field: Column) -> Column:
    return F.array_join(F.array_distinct(items(delimiter, field)), delimiter)


def choices(field: Column) -> Column:
    """The chosen values; stray spaces are no choices."""
    return F.filter(F.split(empty_text(field), " "), lambda x: x != "")


def count_selected(field: Column) -> Column:
    return F.size(choices(field)).cast("double")


def selected(field: Column, value: Column) -> Column:
    return F.array_contains(choices(field), empty_text(value))


def selected_at(field: Column, n: Column) -> Column:
    at = n.cast("int")
    return F.when(at >= 0, F.get(choices(field), at))


def rank_value(value: Column, numbers: Column) -> Column:
    """Rank among the numbers of a space-separated list, highest first."""
    v = value.cast("double")
    above = F.filter(choices(numbers), lambda x: F.coalesce(x.try_cast("double") > v, F.lit(False)))
    return F.when(v.isNotNull(), (F.size(above) + 1).cast("double"))


def dummies(field: Column, values: list[str], prefix: str) -> list[Column]:
    """A 1/0 column for each choice value."""
    chosen = choices(field)
    return [F.array_contains(chosen, v).cast("int").alias(f"{prefix}_{v}") for v in values]
