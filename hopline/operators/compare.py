"""Comparison and membership with the language's casts and nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopline.plans.types import PropType

FLIPPED = {"=": "=", "!=": "!=", ">": "<", "<": ">", ">=": "<=", "<=": ">="}


def compare(left: Column, left_type: PropType, op: str, right: Column, right_type: PropType) -> Column:
    """The right side is cast to the left side's type: 25.9 is 25 beside an integer, and what does not fit is null."""
    if left_type.spark() != right_type.spark():
        right = right.try_cast(left_type.spark())
    return {
        "=": lambda: left == right,
        "!=": lambda: left != right,
        ">": lambda: left > right,
        "<": lambda: left < right,
        ">=": lambda: left >= right,
        "<=": lambda: left <= right,
    }[op]()


def contains(values: Column, list_type: PropType, item: Column, item_type: PropType) -> Column:
    """Membership; false, never null, for a null list or a null item."""
    if list_type.element.spark() != item_type.spark():
        item = item.try_cast(list_type.element.spark())
    return F.coalesce(F.array_contains(values, item), F.lit(False))
