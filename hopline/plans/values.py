"""From literals and parameters to Python values and typed columns."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopline.errors import HoplineError
from hopline.plans import ast as A
from hopline.plans.types import RANGES, PropType

EPOCH = dt.datetime(1970, 1, 1)


def parse_date(value) -> dt.date:
    """A date from ISO text, whole days since 1970, or a date."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if isinstance(value, int) and not isinstance(value, bool):
        return (EPOCH + dt.timedelta(days=value)).date()
    try:
        return dt.date.fromisoformat(str(value)[:10]) if len(str(value)) >= 10 else dt.date.fromisoformat(str(value))
    except ValueError:
        raise HoplineError(f"{value!r} is not a date") from None


def parse_datetime(value) -> dt.datetime:
    """A UTC wall-clock time, to the millisecond, from ISO text, milliseconds since 1970, or a time."""
    if isinstance(value, int) and not isinstance(value, bool):
        return EPOCH + dt.timedelta(milliseconds=value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if not isinstance(value, dt.datetime):
        try:
            value = dt.datetime.fromisoformat(str(value))
        except ValueError:
            raise HoplineError(f"{value!r} is not a time") from None
    if value.tzinfo is not None:
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
    return value.replace(microsecond=value.microsecond // 1000 * 1000)


def convert(value, kind: PropType, what: str = "value"):
    """A Python value as ``kind`` holds it, or an error that names ``what``."""

    def wrong():
        return HoplineError(f"{what}: {value!r} is not a {kind}")

    if value is None:
        if not kind.nullable:
            raise wrong()
        return None
    if kind.list:
        if not isinstance(value, (list, tuple)):
            raise wrong()
        return [convert(x, PropType(kind.scalar, True, enum=kind.enum), what) for x in value]
    if kind.is_vector:
        if not isinstance(value, (list, tuple)) or len(value) != kind.dim or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in value):
            raise wrong()
        return [float(x) for x in value]
    if kind.scalar == "String":
        if not isinstance(value, str) or kind.enum and value not in kind.enum:
            raise wrong()
        return value
    if kind.scalar == "Bool":
        if not isinstance(value, bool):
            raise wrong()
        return value
    if kind.scalar == "Date":
        return parse_date(value)
    if kind.scalar == "DateTime":
        return parse_datetime(value)
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        raise wrong()
    if kind.scalar in ("F32", "F64"):
        return float(value)
    if value != int(value):
        raise wrong()
    value = int(value)
    low, high = RANGES.get(kind.scalar, (-(2**31), 2**31 - 1) if kind.scalar == "I32" else (-(2**63), 2**63 - 1))
    if not low <= value <= high:
        raise wrong()
    return Decimal(value) if kind.scalar == "U64" else value


def column(value, kind: PropType) -> Column:
    """A converted value as a literal column of the type's Spark type."""
    if isinstance(value, list):
        return F.array(*[column(x, kind.element if kind.list else PropType("F32")) for x in value]).cast(kind.spark())
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        value = value.isoformat()
    return F.lit(value).cast(kind.spark())


def literal(e: A.Lit):
    """The Python value of a literal."""
    if e.kind == "list":
        return [literal(x) for x in e.value]
    if e.kind == "Date":
        return parse_date(e.value)
    if e.kind == "DateTime":
        return parse_datetime(e.value)
    return e.value
