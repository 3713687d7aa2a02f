"""insert, update and delete, as new tables from old ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.operators.compare import compare
from hopline.plans import ast as A
from hopline.plans.schema import DST, ID, SRC, Catalog
from hopline.plans.types import PropType
from hopline.plans.values import convert, literal


def value_of(e: A.Expr, want: PropType, values: dict, now):
    """What a property is set to or compared with, as the property's own type."""
    if isinstance(e, A.Var):
        given = values[e.name]
    elif isinstance(e, A.Call):
        given = now
    else:
        given = literal(e)
    return convert(given, PropType(want.scalar, True, want.list, want.enum, want.dim), "value")


def as_column(value, kind: PropType) -> Column:
    from hopline.plans.values import column

    return column(value, kind) if value is not None else F.lit(None).cast(kind.spark())


def condition(where: A.Predicate, kind: PropType, values: dict, now) -> Column:
    """The predicate with its value in the column's type; null selects nothing."""
    test = compare(F.col(f"`{where.prop}`"), kind, where.op, as_column(value_of(where.value, kind, values, now), kind), kind)
    return F.coalesce(test, F.lit(False))


HIT = "__hit"


def update(table: DataFrame, sets: list[tuple[str, PropType, object]], cond: Column, stale: list[str] | None = None) -> DataFrame:
    """Set the properties where the condition held before; with ``stale`` null those there too, and keep ``HIT``."""
    changed = {p: as_column(value, kind) for p, kind, value in sets} | {p: F.lit(None) for p in stale or ()}
    hit = table.withColumn(HIT, cond)
    hit = hit.withColumns({p: F.when(F.col(HIT), new).otherwise(F.col(f"`{p}`")) for p, new in changed.items()})
    return hit.drop(HIT) if stale is None else hit


def delete_nodes(catalog: Catalog, kind: str, table: DataFrame, edges: dict[str, DataFrame], cond: Column) -> dict[str, DataFrame]:
    """The tables left after deleting nodes, and with them every edge that touches one."""
    gone = table.filter(cond).select(F.col(ID).alias("__gone"))
    out = {kind: table.filter(~cond)}
    for name, rows in edges.items():
        e = catalog.edges[name]
        ends = [c for c, t in ((SRC, e.source), (DST, e.target)) if t == kind]
        if ends:
            out[name] = reduce(lambda df, c: df.join(gone, F.col(c) == F.col("__gone"), "left_anti"), ends, rows)
    return out


def delete_edges(catalog: Catalog, kind: str, table: DataFrame, where: A.Predicate, nodes, values: dict, now) -> DataFrame:
    """The edges left after deleting by a property, or by an end's key; an unknown key deletes nothing."""
    e = catalog.edges[kind]
    if where.prop not in ("from", "to"):
        return table.filter(~condition(where, e.props[where.prop].type, values, now))
    end, owner = (SRC, e.source) if where.prop == "from" else (DST, e.target)
    key = catalog.nodes[owner].key
    asked = value_of(where.value, PropType("String"), values, now)
    test = compare(F.col("__key"), PropType("String"), where.op, F.lit(asked), PropType("String"))
    found = nodes(owner).select(F.col(ID).alias("__end"), F.col(f"`{key}`").cast("string").alias("__key")).filter(test).select("__end")
    return table.join(found, F.col(end) == F.col("__end"), "left_anti")
