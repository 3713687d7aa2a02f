"""Binding rows: flat DataFrames whose columns are named ``variable::property``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.plans.schema import ID


def name(var: str, prop: str) -> str:
    return f"{var}::{prop}"


def ref(var: str, prop: str) -> Column:
    return F.col(f"`{name(var, prop)}`")


def key(var: str) -> Column:
    """The node id of a variable."""
    return ref(var, ID)


def expected_bytes(df: DataFrame) -> int:
    """What the optimiser expects; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def read_bytes(df: DataFrame) -> int:
    """The size of all tables that it reads, as the optimiser knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


@dataclass
class Rows:
    """The rows of some bound variables (name to node type); ``whole`` if they are all nodes of one type, ``product`` if they are pairs of separate rows."""

    df: DataFrame
    vars: dict[str, str]
    whole: bool = False
    product: bool = False

    def struct(self, var: str, props: list[str]) -> Column:
        """A whole node: its id and its properties."""
        label = "id" if "id" not in props else ID
        return F.struct(key(var).alias(label), *[ref(var, p).alias(p) for p in props])


def scan(table: DataFrame, var: str, kind: str) -> Rows:
    """Every node of a type, as rows of one variable; the optimiser prunes what nothing asks for."""
    return Rows(table.select(*[F.col(f"`{c}`").alias(name(var, c)) for c in table.columns]), {var: kind}, whole=True)
