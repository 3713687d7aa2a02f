"""Property types and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

#: The scalar names of the language.
SCALARS = ("String", "Bool", "I32", "I64", "U32", "U64", "F32", "F64", "Date", "DateTime")
NUMERIC = ("I32", "I64", "U32", "U64", "F32", "F64")
INTEGERS = ("I32", "I64", "U32", "U64")

_SPARK = {
    "String": T.StringType(),
    "Bool": T.BooleanType(),
    "I32": T.IntegerType(),
    "I64": T.LongType(),
    "U32": T.LongType(),
    "U64": T.DecimalType(20, 0),
    "F32": T.FloatType(),
    "F64": T.DoubleType(),
    "Date": T.DateType(),
    "DateTime": T.TimestampNTZType(),
}
#: Least and greatest value of the unsigned types, which Spark lacks.
RANGES = {"U32": (0, 2**32 - 1), "U64": (0, 2**64 - 1)}


@dataclass(frozen=True)
class PropType:
    """A scalar, list, enum or vector type; ``dim`` is a vector's length."""

    scalar: str
    nullable: bool = False
    list: bool = False
    enum: tuple[str, ...] | None = None
    dim: int | None = None

    @property
    def is_vector(self) -> bool:
        return self.scalar == "Vector"

    @property
    def is_numeric(self) -> bool:
        return self.scalar in NUMERIC and not self.list

    @property
    def element(self) -> PropType:
        return replace(self, list=False)

    def spark(self) -> T.DataType:
        base = T.ArrayType(T.FloatType()) if self.is_vector else _SPARK[self.scalar]
        return T.ArrayType(base) if self.list else base

    def __str__(self) -> str:
        name = f"Vector({self.dim})" if self.is_vector else f"enum({', '.join(self.enum)})" if self.enum else self.scalar
        return (f"[{name}]" if self.list else name) + ("?" if self.nullable else "")


def scalar_of(name: str, nullable: bool = False) -> PropType | None:
    """The type that a parameter's or property's written scalar name means."""
    if name in SCALARS:
        return PropType(name, nullable)
    if name.startswith("Vector(") and name[7:-1].isdigit():
        return PropType("Vector", nullable, dim=int(name[7:-1]))
    return None


def compatible(left: PropType, right: PropType) -> bool:
    """Whether values of the two types compare: all numbers do, other scalars only with their like."""
    if left.list != right.list:
        return False
    if left.is_vector or right.is_vector:
        return left.is_vector and right.is_vector and left.dim == right.dim
    return left.scalar == right.scalar or left.scalar in NUMERIC and right.scalar in NUMERIC
