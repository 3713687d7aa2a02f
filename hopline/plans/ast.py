"""What a query text says."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    """A literal; ``kind`` is its scalar type, or ``list`` with ``value`` a tuple of literals."""

    kind: str
    value: object


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Alias:
    name: str


@dataclass(frozen=True)
class Access:
    var: str
    prop: str


@dataclass(frozen=True)
class Call:
    """A function of the language: now, nearest, search, fuzzy, match_text, bm25, rrf or an aggregate."""

    name: str
    args: tuple = ()


AGGREGATES = ("count", "sum", "avg", "min", "max")
RANKS = ("nearest", "bm25")
Expr = Lit | Var | Alias | Access | Call


@dataclass(frozen=True)
class Binding:
    var: str
    type: str
    matches: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class Traversal:
    src: str
    edge: str
    dst: str
    low: int = 1
    high: int | None = 1


@dataclass(frozen=True)
class Filter:
    left: Expr
    op: str
    right: Expr


@dataclass(frozen=True)
class Negation:
    clauses: tuple


@dataclass(frozen=True)
class Projection:
    expr: Expr
    alias: str | None = None

    @property
    def name(self) -> str:
        """The alias, or what the expression itself is called."""
        e = self.expr
        if self.alias:
            return self.alias
        if isinstance(e, Access):
            return e.prop
        return "literal" if isinstance(e, Lit) else e.name


@dataclass(frozen=True)
class Ordering:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Predicate:
    prop: str
    op: str
    value: Expr


@dataclass(frozen=True)
class Mutation:
    """insert, update or delete of ``type``."""

    kind: str
    type: str
    sets: tuple[tuple[str, Expr], ...] = ()
    where: Predicate | None = None


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    nullable: bool = False


@dataclass
class Query:
    name: str
    params: list[Param] = field(default_factory=list)
    description: str | None = None
    instruction: str | None = None
    match: list = field(default_factory=list)
    returns: list[Projection] = field(default_factory=list)
    order: list[Ordering] = field(default_factory=list)
    limit: int | None = None
    mutation: Mutation | None = None
