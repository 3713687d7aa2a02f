"""A graph: a catalog and a DataFrame for each of its node and edge types."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.errors import HoplineError
from hopline.functions.vector import embed
from hopline.operators.match import Matcher, Scope
from hopline.operators.tail import Tail
from hopline.plans import ast as A
from hopline.plans.check import Checked, check, parameters
from hopline.plans.parser import parse_queries
from hopline.plans.schema import DST, ID, SRC, Catalog, parse_schema
from hopline.plans.types import PropType
from hopline.plans.values import convert, parse_datetime


def utc_now() -> dt.datetime:
    return parse_datetime(dt.datetime.now(dt.UTC))


def bind_params(query: A.Query, given: dict | None) -> dict:
    """The parameter values as their declared types; a missing one is an error, unless it may be null."""
    given, out = dict(given or {}), {}
    for name, kind in parameters(query).items():
        if name not in given and not kind.nullable:
            raise HoplineError(f"parameter ${name} is missing")
        out[name] = convert(given.pop(name, None), kind, f"parameter ${name}")
    if given:
        raise HoplineError(f"unknown parameters: {', '.join('$' + n for n in sorted(given))}")
    return out


class Graph:
    """Tables under a catalog, and the queries over them.

    A node table has ``__id`` and the properties of its type; an edge table
    has ``__id``, ``__src``, ``__dst`` and its properties.  ``distinct_edges``
    names the edge types whose tables hold each (source, target) once, which
    spares queries a shuffle; the store's tables all do.  A table may be given
    as a function that makes it, which is called when a query first needs it.
    ``stored_tokens`` names properties (by node type) whose tokens the table
    holds beside them.
    """

    def __init__(
        self,
        spark: SparkSession,
        catalog: Catalog | str,
        nodes: dict[str, DataFrame | Callable[[], DataFrame]] | None = None,
        edges: dict[str, DataFrame | Callable[[], DataFrame]] | None = None,
        distinct_edges: set[str] | None = None,
        embedder: Callable[[str, int], list[float]] | None = None,
        stored_tokens: dict[str, set[str]] | None = None,
    ):
        self.spark = spark
        self.catalog = parse_schema(catalog) if isinstance(catalog, str) else catalog
        self.nodes, self.edges = dict(nodes or {}), dict(edges or {})
        self.distinct = set(self.edges) if distinct_edges is None else set(distinct_edges)
        self.stored_tokens = stored_tokens or {}
        self.embedder = embedder or (lambda text, dim: embed(text, dim, "query"))

    def node(self, kind: str) -> DataFrame:
        """The table of a node type; an empty one if nothing was loaded."""
        if kind not in self.nodes:
            self.nodes[kind] = self.spark.createDataFrame([], self.catalog.nodes[kind].schema())
        return self._made(self.nodes, kind)

    @staticmethod
    def _made(tables: dict, kind: str) -> DataFrame:
        if callable(tables[kind]):
            tables[kind] = tables[kind]()
        return tables[kind]

    def edge(self, kind: str) -> tuple[DataFrame, bool]:
        """The table of an edge type, and whether its pairs are distinct."""
        if kind not in self.edges:
            self.edges[kind] = self.spark.createDataFrame([], self.catalog.edges[kind].schema())
            self.distinct.add(kind)
        return self._made(self.edges, kind), kind in self.distinct

    def props(self, kind: str) -> dict[str, PropType]:
        return {p.name: p.type for p in self.catalog.nodes[kind].props.values()}

    def check(self, text: str) -> dict[str, Checked | HoplineError]:
        """For each query of a text what the check found, or the rule it breaks."""
        out: dict[str, Checked | HoplineError] = {}
        for name, q in parse_queries(text).items():
            try:
                out[name] = check(self.catalog, q)
            except HoplineError as e:
                out[name] = e
        return out

    def find(self, text: str | A.Query, name: str | None = None) -> A.Query:
        if isinstance(text, A.Query):
            return text
        known = parse_queries(text)
        if name is None and len(known) != 1:
            raise HoplineError(f"name one of the queries: {', '.join(known)}")
        if name is not None and name not in known:
            raise HoplineError(f"no query {name}; there are {', '.join(known)}")
        return known[name] if name else next(iter(known.values()))

    def query(
        self,
        text: str | A.Query,
        params: dict | None = None,
        name: str | None = None,
        *,
        negation: str = "all_vars",
        corpus: str = "match",
        ranks: str = "auto",
        dangling: str = "drop",
        now: dt.datetime | None = None,
    ) -> DataFrame:
        """The lazy result of a read query.

        ``negation="first_var"`` lets only the first outer variable of a
        negated block decide; ``corpus="type"`` takes BM25 statistics from the
        whole node table instead of the matched rows; ``ranks`` says how
        rrf() finds positions: in one sorted sequence ("window"), counted in
        parts ("parts"), or by the size that the optimiser expects ("auto").
        ``dangling="error"`` looks first whether every edge that the query may
        walk has both ends; by default edges without one lead nowhere (stored
        graphs have none).
        """
        q = self.find(text, name)
        if q.mutation:
            raise HoplineError(f"query {q.name} is a mutation; run it on a stored graph")
        checked = check(self.catalog, q)
        if dangling == "error":
            self._sure_of_ends({w.edge for w in checked.walks.values()})
        scope = Scope(checked, bind_params(q, params), now or utc_now(), self.embedder, self.stored_tokens)
        rows = Matcher(self, scope, negation).run(q.match, checked.bindings)
        return Tail(self, scope, rows, corpus, ranks).run()

    def _sure_of_ends(self, kinds: set[str]) -> None:
        for kind in sorted(kinds):
            e, (table, _) = self.catalog.edges[kind], self.edge(kind)
            for end, owner in ((SRC, e.source), (DST, e.target)):
                lost = table.join(self.node(owner).select(F.col(ID).alias("__there")), F.col(end) == F.col("__there"), "left_anti").select(end).limit(1).collect()
                if lost:
                    raise HoplineError(f"edge {kind}: there is no {owner} with id {lost[0][0]}")

    def validate(self) -> DataFrame:
        """(type, problem, n): dangling edge ends, repeated pairs, repeated ids and keys."""
        parts = []

        def add(kind: str, problem: str, counted: DataFrame) -> None:
            parts.append(counted.agg(F.count("*").alias("n")).select(F.lit(kind).alias("type"), F.lit(problem).alias("problem"), "n"))

        for n in self.catalog.nodes.values():
            table = self.node(n.name)
            add(n.name, "repeated id", table.groupBy(ID).count().filter("count > 1"))
            for prop in n.uniques:
                add(n.name, f"repeated {prop}", table.filter(F.col(f"`{prop}`").isNotNull()).groupBy(F.col(f"`{prop}`")).count().filter("count > 1"))
        for e in self.catalog.edges.values():
            table, _ = self.edge(e.name)
            for end, kind in ((SRC, e.source), (DST, e.target)):
                add(e.name, f"dangling {end[2:]}", table.join(self.node(kind).select(F.col(ID).alias("__there")), F.col(end) == F.col("__there"), "left_anti"))
            add(e.name, "repeated pair", table.groupBy(SRC, DST).count().filter("count > 1"))
        out = parts[0] if parts else self.spark.createDataFrame([], "type string, problem string, n bigint")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
