"""What follows a match: scores, grouping, projection, order and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.functions import rank
from hopline.functions.text import STORED
from hopline.operators.bindings import Rows, key, name
from hopline.operators.match import Scope
from hopline.plans import ast as A
from hopline.plans.check import NodeValue, has_aggregate
from hopline.plans.schema import ID

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": lambda c: F.avg(c.cast("double")), "min": F.min, "max": F.max}


class Tail:
    """Turns binding rows into the result of a query.

    Score expressions that need all rows (bm25, rrf) become columns once,
    however often the query names them, over the rows after all clauses and
    before order and limit.
    """

    def __init__(self, graph, scope: Scope, rows: Rows, corpus: str = "match", ranks: str = "auto"):
        self.graph, self.scope, self.rows, self.corpus, self.ranks = graph, scope, rows, corpus, ranks
        self.df, self.scores = rows.df, {}

    def bound(self) -> dict[str, str]:
        return self.scope.checked.bindings

    def score(self, e: A.Call) -> Column:
        """The column of a score expression, made on first use."""
        if e in self.scores:
            return F.col(self.scores[e])
        if e.name == "bm25":
            self.texts(e)
            return F.col(self.scores[e])
        ranks = [(self._named(r), r.name == "bm25") for r in e.args[:2]] if e.name == "rrf" else []
        out = f"__score{len(self.scores)}"
        if e.name == "rrf":
            k = self.scope.constant(e.args[2])[1] if len(e.args) == 3 else rank.RRF_K
            ties = [name(v, ID) for v in sorted(self.rows.vars)]
            parts = rank.in_parts(self.rows.df, ties) if self.ranks == "auto" else self.ranks == "parts"
            self.df = rank.rrf(self.df, ranks, ties, rank.RRF_K if k is None else k, out, parts)
        else:
            self.df = self.df.withColumn(out, self.scope.call(e, self.bound()))
        self.scores[e] = out
        return F.col(out)

    def texts(self, e: A.Call) -> None:
        """The columns of all bm25 scores of the query on the field of ``e``, from one set of statistics."""
        alike = [c for c in dict.fromkeys(self.bm25_calls()) if c.args[0] == e.args[0]]
        queries = {}
        for call in alike:
            known, query = self.scope.constant(call.args[1])
            if not known:
                raise ValueError("bm25() needs a constant query")
            self.scores[call] = f"__score{len(self.scores)}"
            queries[self.scores[call]] = query
        corpus = None
        if self.corpus == "type" and isinstance(e.args[0], A.Access):
            kind, prop = self.bound()[e.args[0].var], e.args[0].prop
            tokens = F.col(f"`{STORED}{prop}`") if prop in self.scope.stored.get(kind, ()) else None
            corpus = (self.graph.node(kind), F.col(f"`{prop}`"), tokens)
        field, stored = self.scope.column(e.args[0], self.bound())[0], self.scope.tokens(e.args[0], self.bound())
        self.df = rank.bm25(self.df, field, queries, corpus, str(len(self.scores)), stored)

    def bm25_calls(self) -> list[A.Call]:
        """Every bm25() that the query returns or orders by, those inside rrf() too."""
        q, checked = self.scope.checked.query, self.scope.checked
        found: list[A.Call] = []

        def look(e) -> None:
            if isinstance(e, A.Call):
                if e.name == "bm25":
                    found.append(e)
                for x in e.args:
                    look(x)

        for e in [*(p.expr for p in q.returns), *(checked.aliases[o.expr.name] if isinstance(o.expr, A.Alias) else o.expr for o in q.order)]:
            look(e)
        return found

    def _named(self, e: A.Call) -> str:
        self.score(e)
        return self.scores[e]

    def value(self, e: A.Expr) -> Column:
        kind = self.scope.checked.type_of(e)
        if isinstance(kind, NodeValue):
            return self.rows.struct(e.name, list(self.graph.props(kind.type)))
        if isinstance(e, A.Call) and e.name in ("bm25", "rrf", "nearest"):
            return self.score(e)
        return self.scope.column(e, self.bound())[0]

    def aggregate(self, e: A.Call) -> Column:
        kind = self.scope.checked.type_of(e.args[0])
        arg = key(e.args[0].name) if isinstance(kind, NodeValue) else self.value(e.args[0])
        out = AGGREGATES[e.name](arg)
        wide = self.scope.checked.type_of(e)
        return out.cast(wide.spark()) if e.name in ("sum", "avg") else out

    def run(self) -> DataFrame:
        q, checked = self.scope.checked.query, self.scope.checked
        columns = [f"__c{i}" for i in range(len(q.returns))]
        grouped = any(has_aggregate(p.expr) for p in q.returns)
        order: list[tuple[str, bool]] = []
        extra: dict[str, A.Expr] = {}
        for i, o in enumerate(q.order):
            real = checked.aliases[o.expr.name] if isinstance(o.expr, A.Alias) else o.expr
            at = next((c for c, p in zip(columns, q.returns) if p.expr == real), None)
            if at is None:
                at = f"__o{i}"
                extra[at] = real
            order.append((at, o.descending))
        # plain sorts need a tie-break only where the language has one: nearest goes by node id
        near = [o.expr for o in q.order if isinstance(o.expr, A.Call) and o.expr.name == "nearest"]
        if near and not grouped:
            extra["__tie"] = near[0]
            order.append(("__tie", False))
        made: dict[str, Column] = {}
        for c, e in [*zip(columns, (p.expr for p in q.returns)), *extra.items()]:
            if c == "__tie":
                made[c] = key(e.args[0].var)
            elif has_aggregate(e):
                made[c] = self.aggregate(e)
            else:
                made[c] = self.value(e)
        if grouped:
            sums = {c for c, e in [*zip(columns, (p.expr for p in q.returns)), *extra.items()] if c != "__tie" and has_aggregate(e)}
            loose = [c for c in extra if c not in sums]
            if loose:
                raise ValueError("a grouped query can only be ordered by what it returns or by aggregates")
            keys = [c for c in columns if c not in sums]
            flat = self.df.groupBy(*[made[c].alias(c) for c in keys]).agg(*[made[c].alias(c) for c in made if c in sums])
        else:
            flat = self.df.select(*[x.alias(c) for c, x in made.items()])
        if order:
            flat = flat.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order])
        if q.limit is not None:
            flat = flat.limit(q.limit)
        return flat.select(*columns).toDF(*[p.name for p in q.returns])

