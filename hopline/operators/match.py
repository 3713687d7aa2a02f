"""From the clauses of a match to one DataFrame of binding rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.functions import text as text_fn
from hopline.functions import vector as vector_fn
from hopline.operators import compare, expand
from hopline.operators.bindings import Rows, key, name, ref, scan
from hopline.plans import ast as A
from hopline.plans.check import Checked, accesses, literal_type, variables
from hopline.plans.schema import ID
from hopline.plans.types import PropType
from hopline.plans.values import column, literal


class Scope:
    """Expressions of one query: parameter values, the time, and the types of variables."""

    def __init__(self, checked: Checked, values: dict, now, embed: Callable[[str, int], list[float]], stored: dict[str, set[str]] | None = None):
        self.checked, self.values, self.now, self.embed, self.stored = checked, values, now, embed, stored or {}

    def tokens(self, e: A.Expr, bound: dict[str, str]) -> Column | None:
        """The stored tokens of a property, if its type's table holds them."""
        if isinstance(e, A.Access) and e.prop in self.stored.get(bound.get(e.var, ""), ()):
            return ref(e.var, f"{text_fn.STORED}{e.prop}")
        return None

    def constant(self, e: A.Expr):
        """(whether it is one, its Python value) for literals, parameters and now()."""
        if isinstance(e, A.Lit):
            return True, literal(e)
        if isinstance(e, A.Var) and e.name in self.checked.params:
            return True, self.values[e.name]
        if isinstance(e, A.Call) and e.name == "now":
            return True, self.now
        return False, None

    def column(self, e: A.Expr, bound: dict[str, str]) -> tuple[Column, PropType]:
        kind = self.checked.type_of(e, bound)
        known, value = self.constant(e)
        if known:
            return column(value, kind), kind
        if isinstance(e, A.Access):
            return ref(e.var, e.prop), kind
        return self.call(e, bound), kind

    def call(self, e: A.Call, bound: dict[str, str]) -> Column:
        """Functions of one row; bm25 and rrf need all rows and are made by the tail."""
        if e.name == "nearest":
            return vector_fn.cosine_distance(ref(e.args[0].var, e.args[0].prop), self.asked(e, bound))
        field = self.column(e.args[0], bound)[0]
        known, value = self.constant(e.args[1])
        query = value if known else self.column(e.args[1], bound)[0]
        stored = self.tokens(e.args[0], bound)
        if e.name == "search":
            return text_fn.search(field, query, stored)
        if e.name == "match_text":
            return text_fn.match_text(field, query, stored)
        edits = None
        if len(e.args) == 3:
            known, edits = self.constant(e.args[2])
            if not known or edits is not None and edits < 0:
                raise ValueError("fuzzy() needs a constant number of edits, 0 or more")
        return text_fn.fuzzy(field, query, edits, stored)

    def asked(self, e: A.Call, bound: dict[str, str]) -> list[float]:
        """The vector that nearest() compares with; a text is embedded, on the driver, as a query."""
        known, value = self.constant(e.args[1])
        if not known or value is None:
            raise ValueError("nearest() needs a constant vector or text")
        kind = self.checked.type_of(e.args[0], bound)
        return self.embed(value, kind.dim) if isinstance(value, str) else [float(x) for x in value]

    def condition(self, f: A.Filter, bound: dict[str, str]) -> Column:
        left, op, right = f.left, f.op, f.right
        if op == "contains":
            return compare.contains(*self.column(left, bound), *self.column(right, bound))
        if self.constant(left)[0] and not self.constant(right)[0]:
            left, op, right = right, compare.FLIPPED[op], left
        return compare.compare(*self.column(left, bound)[:1], self.checked.type_of(left, bound), op, *self.column(right, bound))

    def matches(self, b: A.Binding, props: dict[str, PropType]) -> list[Column]:
        out = []
        for prop, value in b.matches:
            kind = props[prop]
            given = literal_type(value) if isinstance(value, A.Lit) else self.checked.type_of(value, {})
            if kind.is_vector:
                out.append(ref(b.var, prop) == column(self.constant(value)[1], kind))
                continue
            item = column(self.constant(value)[1], given)
            out.append(compare.contains(ref(b.var, prop), kind, item, given) if kind.list else compare.compare(ref(b.var, prop), kind, "=", item, given))
        return out


class Matcher:
    """Joins the clauses of one block.

    Bindings come first, then traversals in an order in which each continues
    from what is bound, then filters, each as soon as its variables are in one
    set of rows.  Separate sets are only cross-joined if no traversal or
    comparison connects them, and negations come before that: those that
    decide within one set there, others as tests of the pairs that are made.
    """

    def __init__(self, graph, scope: Scope, negation: str = "all_vars"):
        self.graph, self.scope, self.negation, self.fresh = graph, scope, negation, count()

    def run(self, clauses, bound: dict[str, str], seeds: Sequence[Rows] = ()) -> Rows:
        sets: list[Rows] = list(seeds)
        # a negated block of one hop finds the same pairs if its edges repeat them
        one_hop = bool(seeds) and sum(not isinstance(c, A.Filter) for c in clauses) == 1

        def of(var: str) -> Rows | None:
            return next((s for s in sets if var in s.vars), None)

        def replace(new: Rows, *old: Rows) -> Rows:
            sets[:] = [s for s in sets if all(s is not o for o in old)] + [new]
            return new

        def start(var: str, kind: str) -> Rows:
            sets.append(scan(self.graph.node(kind), var, kind))
            return sets[-1]

        for b in (c for c in clauses if isinstance(c, A.Binding)):
            rows = of(b.var) or start(b.var, b.type)
            tests = self.scope.matches(b, self.graph.props(b.type))
            if tests:
                replace(Rows(rows.df.filter(reduce(Column.__and__, tests)), rows.vars), rows)

        filters = [c for c in clauses if isinstance(c, A.Filter)]
        node_vars = {id(f): variables(f) & set(bound) for f in filters}

        def settle() -> None:
            for f in list(filters):
                rows = next((s for s in sets if node_vars[id(f)] <= set(s.vars)), None)
                if rows is not None:
                    filters.remove(f)
                    replace(Rows(rows.df.filter(self.scope.condition(f, bound)), rows.vars), rows)

        settle()
        waiting = [self.scope.checked.walks[id(c)] for c in clauses if isinstance(c, A.Traversal)]
        while waiting:
            walk = next((w for w in waiting if of(w.src) or of(w.dst)), waiting[0])
            waiting.remove(walk)
            self.walk(walk, of, replace, start, one_hop and walk.high == 1)
            settle()
        # what is still apart meets on comparisons first
        for f in list(filters):
            apart = []
            for var in sorted(node_vars[id(f)]):
                if of(var) is not None and of(var) not in apart:
                    apart.append(of(var))
            if len(apart) > 1:
                joined = apart[0]
                for other in apart[1:]:
                    joined = replace(Rows(joined.df.crossJoin(other.df), joined.vars | other.vars), joined, other)
                settle()
        for f in filters:  # of constants only
            sets[0] = Rows(sets[0].df.filter(self.scope.condition(f, bound)), sets[0].vars)
        return self.product(sets, [c for c in clauses if isinstance(c, A.Negation)])

    def product(self, sets: list[Rows], negations: list[A.Negation]) -> Rows:
        """All combinations of separate sets for which no negated block matches."""
        tests = []
        for n in negations:
            what, keys = self.excluded(sets, n)
            at = [i for i, s in enumerate(sets) if set(keys) & set(s.vars)] or [0]
            if len(at) > 1:
                tests.append((what, keys))
            else:
                sets[at[0]] = expand.without(sets[at[0]], what, keys)
        rows = sets[0]
        for other in sets[1:]:
            both = set(rows.vars) | set(other.vars)
            rows = expand.product(rows, other, [t for t in tests if set(t[1]) <= both], self.asked)
            tests = [t for t in tests if not set(t[1]) <= both]
        return rows

    def asked(self, rows: Rows) -> list[str]:
        """The columns that the query may still ask for: ids, and what it names anywhere."""
        q = self.scope.checked.query
        known = accesses([*q.match, *q.returns, *q.order])
        return [c for v in rows.vars for c in self.held(rows, v) if c == name(v, ID) or (v, None) in known or any(c in (name(v, p), name(v, f"{text_fn.STORED}{p}")) for x, p in known if x == v)]

    def held(self, rows: Rows, var: str) -> list[str]:
        kind = rows.vars[var]
        return [name(var, c) for c in (ID, *self.graph.props(kind), *(f"{text_fn.STORED}{p}" for p in sorted(self.scope.stored.get(kind, ()))))]

    def walk(self, w, of, replace, start, repeats: bool = False) -> None:
        edges, distinct = self.graph.edge(w.edge)
        distinct = distinct or repeats
        src, dst = of(w.src), of(w.dst)
        if src is None and (dst is None or w.src != "_") and dst is None:
            src = start(w.src if w.src != "_" else f"_{next(self.fresh)}", w.src_type)
        if src is None:  # go backwards from the bound end
            self.step(dst, w.dst, edges, not w.out, distinct, w, w.src, w.src_type, replace)
            return
        at = next(v for v in src.vars if v == w.src or w.src == "_" and v.startswith("_"))
        if dst is None:
            self.step(src, at, edges, w.out, distinct, w, w.dst, w.dst_type, replace)
            return
        links = self.links(src, at, edges, w.out, distinct, w)
        if src is dst:
            replace(expand.between(src, at, links, w.dst), src)
        else:
            replace(expand.across(src, at, links, w.dst, dst), src, dst)

    def links(self, rows: Rows, at: str, edges: DataFrame, out: bool, distinct: bool, w) -> DataFrame:
        pairs = expand.pairs(edges, out, distinct)
        e = self.graph.catalog.edges[w.edge]
        if e.source != e.target:  # nothing leads on from where the first hop ends
            return pairs if w.low == 1 else pairs.limit(0)
        origins = rows.df.select(key(at).alias(ID)).distinct() if w.high > 1 else None
        return expand.reach(pairs, w.low, w.high, origins)

    def step(self, rows: Rows, at: str, edges, out, distinct, w, new: str, kind: str, replace) -> None:
        links = self.links(rows, at, edges, out, distinct, w)
        target = None if new == "_" else self.graph.node(kind)
        replace(expand.to_new(rows, at, links, new, target, kind), rows)

    def excluded(self, sets: list[Rows], n: A.Negation) -> tuple[Column | DataFrame, list[str]]:
        """What a negated block takes away, and the outer variables that decide: a condition, or the ids for which it matches.

        It matches with the values of all outer variables that it names; with
        ``negation="first_var"`` only the first such variable decides.
        """
        bound = self.scope.checked.inner[id(n)]
        known = {v: kind for s in sets for v, kind in s.vars.items()}
        outer = [v for v in _in_order(n) if v in known]
        keys = outer[:1] if self.negation == "first_var" else outer
        own = [c for c in n.clauses if isinstance(c, A.Filter)]
        if len(own) == len(n.clauses) and all((variables(c) & set(bound)) <= set(known) for c in own):
            hit = reduce(Column.__and__, [F.coalesce(self.scope.condition(c, bound), F.lit(False)) for c in own])
            return hit, outer
        hits = self.run(n.clauses, bound, [self.seed(s, [v for v in outer if v in s.vars]) for s in sets if set(outer) & set(s.vars)]).df
        return hits.select(*[key(v).alias(f"__hit{i}") for i, v in enumerate(keys)]).distinct(), keys

    def seed(self, rows: Rows, outer: list[str]) -> Rows:
        """Where a negated block starts from: what the match has reached of these variables, each combination once."""
        if len(outer) == 1 and rows.whole:
            kind = rows.vars[outer[0]]
            return scan(self.graph.node(kind), outer[0], kind)
        held = [c for v in outer for c in self.held(rows, v)]
        return Rows(rows.df.select(*[f"`{c}`" for c in held]).dropDuplicates([name(v, ID) for v in outer]), {v: rows.vars[v] for v in outer})


def _in_order(n: A.Negation) -> list[str]:
    """The variables of a block in the order in which the text names them."""
    seen: list[str] = []
    for c in n.clauses:
        named = [c.src, c.dst] if isinstance(c, A.Traversal) else _in_order(c) if isinstance(c, A.Negation) else sorted(variables(c))
        seen += [v for v in named if v not in seen]
    return seen
