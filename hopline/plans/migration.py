"""From one schema to another: the steps, how safe each is, and applying them to a stored graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.errors import MigrationError
from hopline.plans.schema import ID, SRC, Catalog, EdgeType, NodeType, Prop, parse_schema

SAFE, CONFIRM, BLOCKED = "safe", "confirm", "blocked"


@dataclass(frozen=True)
class Step:
    """One change: ``kind`` names it, ``safety`` says if it may be done as it is."""

    kind: str
    type: str
    safety: str
    detail: str = ""
    prop: str | None = None
    old: str | None = None


def _paired(old: dict, new: dict) -> tuple[list[tuple], list, list]:
    """((old, new) pairs by name or ``@rename_from``, added, dropped)."""
    pairs, taken = [], set()
    for item in new.values():
        before = item.name if item.name in old else item.renamed_from if item.renamed_from in old else None
        if before is not None and before not in taken:
            taken.add(before)
            pairs.append((old[before], item))
    matched = {b.name for _, b in pairs}
    return pairs, [i for i in new.values() if i.name not in matched], [i for i in old.values() if i.name not in taken]


def diff(old: Catalog, new: Catalog) -> list[Step]:
    """The steps between two schemas, without looking at data: what depends on data is ``confirm``."""
    out: list[Step] = []
    nodes, added, dropped = _paired(old.nodes, new.nodes)
    renamed = {a.name: b.name for a, b in nodes}
    out += [Step("add_node_type", n.name, SAFE) for n in added] + [Step("drop_node_type", n.name, CONFIRM, "its rows and their edges go") for n in dropped]
    edges, added_e, dropped_e = _paired(old.edges, new.edges)
    out += [Step("add_edge_type", e.name, SAFE) for e in added_e] + [Step("drop_edge_type", e.name, CONFIRM, "its rows go") for e in dropped_e]
    for a, b in [*nodes, *edges]:
        part = "node" if isinstance(a, NodeType) else "edge"
        if a.name != b.name:
            out.append(Step(f"rename_{part}_type", b.name, SAFE, old=a.name))
        if isinstance(a, EdgeType) and (renamed.get(a.source), renamed.get(a.target)) != (b.source, b.target):
            out.append(Step("rebind_edge", b.name, BLOCKED, f"{a.source} -> {a.target} can't become {b.source} -> {b.target}"))
        if (a.description, a.instruction) != (b.description, b.instruction):
            out.append(Step("set_type_notes", b.name, SAFE))
        props, more, less = _paired(a.props, b.props)
        for p in more:
            safe = p.type.nullable or p.embed
            out.append(Step("add_property", b.name, SAFE if safe else BLOCKED, "" if safe else "a required property has no value for the rows there are", p.name))
        out += [Step("drop_property", b.name, CONFIRM, "its values go", p.name) for p in less]
        for p, q in props:
            out += _property(b.name, p, q)
    return out


def _property(kind: str, p: Prop, q: Prop) -> list[Step]:
    out = []
    if p.name != q.name:
        out.append(Step("rename_property", kind, SAFE, prop=q.name, old=p.name))
    if p.type.enum and q.type.enum and p.type.enum != q.type.enum:
        fewer = sorted(set(p.type.enum) - set(q.type.enum))
        out.append(Step("shrink_enum" if fewer else "grow_enum", kind, CONFIRM if fewer else SAFE, f"no more {', '.join(fewer)}" if fewer else "", q.name, p.name))
    elif bool(p.type.enum) != bool(q.type.enum):
        out.append(Step("change_type", kind, CONFIRM if q.type.enum else SAFE, f"{p.type} to {q.type}", q.name, p.name))
    elif (p.type.scalar, p.type.list, p.type.dim) != (q.type.scalar, q.type.list, q.type.dim):
        shape = p.type.list != q.type.list or p.type.is_vector or q.type.is_vector
        out.append(Step("change_type", kind, BLOCKED if shape else CONFIRM, f"{p.type} to {q.type}", q.name, p.name))
    if p.type.nullable and not q.type.nullable:
        out.append(Step("require_property", kind, CONFIRM, "no row may be null", q.name, p.name))
    if not p.type.nullable and q.type.nullable:
        out.append(Step("relax_property", kind, SAFE, prop=q.name))
    if p.key != q.key:
        out.append(Step("change_key", kind, BLOCKED, "edges and upserts go by the key", q.name))
    if p.unique != q.unique and not q.key:
        out.append(Step("add_unique" if q.unique else "drop_unique", kind, CONFIRM if q.unique else SAFE, prop=q.name, old=p.name))
    for note in ("index", "embed", "media", "description"):
        if getattr(p, note) != getattr(q, note):
            out.append(Step(f"set_{note}", kind, SAFE, prop=q.name))
    return out


def check_data(steps: list[Step], table) -> list[Step]:
    """The steps with those that the data forbids blocked; ``table`` gives the old rows of a new type name."""
    out = []
    for s in steps:
        rows: DataFrame | None = table(s.type) if s.safety == CONFIRM and s.old else None
        if rows is not None:
            new, c = s, F.col(f"`{s.old}`")
            if s.kind == "require_property" and rows.filter(c.isNull()).limit(1).count():
                new = Step(s.kind, s.type, BLOCKED, "there are null rows", s.prop, s.old)
            elif s.kind == "add_unique" and rows.filter(c.isNotNull()).groupBy(c).count().filter("count > 1").limit(1).count():
                new = Step(s.kind, s.type, BLOCKED, "values repeat", s.prop, s.old)
            out.append(new)
        else:
            out.append(s)
    return out


def _convert(q: Prop, c):
    return c.try_cast(q.type.spark())


def plan(session, schema: str) -> list[Step]:
    """The steps for a stored graph, data looked at."""
    m = session.store.manifest()
    old, new = m.catalog, parse_schema(schema)
    before = {b.name: a.name for a, b in [*_paired(old.nodes, new.nodes)[0], *_paired(old.edges, new.edges)[0]]}

    def table(kind: str) -> DataFrame | None:
        return session.store.table(m, before[kind]) if before.get(kind) in m.tables else None

    steps = check_data(diff(old, new), table)
    for i, s in enumerate(steps):
        rows = table(s.type) if s.kind in ("change_type", "shrink_enum") and s.safety == CONFIRM else None
        if rows is None:
            continue
        q, c = (new.nodes.get(s.type) or new.edges[s.type]).props[s.prop], F.col(f"`{s.old}`")
        if q.type.enum:
            lost = ~c.isin(*q.type.enum) if not q.type.list else F.size(F.array_except(c, F.array(*map(F.lit, q.type.enum)))) > 0
            why = "rows hold other values"
        else:
            back = _convert(q, c).try_cast(rows.schema[s.old].dataType)
            lost, why = back.isNull() | (back != c), "values would be lost"
        if rows.filter(c.isNotNull() & lost).limit(1).count():
            steps[i] = Step(s.kind, s.type, BLOCKED, f"{s.detail}: {why}" if s.detail else why, s.prop, s.old)
    return steps


def apply(session, schema: str, confirm: bool = False, dry_run: bool = False) -> list[Step]:
    """Plan, and unless ``dry_run`` rewrite the tables whose columns change; ids and edges stay."""
    steps = plan(session, schema)
    if dry_run:
        return steps
    blocked = [s for s in steps if s.safety == BLOCKED]
    if blocked:
        raise MigrationError("; ".join(f"{s.kind} {s.type}{'.' + s.prop if s.prop else ''}: {s.detail}" for s in blocked))
    if not confirm and any(s.safety == CONFIRM for s in steps):
        raise MigrationError("confirm: " + "; ".join(f"{s.kind} {s.type}{'.' + s.prop if s.prop else ''}" for s in steps if s.safety == CONFIRM))
    if not steps:
        return steps
    base = session.store.manifest()
    old, new = base.catalog, parse_schema(schema)
    tables, kept = {}, set()
    for pairs in (_paired(old.nodes, new.nodes)[0], _paired(old.edges, new.edges)[0]):
        for a, b in pairs:
            rows = session.store.table(base, a.name)
            if rows is None:
                continue
            kept.add(a.name)
            system = [c for c in rows.columns if c in (ID, SRC, "__dst")]
            was = {q.name: p.name for p, q in _paired(a.props, b.props)[0]}
            values = [(_convert(q, F.col(f"`{was[q.name]}`")) if q.name in was else F.lit(None).cast(q.type.spark())).alias(q.name) for q in b.props.values()]
            tables[b.name] = rows.select(*system, *values)
    # an edge whose node type goes has gone with it: its type can't be in the new schema
    drop = [k for k in base.tables if k not in tables]
    session._commit(base, tables, schema=schema, drop=drop)
    return steps
