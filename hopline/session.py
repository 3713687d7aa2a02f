"""A stored graph: load, query, change, look back, migrate and maintain it."""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import uuid
from collections.abc import Iterable
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.errors import HoplineError, LoadError, StoreError
from hopline.functions.text import STORED, tokens
from hopline.graph import Graph, bind_params, utc_now
from hopline.operators import load as L
from hopline.operators import mutate as M
from hopline.plans import ast as A
from hopline.plans.check import Checked, check
from hopline.plans.schema import DST, ID, SRC, Catalog, parse_schema
from hopline.sources import jsonl, media
from hopline.sources.store import Manifest, Store


class GraphSession:
    """One stored graph.  Reads are lazy DataFrames over one version; writes make the next version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    # opening

    @classmethod
    def init(cls, spark: SparkSession, path: str, schema: str) -> GraphSession:
        """Make an empty graph."""
        self = cls(spark, path)
        self.store.create(schema)
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphSession:
        self = cls(spark, path)
        self.store.current()
        return self

    @classmethod
    def in_memory(cls, spark: SparkSession, schema: str) -> GraphSession:
        """A graph in a temporary folder of this machine; for tests and small work on one machine."""
        return cls.init(spark, tempfile.mkdtemp(prefix="hopline-graph-") + "/g", schema)

    # reading

    @property
    def version(self) -> int:
        return self.store.current()

    @property
    def catalog(self) -> Catalog:
        return self.store.manifest().catalog

    def graph(self, version: int | None = None) -> Graph:
        """The tables of a version; the graph keeps it, whatever is written later."""
        m = self.store.manifest(version)
        catalog = m.catalog
        tables = {k: partial(self.store.table, m, k, True) for k in m.tables}
        stored = {k: set(props) for k, props in m.tokens.items()}
        return Graph(self.spark, catalog, {k: t for k, t in tables.items() if k in catalog.nodes}, {k: t for k, t in tables.items() if k in catalog.edges}, stored_tokens=stored)

    def check(self, text: str) -> dict[str, Checked | HoplineError]:
        return self.graph().check(text)

    def describe(self) -> dict:
        """The schema with row counts."""
        m = self.store.manifest()
        out = m.catalog.describe()
        for part in ("nodes", "edges"):
            for t in out[part]:
                t["rows"] = m.rows.get(t["name"], 0)
        return {"version": m.version, **out}

    def run(self, text: str, params: dict | None = None, name: str | None = None, **options) -> DataFrame:
        """The result of a read query, or the one row (affected_nodes, affected_edges) of a mutation."""
        graph = self.graph()
        q = graph.find(text, name)
        if q.mutation is None:
            return graph.query(q, params, **options)
        check(graph.catalog, q)
        nodes, edges = self._mutate(q, bind_params(q, params), options.get("now") or utc_now())
        return self.spark.createDataFrame([(nodes, edges)], "affected_nodes bigint, affected_edges bigint")

    def run_arrow(self, text: str, params: dict | None = None, name: str | None = None):
        return self.run(text, params, name).toArrow()

    def run_ipc(self, text: str, params: dict | None = None, name: str | None = None) -> bytes:
        """The result as one Arrow IPC stream."""
        table, sink = self.run_arrow(text, params, name), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    # writing

    def _commit(
        self,
        base: Manifest,
        tables: dict[str, DataFrame],
        next_node: int | None = None,
        next_edge: int | None = None,
        schema: str | None = None,
        drop: Iterable[str] = (),
        added: dict[str, DataFrame] | None = None,
    ) -> Manifest:
        """Write what changed and the next manifest.

        ``tables`` replace those of their types; ``added`` rows go beside the
        rows there are, which are not read or written again.
        """
        added = added or {}
        m = Manifest(**json.loads(json.dumps(base.__dict__)))
        m.version, m.changed = base.version + 1, sorted({*tables, *added})
        m.schema = schema or base.schema
        catalog = m.catalog
        logs = []
        for kind, df in [*tables.items(), *added.items()]:
            owner = catalog.nodes.get(kind) or catalog.edges[kind]
            ordered = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in owner.schema()])
            indexed = [p.name for p in owner.props.values() if p.index and p.type.scalar == "String" and not p.type.list] if kind in catalog.nodes else []
            folder = self.store.write(ordered.withColumns({f"{STORED}{p}": tokens(F.col(f"`{p}`")) for p in indexed}), f"tables/{kind}")
            if kind in tables or kind not in base.tables:
                m.tokens[kind] = indexed
            written = self.store.rows(m, kind, folder)
            old, known = None, 0
            if kind in added:
                m.tables[kind] = [*base.tables.get(kind, ()), folder]
                known = base.rows.get(kind, 0)
            else:
                m.tables[kind] = [folder]
                old = self.store.table(base, kind) if schema is None else None
            m.rows[kind] = known + written.count()
            entity = "node" if kind in catalog.nodes else "edge"
            logs.append(L.diff(kind, entity, m.version, old, written, catalog.nodes[kind].key if entity == "node" else None))
        for kind in drop:
            m.tables.pop(kind, None), m.rows.pop(kind, None), m.tokens.pop(kind, None)
        if logs and schema is None:
            m.changes.append(self.store.write(reduce(DataFrame.unionByName, logs), "changes"))
        m.next_node = base.next_node if next_node is None else next_node
        m.next_edge = base.next_edge if next_edge is None else next_edge
        self.store.publish(m, base.version)
        return m

    def load(self, source: str | list[str], mode: str | None = None, media_base: str | None = None, chunk: int = 0, overlap: int = 128) -> dict[str, int]:
        """Load JSON lines from a path, or a list of lines, and return the rows of each loaded type.

        ``chunk`` and ``overlap`` are those of ``load.fill_embeddings``.
        ``overwrite`` replaces the graph, ``append`` adds nodes, ``merge``
        (the default with any key) upserts by key.  Edges are one row a pair.
        """
        base = self.store.manifest()
        catalog = base.catalog
        mode = mode or L.default_mode(catalog)
        if mode not in L.MODES:
            raise LoadError(f"unknown mode {mode}; there are {', '.join(L.MODES)}")
        if mode == "merge" and not any(n.key for n in catalog.nodes.values()):
            raise LoadError("mode merge needs a key in the schema")
        parsed = jsonl.Parsed(self.spark, catalog, source)
        parsed.check()
        scratch = f"scratch/{uuid.uuid4().hex}"
        tables: dict[str, DataFrame] = {}  # whole new tables
        added: dict[str, DataFrame] = {}  # rows beside those there are
        next_node, next_edge = base.next_node, base.next_edge

        def old(kind: str) -> DataFrame | None:
            return None if mode == "overwrite" else self.store.table(base, kind)

        def now(kind: str) -> DataFrame:
            """A type's rows once the load is done."""
            if kind in tables:
                return tables[kind]
            before = old(kind)
            if kind in added:
                return added[kind] if before is None else before.unionByName(added[kind])
            owner = catalog.nodes.get(kind) or catalog.edges[kind]
            return self.spark.createDataFrame([], owner.schema()) if before is None else before

        def staged(df: DataFrame) -> DataFrame:
            return L.placed(self.spark.read.schema(df.schema).parquet(f"{self.store.path}/{self.store.write(df, scratch)}"))

        try:
            for n in catalog.nodes.values():
                if n.name not in parsed.present:
                    if mode == "overwrite" and n.name in base.tables:
                        tables[n.name] = self.spark.createDataFrame([], n.schema())
                    continue
                rows = jsonl.sure(parsed.nodes(n).sort(jsonl.LINE), n.name)
                for p in n.props.values():
                    if p.media:
                        rows, blobs = media.resolve(rows, p, media_base, n.name)
                        blobs.write.mode("append").parquet(f"{self.store.path}/blobs")
                rows = staged(L.fill_embeddings(rows, n, chunk=chunk, overlap=overlap).sort(jsonl.LINE))
                count = rows.count()
                if mode == "append":
                    added[n.name] = L.merge_nodes(n, None, rows, mode, next_node)
                else:
                    tables[n.name] = L.merge_nodes(n, old(n.name), rows, mode, next_node)
                next_node += count
                before = old(n.name)
                if n.name in added and before is not None:
                    L.check_added(n, before, added[n.name])
                else:
                    L.check_unique(n, now(n.name))
            replaced = [n for n in tables if mode == "merge" and catalog.nodes[n].key is None]
            for e in catalog.edges.values():
                before = old(e.name)
                for column, kind in ((SRC, e.source), (DST, e.target)):
                    if before is not None and kind in replaced:  # ids of an unkeyed type are all new
                        before = before.join(now(kind).select(F.col(ID).alias("__there")), F.col(column) == F.col("__there"), "left_semi")
                        tables[e.name] = before
                if e.name in parsed.present:
                    rows = jsonl.sure(parsed.edges(e), e.name)
                    rows = staged(L.resolve_ends(e, rows, catalog, now).sort(jsonl.LINE))
                    count = rows.count()
                    if e.name not in tables and mode != "overwrite" and not L.known_pairs(before, rows):
                        added[e.name] = L.merge_edges(e, None, rows, next_edge)
                    else:
                        tables[e.name] = L.merge_edges(e, before, rows, next_edge)
                    next_edge += count
                elif mode == "overwrite" and e.name in base.tables:
                    tables[e.name] = self.spark.createDataFrame([], e.schema())
            m = self._commit(base, tables, next_node, next_edge, added=added)
        finally:
            self.store.delete(scratch)
        return {k: m.rows[k] for k in (*tables, *added)}

    def _mutate(self, q: A.Query, values: dict, now: dt.datetime) -> tuple[int, int]:
        mu, base = q.mutation, self.store.manifest()
        catalog = base.catalog
        node, edge = catalog.nodes.get(mu.type), catalog.edges.get(mu.type)
        if mu.kind == "insert":
            if node is not None:
                data = {p: M.value_of(v, node.props[p].type, values, now) for p, v in mu.sets}
                line = {"type": mu.type, "data": {k: _json(v) for k, v in data.items() if v is not None}}
            else:
                given = dict(mu.sets)
                ends = {end: values[given[end].name] if isinstance(given[end], A.Var) else given[end].value for end in ("from", "to")}
                data = {p: M.value_of(v, edge.props[p].type, values, now) for p, v in mu.sets if p not in ("from", "to")}
                line = {"edge": mu.type, **ends, "data": {k: _json(v) for k, v in data.items() if v is not None}}
            self.load([json.dumps(line)], "append")
            return (1, 0) if node is not None else (0, 1)
        table = self.store.table(base, mu.type)
        if table is None:
            return 0, 0
        if edge is not None:

            def nodes(kind: str) -> DataFrame:
                found = self.store.table(base, kind)
                return self.spark.createDataFrame([], catalog.nodes[kind].schema()) if found is None else found

            left = M.delete_edges(catalog, mu.type, table, mu.where, nodes, values, now)
            return 0, self._replace(base, {mu.type: left})[mu.type]
        cond = M.condition(mu.where, node.props[mu.where.prop].type, values, now)
        if mu.kind == "update":
            hit = table.filter(cond).count()
            if hit:
                sets = [(p, node.props[p].type, M.value_of(v, node.props[p].type, values, now)) for p, v in mu.sets]
                for p, kind, v in sets:
                    if v is None and not kind.nullable:
                        raise LoadError(f"{mu.type}.{p} is required")
                # a changed source makes its embedding stale, in the rows that were hit
                stale = [p.name for p in node.props.values() if p.embed in dict(mu.sets) and p.name not in dict(mu.sets)]
                new = M.update(table, sets, cond, stale)
                new = L.fill_embeddings(new, node, stale, where=F.col(M.HIT)).drop(M.HIT)
                L.check_unique(node, new)
                self._commit(base, {mu.type: new})
            return hit, 0
        edges = {k: self.store.table(base, k) for k in base.tables if k in catalog.edges}
        fewer = self._replace(base, M.delete_nodes(catalog, mu.type, table, edges, cond))
        return fewer.pop(mu.type), sum(fewer.values())

    def _replace(self, base: Manifest, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Commit tables that lost rows; how many each lost.  A type that lost none keeps its version."""
        left = {k: df.count() for k, df in tables.items()}
        lost = {k: base.rows[k] - left[k] for k in tables}
        changed = {k: df for k, df in tables.items() if lost[k]}
        if changed:
            self._commit(base, changed)
        return lost

    # the change log

    def changes(self, after: int = 0, upto: int | None = None, vectors: bool = True) -> DataFrame:
        """Change rows of the versions in (after, upto], in the log's order; ``vectors=False`` leaves vectors out of ``row``."""
        rows = self.store.changes(self.store.manifest()).filter(F.col("graph_version") > after)
        if upto is not None:
            rows = rows.filter(F.col("graph_version") <= upto)
        if not vectors:
            for n in self.catalog.nodes.values():
                shape = T.StructType([f for f in n.schema() if f.name not in n.props or not n.props[f.name].type.is_vector])
                rows = rows.withColumn("row", F.when(F.col("type_name") == n.name, F.to_json(F.from_json("row", shape))).otherwise(F.col("row")))
        return rows.orderBy("graph_version", "entity_kind", "type_name", "entity_id", "logical_key", "change_kind")

    def materialize_changes(self, least_new: int = 1) -> int:
        """Rewrite the change log to one table for analysis, if it grew by ``least_new`` rows; the rows it then has."""
        rows = self.changes()
        known = int(self.store.read_text("analytics/COUNT")) if self.store.exists("analytics/COUNT") else 0
        total = rows.count()
        if total - known < least_new:
            return known
        self.store.delete("analytics/changes")
        rows.write.parquet(f"{self.store.path}/analytics/changes")
        self.store.write_text("analytics/COUNT", str(total))
        return total

    # export, embedding, upkeep

    def export(self, ids: bool = False, vectors: bool = True) -> DataFrame:
        g = self.graph()
        return jsonl.export(g.catalog, {k: g.node(k) for k in g.nodes}, {k: g.edge(k)[0] for k in g.edges}, ids, vectors)

    def embed(self, kind: str | None = None, prop: str | None = None, only_null: bool = True, limit: int | None = None, dry_run: bool = False) -> int:
        """Fill embeddings of stored rows; how many rows it fills (or would)."""
        base, filled, tables = self.store.manifest(), 0, {}
        for n in base.catalog.nodes.values():
            targets = [p for p in n.props.values() if p.embed and prop in (None, p.name)]
            if not targets or kind not in (None, n.name) or n.name not in base.tables:
                continue
            table = self.store.table(base, n.name)
            for p in targets:
                open_rows = table.filter(F.col(f"`{p.embed}`").isNotNull())
                if only_null:
                    open_rows = open_rows.filter(F.col(f"`{p.name}`").isNull())
                if limit is not None:
                    open_rows = open_rows.orderBy(ID).limit(max(0, limit - filled))
                count = open_rows.count()
                filled += count
                if count and not dry_run:
                    chosen = open_rows.select(ID)
                    made = L.fill_embeddings(table.join(chosen, ID, "left_semi"), n, [p.name], only_null)
                    table = table.join(chosen, ID, "left_anti").unionByName(made.select(*[f"`{c}`" for c in table.columns]))
                    tables[n.name] = table
        if tables:
            self._commit(base, tables)
        return filled

    def compact(self, rows_per_file: int = 1_048_576) -> dict[str, int]:
        """Rewrite tables of more files than ``rows_per_file`` asks for; the files that each then has.

        Deleted rows never stay in a table, so there are none to purge.
        """
        base, out = self.store.manifest(), {}
        m = Manifest(**json.loads(json.dumps(base.__dict__)))
        m.version, m.changed = base.version + 1, []
        for kind in base.tables:
            files = max(1, -(-base.rows[kind] // rows_per_file))
            if len(self.store.files(base, kind)) <= files:
                out[kind] = len(self.store.files(base, kind))
                continue
            owner = base.catalog.nodes.get(kind) or base.catalog.edges[kind]
            key = ID if kind in base.catalog.nodes else SRC
            table = self.store.table(base, kind, True)
            # sorted ranges: key lookups then prune files and row groups by their bounds
            columns = [*(f.name for f in owner.schema()), *(f"{STORED}{p}" for p in m.tokens.get(kind, ()))]
            m.tables[kind] = [self.store.write(table.repartitionByRange(files, key).sortWithinPartitions(key).select(*[f"`{c}`" for c in columns]), f"tables/{kind}")]
            out[kind] = files
        if m.tables != base.tables:
            self.store.publish(m, base.version)
        return out

    def cleanup(self, keep: int = 128, tables: int | None = None) -> int:
        """Forget versions but the newest ``keep``, and delete folders that none names; the folders deleted.

        With ``tables`` only so many newest states of each table stay, though
        the change log goes back further; older versions can't be read then.
        """
        versions = self.store.versions()
        for v in versions[: max(0, len(versions) - keep)]:
            self.store.delete(f"manifests/{v}.json")
        live: set[str] = set()
        states: dict[str, list[list[str]]] = {}
        for v in reversed(self.store.versions()):
            m = self.store.manifest(v)
            live |= set(m.changes)
            for kind, folders in m.tables.items():
                known = states.setdefault(kind, [])
                if folders not in known and (tables is None or len(known) < tables):
                    known.append(folders)
        live |= {folder for known in states.values() for folders in known for folder in folders}
        gone = 0
        for folder in [f"tables/{k}" for k in self.store.names("tables")] + ["changes"]:
            for name in self.store.names(folder):
                if f"{folder}/{name}" not in live:
                    self.store.delete(f"{folder}/{name}")
                    gone += 1
        return gone

    def storage(self) -> list[dict]:
        """Rows, files and bytes of each table of the newest version."""
        m, out = self.store.manifest(), []
        for kind in m.tables:
            sizes = self.store.files(m, kind)
            out.append({"type": kind, "rows": m.rows[kind], "folders": len(m.tables[kind]), "files": len(sizes), "bytes": sum(sizes)})
        return out

    def doctor(self) -> DataFrame:
        """(type, problem, n) of everything that is wrong; no rows if nothing is."""
        m = self.store.manifest()
        missing = [k for k, folders in m.tables.items() if not all(map(self.store.exists, folders))]
        if missing:
            return self.spark.createDataFrame([(k, "missing folder", 1) for k in missing], "type string, problem string, n bigint")
        return self.graph().validate().filter("n > 0")

    def migrate(self, schema: str, confirm: bool = False, dry_run: bool = False):
        """Change the schema; see ``hopline.plans.migration``."""
        from hopline.plans.migration import apply

        return apply(self, schema, confirm, dry_run)

    def close(self) -> None:
        """Nothing is held open; here for callers that close what they open."""


def _json(value):
    """A converted value as the load format writes it."""
    if isinstance(value, dt.datetime):
        return value.isoformat(timespec="milliseconds") + "Z"
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [_json(x) for x in value]
    return int(value) if type(value).__name__ == "Decimal" else value


def open_graph(spark: SparkSession, path: str, schema: str | None = None) -> GraphSession:
    """Open a stored graph, or make it if there is none and a schema is given."""
    try:
        return GraphSession.open(spark, path)
    except StoreError:
        if schema is None:
            raise
        parse_schema(schema)
        return GraphSession.init(spark, path, schema)
