"""Registered queries over stored graphs: each makes one in the shared folder, changes it and shows what is there.

Internal ids follow the order of the input files, so results name rows by key.
"""

from __future__ import annotations

import contextlib
import io
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path
from tempfile import TemporaryDirectory

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline import cli
from hopline.errors import HoplineError
from hopline.plans.schema import DST, SRC, parse_schema
from hopline.session import GraphSession
from hopline.sources import jsonl, media, staging
from hopline.sources.adapters import star_graph
from hopline.streaming.changes import counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SCHEMA = """
node Region { r_regionkey: I32 @key  r_name: String }
node Nation { n_nationkey: I32 @key  n_name: String @unique  n_regionkey: I32? }
node Supplier { s_suppkey: I64 @key  s_name: String  s_nationkey: I32?  note: String?  v: Vector(4)? @embed(note) }
edge InRegion: Nation -> Region { since: Date? }
edge SupplierIn: Supplier -> Nation
"""
#: Suppliers as the load writes them: every third has a note.
NOTE = "CASE WHEN s_suppkey % 3 = 0 THEN 'note ' || (s_suppkey % 5) END"


def registered(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def nodes(kind: str, rows: DataFrame, *props: str) -> DataFrame:
        return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*props).alias("data"))).alias("value"))

    def edges(kind: str, rows: DataFrame, a: str, b: str) -> DataFrame:
        return rows.select(F.to_json(F.struct(F.lit(kind).alias("edge"), F.col(a).cast("string").alias("from"), F.col(b).cast("string").alias("to"))).alias("value"))

    suppliers = table("supplier").withColumn("note", F.expr(NOTE))
    parts = [
        edges("InRegion", table("nation"), "n_nationkey", "n_regionkey"),
        nodes("Region", table("region"), "r_regionkey", "r_name"),
        nodes("Nation", table("nation"), "n_nationkey", "n_name", "n_regionkey"),
        nodes("Supplier", suppliers, "s_suppkey", "s_name", "s_nationkey", "note"),
        edges("SupplierIn", suppliers, "s_suppkey", "s_nationkey"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _graph(spark: SparkSession, sf_dir: str) -> GraphSession:
    """A stored graph of regions, nations and suppliers, loaded from lines in files."""
    home = f"{staging.own_dir(spark)}/stored-{uuid.uuid4().hex}"
    _lines(spark, sf_dir).write.text(f"{home}/lines")
    g = GraphSession.init(spark, f"{home}/graph", SCHEMA)
    g.load(f"{home}/lines")
    return g


def _rows(g: GraphSession) -> DataFrame:
    info = g.describe()
    return g.spark.createDataFrame([(t["name"], t["rows"]) for part in ("nodes", "edges") for t in info[part]], "type string, n bigint")


COUNTS = """SELECT 'Region' AS type, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Supplier', count(*) FROM supplier
    UNION ALL SELECT 'InRegion', count(*) FROM nation UNION ALL SELECT 'SupplierIn', count(*) FROM supplier"""


@registered(COUNTS)
def stored_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_graph(spark, sf_dir))


@registered("""SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def stored_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).run("query q() { match { $s: Supplier  $s supplierIn $n  $n inRegion $r } return { $s.s_suppkey, $n.n_name, $r.r_name } }")


@registered("""SELECT n_nationkey, n_regionkey AS r_regionkey, NULL::DATE AS since FROM nation WHERE n_nationkey <> 4
    UNION ALL SELECT n_nationkey, n_regionkey, CASE WHEN n_regionkey = 4 THEN DATE '2021-03-04' END FROM nation WHERE n_nationkey = 4
    UNION ALL SELECT 4, 99, DATE '2020-01-02'""")
def stored_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node, an edge to it, and an edge that is there already, which takes the new property."""
    g = _graph(spark, sf_dir)
    g.run('query q() { insert Region { r_regionkey: 99, r_name: "NEW" } }')
    g.run('query q($n: String) { insert InRegion { from: $n, to: "99", since: date("2020-01-02") } }', {"n": "4"})
    g.run('query q() { insert InRegion { from: "4", to: "4", since: date("2021-03-04") } }')
    now = g.graph()
    nation, region = (now.node(k).select(F.col("__id").alias(f"{k}_id"), key) for k, key in (("Nation", "n_nationkey"), ("Region", "r_regionkey")))
    edges = now.edge("InRegion")[0].join(nation, F.col(SRC) == F.col("Nation_id")).join(region, F.col(DST) == F.col("Region_id"))
    return edges.select("n_nationkey", "r_regionkey", "since")


@registered(f"""SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'late' ELSE {NOTE} END AS note, s_nationkey = 3 OR s_suppkey % 3 = 0 AS embedded, s_nationkey = 3 AS renewed FROM supplier""")
def stored_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of one nation; their vectors are made anew, those of others stay."""
    g = _graph(spark, sf_dir)
    before = g.graph(1).node("Supplier").select("__id", F.col("v").alias("was"))
    g.run('query q() { update Supplier set { note: "late" } where s_nationkey = 3 }')
    now = g.graph().node("Supplier").join(before, "__id")
    return now.select("s_suppkey", "note", F.col("v").isNotNull().alias("embedded"), (~F.col("v").eqNullSafe(F.col("was"))).alias("renewed"))


@registered("""SELECT 'Region' AS type, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'Supplier', count(*) FROM supplier
    UNION ALL SELECT 'InRegion', count(*) FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'SupplierIn', count(*) FROM supplier WHERE s_nationkey <> 3""")
def stored_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    g.run("query q() { delete Nation where n_nationkey = 3 }")
    return _rows(g)


@registered("""SELECT mode, r_regionkey, r_name FROM (
    SELECT 'merge' AS mode, r_regionkey, CASE WHEN r_regionkey = 2 THEN 'RENAMED' ELSE r_name END AS r_name FROM region UNION ALL VALUES ('merge', 70, 'NORTH')
    UNION ALL SELECT 'append', r_regionkey, CASE WHEN r_regionkey = 2 THEN 'RENAMED' ELSE r_name END FROM region UNION ALL VALUES ('append', 70, 'NORTH'), ('append', 71, 'SOUTH'), ('overwrite', 1, 'ONLY'))""")
def stored_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions after a load of each mode, one after the other."""
    g, seen = _graph(spark, sf_dir), []
    line = '{"type":"Region","data":{"r_regionkey":%d,"r_name":"%s"}}'
    for mode, rows in (("merge", [(2, "RENAMED"), (70, "NORTH")]), ("append", [(71, "SOUTH")]), ("overwrite", [(1, "ONLY")])):
        g.load([line % r for r in rows], mode)
        seen.append(g.graph().node("Region").select(F.lit(mode).alias("mode"), "r_regionkey", "r_name"))
    return reduce(DataFrame.unionByName, seen)


_REFUSED = {
    "duplicate key": '{"type":"Region","data":{"r_regionkey":1,"r_name":"x"}}',
    "duplicate unique": '{"type":"Nation","data":{"n_nationkey":500,"n_name":"NATION_3"}}',
    "key twice": '{"type":"Region","data":{"r_regionkey":50,"r_name":"x"}}\n{"type":"Region","data":{"r_regionkey":50,"r_name":"y"}}',
    "no such end": '{"edge":"InRegion","from":"900","to":"1"}',
    "unknown type": '{"type":"Sea","data":{}}',
    "wrong type": '{"type":"Region","data":{"r_regionkey":"a","r_name":"x"}}',
    "missing": '{"type":"Region","data":{"r_regionkey":51}}',
    "unknown property": '{"type":"Region","data":{"r_regionkey":52,"r_name":"x","depth":1}}',
}


@registered(" UNION ALL ".join(f"SELECT '{k}' AS why, true AS refused, (SELECT count(*) FROM region) AS regions" for k in _REFUSED))
def stored_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads that must fail, and how many regions there are after each."""
    g, out = _graph(spark, sf_dir), []
    for why, lines in _REFUSED.items():
        try:
            g.load([lines], "append")
            refused = False
        except HoplineError:
            refused = True
        out.append((why, refused, g.graph().node("Region").count()))
    return spark.createDataFrame(out, "why string, refused boolean, regions bigint")


def _changed(spark: SparkSession, sf_dir: str) -> GraphSession:
    g = _graph(spark, sf_dir)
    g.run('query q() { insert Region { r_regionkey: 99, r_name: "NEW" } }')
    g.run('query q() { update Nation set { n_regionkey: 0 } where n_nationkey < 5 }')
    g.run("query q() { delete Nation where n_nationkey = 7 }")
    return g


@registered("""SELECT 2::BIGINT AS graph_version, 'insert' AS change_kind, 'Region' AS type_name, '99' AS logical_key
    UNION ALL SELECT 3, 'update', 'Nation', n_nationkey::VARCHAR FROM nation WHERE n_nationkey < 5 AND n_regionkey <> 0
    UNION ALL SELECT 4, 'delete', 'Nation', n_nationkey::VARCHAR FROM nation WHERE n_nationkey = 7""")
def changes_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(spark, sf_dir).changes(after=1).filter("entity_kind = 'node'")
    return rows.select("graph_version", "change_kind", "type_name", "logical_key")


@registered(f"""SELECT 1::BIGINT AS graph_version, type AS type_name, 'insert' AS change_kind, n FROM ({COUNTS})
    UNION ALL SELECT 2, 'Region', 'insert', 1 UNION ALL SELECT 3, 'Nation', 'update', count(*) FROM nation WHERE n_nationkey < 5 AND n_regionkey <> 0
    UNION ALL SELECT 4, 'Nation', 'delete', 1 UNION ALL SELECT 4, 'InRegion', 'delete', 1
    UNION ALL SELECT 4, 'SupplierIn', 'delete', count(*) FROM supplier WHERE s_nationkey = 7 HAVING count(*) > 0""")
def changes_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materialised log summed up by version, type and kind."""
    g = _changed(spark, sf_dir)
    g.materialize_changes()
    return counts(spark.read.parquet(f"{g.store.path}/analytics/changes"))


@registered("""SELECT type, n, 1::BIGINT AS files, 1::BIGINT AS versions FROM (SELECT 'Region' AS type, count(*) + 1 AS n FROM region UNION ALL SELECT 'Nation', count(*) - 1 FROM nation UNION ALL SELECT 'Supplier', count(*) FROM supplier
    UNION ALL SELECT 'InRegion', count(*) - 1 FROM nation UNION ALL SELECT 'SupplierIn', count(*) FROM supplier WHERE s_nationkey <> 7)""")
def stored_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables compacted, old versions forgotten, everything still there and sound."""
    g = _changed(spark, sf_dir)
    g.compact()
    g.cleanup(1, tables=1)
    rows = [(t["type"], g.graph().nodes.get(t["type"], g.graph().edges.get(t["type"]))().count(), t["files"], len(g.store.versions())) for t in g.storage()]
    if g.doctor().limit(1).count():
        raise HoplineError("the graph is not sound")
    return spark.createDataFrame(rows, "type string, n bigint, files bigint, versions bigint")


@registered("SELECT s_suppkey, s_nationkey::BIGINT AS place, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def stored_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type and an edge renamed, a property renamed and widened, another dropped; ids and edges stay."""
    g = _graph(spark, sf_dir)
    new = SCHEMA.replace("node Supplier {", 'node Vendor @rename_from("Supplier") {').replace("s_nationkey: I32?  note: String?  v: Vector(4)? @embed(note)", 's_place: I64? @rename_from("s_nationkey")')
    new = new.replace("edge SupplierIn: Supplier -> Nation", 'edge SellsIn: Vendor -> Nation @rename_from("SupplierIn")')
    g.migrate(new, confirm=True)
    return g.run("query q() { match { $s: Vendor  $s sellsIn $n } return { $s.s_suppkey, $s.s_place as place, $n.n_name } }")


@registered(f"SELECT count({NOTE}) AS would, count({NOTE}) AS did, 0::BIGINT AS missing FROM supplier")
def stored_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    rows = (g.embed("Supplier", only_null=False, dry_run=True), g.embed("Supplier", only_null=False), g.embed(dry_run=True))
    return spark.createDataFrame([rows], "would bigint, did bigint, missing bigint")


@registered(f"""SELECT '{{"type":"Region","data":{{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}}}}' AS value FROM region
    UNION ALL SELECT '{{"type":"Nation","data":{{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}}}}' FROM nation
    UNION ALL SELECT '{{"type":"Supplier","data":{{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"note":' || coalesce('"' || {NOTE} || '"', 'null') || '}}}}' FROM supplier
    UNION ALL SELECT '{{"edge":"InRegion","from":"' || n_nationkey || '","to":"' || n_regionkey || '","data":{{"since":null}}}}' FROM nation
    UNION ALL SELECT '{{"edge":"SupplierIn","from":"' || s_suppkey || '","to":"' || s_nationkey || '"}}' FROM supplier""")
def stored_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types, vectors left out."""
    return _graph(spark, sf_dir).export(vectors=False)


# sinks, media and validation, which need no stored graph


@registered("SELECT r_regionkey, r_name FROM region")
def sink_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as an Arrow stream and read back."""
    found = star_graph(spark, sf_dir).query("query q() { match { $r: Region } return { $r.r_regionkey, $r.r_name } }").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as writer:
        writer.write_table(found)
    return spark.createDataFrame(pa.ipc.open_stream(sink.getvalue()).read_all())


@registered("""SELECT line FROM (SELECT 'key,name' AS line UNION ALL SELECT r_regionkey || ',' || r_name FROM region)""")
def sink_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints for a query of a stored graph, as CSV."""
    g = _graph(spark, sf_dir)
    with TemporaryDirectory() as home:
        queries, out = Path(home) / "q.gq", io.StringIO()
        queries.write_text("query regions() { match { $r: Region } return { $r.r_regionkey as key, $r.r_name as name } }")
        with contextlib.redirect_stdout(out):
            code = cli.main(["run", g.store.path, str(queries), "--name", "regions", "--format", "csv"], spark)
    if code:
        raise HoplineError("the command failed")
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "line string")


@registered("""SELECT n_nationkey, 'blob://sha256/' || sha256('\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB || encode(n_name)) AS uri, 'image/png' AS mime FROM nation WHERE n_nationkey % 3 = 0
    UNION ALL SELECT n_nationkey, 'blob://sha256/' || sha256('\\xFF\\xFB'::BLOB || encode(n_name)), 'audio/mpeg' FROM nation WHERE n_nationkey % 3 = 1
    UNION ALL SELECT n_nationkey, 'https://x.example/' || n_name || '.JPG', 'image/jpeg' FROM nation WHERE n_nationkey % 3 = 2""")
def media_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline contents and addresses, resolved to URIs and types."""
    prop = parse_schema("node P { n_nationkey: I32 @key  uri: String @media_uri(mime)  mime: String? }").nodes["P"].props["uri"]
    n, name = F.col("n_nationkey"), F.col("n_name").cast("binary")

    def inline(head: bytes):
        return F.concat(F.lit("@base64:"), F.base64(F.concat(F.lit(bytearray(head)), name)))

    uri = F.when(n % 3 == 0, inline(b"\x89PNG\r\n\x1a\n")).when(n % 3 == 1, inline(b"\xff\xfb")).otherwise(F.concat(F.lit("@uri:https://x.example/"), "n_name", F.lit(".JPG")))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", uri.alias("uri"), F.lit(None).cast("string").alias("mime"))
    return media.resolve(rows, prop)[0].select("n_nationkey", "uri", "mime")


@registered("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'c_acctbal is not a F64' WHEN c_custkey % 7 = 1 THEN 'c_name is required' WHEN c_custkey % 7 = 2 THEN 'unknown property extra' END AS problem FROM customer""")
def load_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each line of an input, null where nothing is."""
    props = list(star_graph(spark, sf_dir).catalog.nodes["Customer"].props.values())
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    values = {p.name: F.col(p.name).cast("string") for p in props}
    values["c_acctbal"] = F.when(k % 7 == 0, "much").otherwise(values["c_acctbal"])
    values["c_name"] = F.when(k % 7 != 1, values["c_name"])
    fields = [F.when(v.isNotNull(), F.concat(F.lit(f'"{n}":'), v if n in ("c_custkey", "c_nationkey") else F.when(F.lit(n == "c_acctbal") & (k % 7 != 0), v).otherwise(F.concat(F.lit('"'), v, F.lit('"'))))) for n, v in values.items()]
    data = F.concat(F.lit("{"), F.concat_ws(",", *fields, F.when(k % 7 == 2, F.lit('"extra":1'))), F.lit("}"))
    line = F.concat(F.lit('{"type":"Customer","data":'), data, F.lit("}"))
    head = jsonl.heads(rows.select(line.alias("value"), F.monotonically_increasing_id().alias(jsonl.LINE)))
    return jsonl.properties(head, props, []).select("c_custkey", F.col("__problem").alias("problem"))
