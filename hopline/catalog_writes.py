"""Registered queries of the writing side: mutations, loading, change rows, export, checks.

Each shows the table that the operator would commit, so that SQL can say the
same; stored graphs are exercised in the tests.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.errors import HoplineError
from hopline.operators import load as L
from hopline.operators import mutate as M
from hopline.plans.lint import lint
from hopline.plans.migration import diff
from hopline.plans.parser import parse_queries
from hopline.plans.schema import DST, ID, SRC, parse_schema
from hopline.sources import jsonl, staging
from hopline.sources.adapters import STAR, star_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _mutation(text: str):
    return parse_queries(f"query q() {{ {text} }}")["q"].mutation


def _literal_rows(rows: list[tuple], columns: list[str]) -> str:
    values = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {values}) AS t({', '.join(columns)})"


@registered("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def mut_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    mu = _mutation('update Customer set { c_mktsegment: "DEBTOR" } where c_acctbal < 0')
    props = g.props("Customer")
    sets = [(p, props[p], M.value_of(v, props[p], {}, None)) for p, v in mu.sets]
    out = M.update(g.node("Customer"), sets, M.condition(mu.where, props["c_acctbal"], {}, None))
    return out.select("c_custkey", "c_mktsegment", "c_acctbal")


@registered("""
    WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT 'Customer' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (FROM gone)
    UNION ALL SELECT 'CustomerIn', count(*) FROM customer WHERE c_custkey NOT IN (FROM gone)
    UNION ALL SELECT 'Placed', count(*) FROM orders WHERE o_custkey NOT IN (FROM gone)""")
def mut_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    mu = _mutation('delete Customer where c_mktsegment = "BUILDING"')
    cond = M.condition(mu.where, g.props("Customer")["c_mktsegment"], {}, None)
    edges = {k: g.edge(k)[0] for k in ("CustomerIn", "Placed", "SupplierIn")}
    left = M.delete_nodes(g.catalog, "Customer", g.node("Customer"), edges, cond)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registered("SELECT c_custkey::BIGINT AS src, c_nationkey::BIGINT AS dst FROM customer WHERE c_nationkey <> 7")
def mut_delete_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    mu = _mutation('delete CustomerIn where to = "7"')
    left = M.delete_edges(g.catalog, "CustomerIn", g.edge("CustomerIn")[0], mu.where, g.node, {}, None)
    return left.select(F.col(SRC).alias("src"), F.col(DST).alias("dst"))


def _lines(rows: DataFrame, head: str, value) -> DataFrame:
    """Load-format lines made from a table, as if they had been read."""
    return jsonl.heads(rows.select(F.to_json(F.struct(F.lit(head).alias("type"), value)).alias("value"), F.monotonically_increasing_id().alias(jsonl.LINE)))


@registered("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def load_parse_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as lines and parsed back by the schema, with all checks."""
    g = star_graph(spark, sf_dir)
    props = list(g.catalog.nodes["Customer"].props.values())
    lines = _lines(g.node("Customer"), "Customer", F.struct(*[p.name for p in props]).alias("data"))
    return jsonl.properties(lines, props, []).filter("__problem IS NULL").drop("__problem")


@registered("SELECT o_custkey AS src, o_orderkey AS dst FROM orders")
def load_resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges given by keys, resolved to the ids of both ends."""
    g = star_graph(spark, sf_dir)
    placed = g.edge("Placed")[0].select(F.col(SRC).cast("string").alias("from"), F.col(DST).cast("string").alias("to"), F.lit(0).alias(jsonl.LINE))
    out = L.resolve_ends(g.catalog.edges["Placed"], placed, g.catalog, g.node)
    return out.select(F.col(SRC).alias("src"), F.col(DST).alias("dst"))


def _staged(rows: DataFrame) -> DataFrame:
    return L.placed(staging.stage(rows.coalesce(1), "lines"))


def _regions(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    return _staged(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{jsonl.LINE} bigint, r_regionkey int, r_name string"))


@registered("SELECT r_regionkey::BIGINT AS id, r_regionkey, r_name FROM region UNION ALL VALUES (100, 70, 'NORTH'), (101, 71, 'SOUTH')")
def load_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    out = L.merge_nodes(g.catalog.nodes["Region"], g.node("Region"), _regions(spark, [(70, "NORTH"), (71, "SOUTH")]), "append", 100)
    return out.withColumnRenamed(ID, "id")


@registered("SELECT r_regionkey::BIGINT AS id, r_regionkey, CASE WHEN r_regionkey = 2 THEN 'RENAMED' ELSE r_name END AS r_name FROM region UNION ALL VALUES (101, 70, 'NORTH')")
def load_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert by key: the known row keeps its id, the new one gets the next."""
    g = star_graph(spark, sf_dir)
    out = L.merge_nodes(g.catalog.nodes["Region"], g.node("Region"), _regions(spark, [(2, "RENAMED"), (70, "NORTH")]), "merge", 100)
    return out.withColumnRenamed(ID, "id")


@registered("""
    WITH e AS (SELECT DISTINCT n_nationkey AS src, unnest([(n_nationkey + 1) % 25, (3 * n_nationkey + 1) % 25]) AS dst FROM nation),
    new AS (SELECT src, dst, max(id) AS id FROM (VALUES (0, 1, 1000), (0, 20, 1001), (0, 20, 1002), (3, 3, 1003)) AS t(src, dst, id) GROUP BY ALL)
    SELECT 100 * src::BIGINT + dst AS id, src::BIGINT AS src, dst::BIGINT AS dst FROM e UNION ALL SELECT id::BIGINT, src, dst FROM new WHERE (src, dst) NOT IN (SELECT src, dst FROM e)""")
def load_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges stay one a pair: of repeated pairs the last stays, a known pair keeps its id."""
    g = star_graph(spark, sf_dir)
    old = g.edge("Borders")[0].dropDuplicates([SRC, DST]).withColumn(ID, 100 * F.col(SRC) + F.col(DST))
    new = _staged(spark.createDataFrame([(0, 1, 0), (0, 20, 1), (0, 20, 2), (3, 3, 3)], f"{SRC} bigint, {DST} bigint, {jsonl.LINE} bigint"))
    return L.merge_edges(g.catalog.edges["Borders"], old, new, 1000).select(F.col(ID).alias("id"), F.col(SRC).alias("src"), F.col(DST).alias("dst"))


@registered("""
    SELECT 7::BIGINT AS graph_version, 'update' AS change_kind, c_custkey AS entity_id, c_custkey::VARCHAR AS logical_key FROM customer WHERE c_acctbal < 0 AND c_nationkey <> 3
    UNION ALL SELECT 7, 'delete', c_custkey, c_custkey::VARCHAR FROM customer WHERE c_nationkey = 3""")
def cdc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change rows between a table and the same table after an update and a delete."""
    old = star_graph(spark, sf_dir).node("Customer")
    new = old.filter("c_nationkey <> 3").withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, "DEBTOR").otherwise(F.col("c_mktsegment")))
    return L.diff("Customer", "node", 7, old, new, "c_custkey").select("graph_version", "change_kind", "entity_id", "logical_key")


@registered("""
    SELECT '{"type":"Region","data":{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}}' AS value FROM region
    UNION ALL SELECT '{"type":"Nation","data":{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}}' FROM nation
    UNION ALL SELECT '{"type":"Label","data":{"doc_id":' || doc_id || ',"quality":' || coalesce(quality::VARCHAR, 'null') || ',"toxic":' || coalesce(toxic::VARCHAR, 'null') || '}}' FROM labels
    UNION ALL SELECT DISTINCT '{"type":"User","data":{"user_id":' || user_id || '}}' FROM events WHERE user_id IS NOT NULL
    UNION ALL SELECT '{"edge":"InRegion","from":"' || n_nationkey || '","to":"' || n_regionkey || '"}' FROM nation
    UNION ALL SELECT '{"edge":"Borders","from":"' || n_nationkey || '","to":"' || unnest([(n_nationkey + 1) % 25, (3 * n_nationkey + 1) % 25]) || '"}' FROM nation""")
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types without texts and floating numbers, which SQL writes otherwise; ``stored_export`` has all of another graph."""
    g = star_graph(spark, sf_dir)
    return jsonl.export(g.catalog, {k: g.node(k) for k in ("Region", "Nation", "Label", "User")}, {k: g.edge(k)[0] for k in ("InRegion", "Borders")})


#: The star graph's tables in SQL: key and rows of each node type; rows, ends and their types of each edge type.
_NODES = {
    "Region": ("r_regionkey", "region"), "Nation": ("n_nationkey", "nation"), "Customer": ("c_custkey", "customer"), "Supplier": ("s_suppkey", "supplier"), "Part": ("p_partkey", "part"),
    "Order": ("o_orderkey", "orders"), "Doc": ("doc_id", "documents"), "Label": ("doc_id", "labels"), "Vec": ("vec_id", "embeddings"), "Event": ("event_id", "events"),
    "Turn": ("turn_key", "(SELECT conv_id * 1000 + turn AS turn_key FROM conversations)"), "User": ("user_id", "(SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)"),
}
_EDGES = {
    "InRegion": ("SELECT n_nationkey AS s, n_regionkey AS d FROM nation", "Nation", "Region"),
    "CustomerIn": ("SELECT c_custkey AS s, c_nationkey AS d FROM customer", "Customer", "Nation"),
    "SupplierIn": ("SELECT s_suppkey AS s, s_nationkey AS d FROM supplier", "Supplier", "Nation"),
    "Placed": ("SELECT o_custkey AS s, o_orderkey AS d FROM orders", "Customer", "Order"),
    "Includes": ("SELECT l_orderkey AS s, l_partkey AS d FROM lineitem", "Order", "Part"),
    "ShippedBy": ("SELECT l_orderkey AS s, l_suppkey AS d FROM lineitem", "Order", "Supplier"),
    "HasLabel": ("SELECT doc_id AS s, doc_id AS d FROM labels", "Doc", "Label"),
    "NextTurn": ("SELECT a.turn_key AS s, a.turn_key + 1 AS d FROM (SELECT conv_id * 1000 + turn AS turn_key FROM conversations) a WHERE a.turn_key + 1 IN (SELECT conv_id * 1000 + turn FROM conversations)", "Turn", "Turn"),
    "Did": ("SELECT user_id AS s, event_id AS d FROM events WHERE user_id IS NOT NULL", "User", "Event"),
    "Borders": ("SELECT n_nationkey AS s, unnest([(n_nationkey + 1) % 25, (3 * n_nationkey + 1) % 25]) AS d FROM nation", "Nation", "Nation"),
}


def _doctor() -> str:
    parts = []
    for kind, (key, rows) in _NODES.items():
        for problem in ("repeated id", f"repeated {key}"):
            parts.append(f"SELECT '{kind}' AS type, '{problem}' AS problem, (SELECT count(*) FROM (SELECT 1 FROM {rows} GROUP BY {key} HAVING count(*) > 1)) AS n")
    for kind, (rows, *ends) in _EDGES.items():
        for problem, c, end in zip(("dangling src", "dangling dst"), "sd", ends):
            key, there = _NODES[end]
            parts.append(f"SELECT '{kind}', '{problem}', (SELECT count(*) FROM ({rows}) WHERE {c} NOT IN (SELECT {key} FROM {there}))")
        parts.append(f"SELECT '{kind}', 'repeated pair', (SELECT count(*) FROM (SELECT 1 FROM ({rows}) GROUP BY s, d HAVING count(*) > 1))")
    return " UNION ALL ".join(parts)


@registered(_doctor())
def doctor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of damage of every type, counted."""
    return star_graph(spark, sf_dir).validate()


_BROKEN = {
    "match { $a: Nowhere } return { 1 }": "T1",
    "match { $a: Region { size: 1 } } return { 1 }": "T2",
    'match { $a: Region { r_regionkey: "x" } } return { 1 }': "T3",
    "match { $a: Region  $a touches $b } return { 1 }": "T4",
    "match { $a: Region  $a placed $b } return { 1 }": "T5",
    "match { $a: Region } return { $a.size }": "T6",
    'match { $a: Region  $a.r_regionkey > "x" } return { 1 }': "T7",
    "match { $a: Region } return { sum($a.r_name) }": "T8",
    "match { $a: Region  not { $x inRegion $y } } return { 1 }": "T9",
    "match { $a: Turn  $a nextTurn{1,} $b } return { 1 }": "T15",
    "match { $v: Vec } return { $v.vec_id } order { nearest($v.embedding, \"x\") }": "T17",
    "match { $v: Vec } return { $v.vec_id as i } order { i, nearest($v.embedding, \"x\") } limit 3": "T18",
    "match { $p: Part  search($p.p_size, \"x\") } return { 1 }": "T19",
    "match { $p: Part } return { bm25($p.p_size, \"x\") }": "T20",
    "match { $p: Part } return { rrf(bm25($p.p_name, \"x\"), bm25($p.p_name, \"y\"), 0) as s } order { s desc } limit 2": "T21",
    "insert Nowhere { a: 1 }": "T10",
    "update Region set { r_regionkey: 1 } where r_name = \"x\"": "T10",
    "insert Region { r_regionkey: 1, r_name: \"x\", size: 1 }": "T11",
    "insert Region { r_regionkey: 1 }": "T12",
    "insert Placed { from: \"1\" }": "T12",
    "update Region set { r_name: \"x\", r_name: \"y\" } where r_regionkey = 1": "T13",
    "update Region set { r_name: $n } where r_regionkey = 1": "T14",
    "update Placed set { from: \"x\" } where to = \"1\"": "T16",
}


@registered(_literal_rows(sorted(_BROKEN.items()), ["body", "code"]))
def schema_check_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that each broken query breaks."""
    g = star_graph(spark, sf_dir)
    rows = []
    for body in sorted(_BROKEN):
        found = g.check(f"query q() {{ {body} }}")["q"]
        rows.append((body, found.code if isinstance(found, HoplineError) else ""))
    return spark.createDataFrame(rows, "body string, code string")


@registered(_literal_rows([("error", "b"), ("warning", "Label.quality")], ["level", "place"]))
def lint_l201(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "query a() { update Label set { toxic: 1 } where doc_id = 5 } query b() { match { $x: Gone } return { 1 } }"
    return spark.createDataFrame([(f.level, f.where) for f in lint(parse_schema(STAR), text)], "level string, place string")


@registered(_literal_rows([("add_property", "Region", "safe"), ("drop_property", "Nation", "confirm"), ("rename_node_type", "Client", "safe")], ["kind", "type", "safety"]))
def migrate_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = STAR.replace("r_name: String }", "r_name: String  note: String? }").replace("n_name: String @index ", "").replace("node Customer {", 'node Client @rename_from("Customer") {').replace(": Customer", ": Client")
    return spark.createDataFrame([(s.kind, s.type, s.safety) for s in diff(parse_schema(STAR), parse_schema(new))], "kind string, type string, safety string")


@registered("SELECT count(*) AS n, count(*) AS known FROM (SELECT c_custkey FROM customer LIMIT 7)")
def limit_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a limit without an order gives, and how many of them are customers."""
    g = star_graph(spark, sf_dir)
    some = g.query("query q() { match { $c: Customer } return { $c.c_custkey } limit 7 }")
    known = some.join(g.node("Customer").select(F.col("c_custkey").alias("k")), F.col("c_custkey") == F.col("k"), "left")
    return known.agg(F.count("*").alias("n"), F.count("k").alias("known"))


@registered(None)
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(json.dumps(star_graph(spark, sf_dir).catalog.describe()),)], "catalog string")


@registered("SELECT doc_id, 8 AS numbers FROM labels WHERE quality IS NOT NULL")
def embed_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings filled from a text property where there is a text; all have the declared length."""
    schema = parse_schema("node D { doc_id: I64 @key  text: String?  v: Vector(8)? @embed(text) }")
    labels = star_graph(spark, sf_dir).node("Label")
    docs = labels.select("doc_id", F.concat(F.lit("label "), F.col("quality")).alias("text"), F.lit(None).cast("array<float>").alias("v"))
    return L.fill_embeddings(docs, schema.nodes["D"]).filter("v IS NOT NULL").select("doc_id", F.size("v").alias("numbers"))
