"""A property-graph view over plain relational tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.graph import Graph
from hopline.plans.schema import DST, ID, SRC, Catalog, parse_schema

#: The schema of the star tables as a graph.
STAR = """
node Region { r_regionkey: I32 @key  r_name: String }
node Nation { n_nationkey: I32 @key  n_name: String @index  n_regionkey: I32 }
node Customer { c_custkey: I64 @key  c_name: String @index  c_nationkey: I32  c_acctbal: F64  c_mktsegment: String }
node Supplier { s_suppkey: I64 @key  s_name: String  s_nationkey: I32  s_acctbal: F64 }
node Part { p_partkey: I64 @key  p_name: String @index  p_brand: String  p_type: String  p_size: I32  p_retailprice: F64 }
node Order { o_orderkey: I64 @key  o_custkey: I64  o_orderstatus: String  o_totalprice: F64  o_orderdate: DateTime  o_orderpriority: String }
node Doc { doc_id: I64 @key  text: String? @index  lang: String?  source: String?  n_chars: I64?  tags: [String]? }
node Label { doc_id: I64 @key  quality: I32?  toxic: I32? }
node Vec { vec_id: I64 @key  embedding: Vector(64)? @index  label: I32? }
node Turn { turn_key: I64 @key  conv_id: I64  turn: I64  role: String?  text: String? }
node Event { event_id: I64 @key  ts: DateTime?  user_id: I64?  event_type: String?  value: F64?  props: String? }
node User { user_id: I64 @key }
edge InRegion: Nation -> Region
edge CustomerIn: Customer -> Nation
edge SupplierIn: Supplier -> Nation
edge Placed: Customer -> Order
edge Includes: Order -> Part
edge ShippedBy: Order -> Supplier
edge HasLabel: Doc -> Label
edge NextTurn: Turn -> Turn
edge Did: User -> Event
edge Borders: Nation -> Nation
"""

_SOURCES = {
    "Region": ("region", "r_regionkey"),
    "Nation": ("nation", "n_nationkey"),
    "Customer": ("customer", "c_custkey"),
    "Supplier": ("supplier", "s_suppkey"),
    "Part": ("part", "p_partkey"),
    "Order": ("orders", "o_orderkey"),
    "Label": ("labels", "doc_id"),
    "Vec": ("embeddings", "vec_id"),
    "Event": ("events", "event_id"),
}


def edge_table(rows: DataFrame, src: str, dst: str) -> DataFrame:
    """An edge table from two columns of ids; the pair itself is the edge's id."""
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    return rows.select(F.xxhash64(a, b).alias(ID), a.alias(SRC), b.alias(DST))


def node_table(rows: DataFrame, key: str, catalog: Catalog, kind: str) -> DataFrame:
    """A node table whose ids are an integer key."""
    props = [F.col(p.name).cast(p.type.spark()).alias(p.name) for p in catalog.nodes[kind].props.values()]
    return rows.select(F.col(key).cast("long").alias(ID), *props)


_catalog = cache(parse_schema)


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The tables of a folder as a graph; a table is opened when a query first needs it."""
    catalog = _catalog(STAR)

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def turns() -> DataFrame:
        return table("conversations").withColumn("turn_key", F.col("conv_id") * 1000 + F.col("turn"))

    def borders() -> DataFrame:
        n = F.col("n_nationkey")
        return table("nation").select("n_nationkey", F.explode(F.array((n + 1) % 25, (3 * n + 1) % 25)).alias("next"))

    def next_turns() -> DataFrame:
        own = turns()
        later = own.select((F.col("turn_key") + 1).alias("next"), "turn_key")
        return later.join(own.select(F.col("turn_key").alias("next")), "next", "left_semi")

    def node(kind: str, key: str, rows: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: node_table(rows(), key, catalog, kind)

    def edge(rows: Callable[[], DataFrame], src: str, dst: str) -> Callable[[], DataFrame]:
        return lambda: edge_table(rows(), src, dst)

    nodes = {kind: node(kind, key, partial(table, t)) for kind, (t, key) in _SOURCES.items()}
    nodes["Doc"] = node("Doc", "doc_id", lambda: table("documents").withColumn("tags", F.array("lang", "source")))
    nodes["Turn"] = node("Turn", "turn_key", turns)
    nodes["User"] = node("User", "user_id", lambda: table("events").select("user_id").filter("user_id IS NOT NULL").distinct())
    edges = {
        "InRegion": edge(lambda: table("nation"), "n_nationkey", "n_regionkey"),
        "CustomerIn": edge(lambda: table("customer"), "c_custkey", "c_nationkey"),
        "SupplierIn": edge(lambda: table("supplier"), "s_suppkey", "s_nationkey"),
        "Placed": edge(lambda: table("orders"), "o_custkey", "o_orderkey"),
        "Includes": edge(lambda: table("lineitem"), "l_orderkey", "l_partkey"),
        "ShippedBy": edge(lambda: table("lineitem"), "l_orderkey", "l_suppkey"),
        "HasLabel": edge(lambda: table("labels").withColumn("label_id", F.col("doc_id")), "doc_id", "label_id"),
        "NextTurn": edge(next_turns, "turn_key", "next"),
        "Did": edge(lambda: table("events").filter("user_id IS NOT NULL"), "user_id", "event_id"),
        "Borders": edge(borders, "n_nationkey", "next"),
    }
    # keys make these pairs distinct; the others may repeat a pair
    return Graph(spark, catalog, nodes, edges, {"InRegion", "CustomerIn", "SupplierIn", "Placed", "HasLabel", "Did"})
