"""The portable text format: one JSON object a line, for nodes and edges.

``{"type": T, "data": {…}}`` is a node, ``{"edge": E, "from": key, "to": key,
"data": {…}}`` an edge; blank lines and lines that begin with ``//`` are
skipped.  Lines are read as text and parsed by type schema, so nothing is
inferred, nothing is collected, and an edge may stand before its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.errors import LoadError
from hopline.plans.schema import DST, ID, SRC, Catalog, EdgeType, NodeType, Prop
from hopline.plans.types import RANGES

#: Where a line stands in its input: rows that come later win.
LINE = "__line"


def lines(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """(value, __line) of a path or of driver-side lines; ``__line`` orders by file, the block in it, and the position.

    Tasks may hold pieces of several files in any order, so a number within
    the task orders lines of one block only.
    """
    if isinstance(source, str):
        raw = spark.read.text(source).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    else:
        text = [line for chunk in source for line in chunk.split("\n")]
        raw = spark.createDataFrame([(x,) for x in text], "value string").coalesce(1).select("value", F.lit("").alias("file"), F.lit(0).cast("long").alias("block"))
    raw = raw.select("value", F.struct("file", "block", F.monotonically_increasing_id().alias("at")).alias(LINE))
    kept = F.trim("value")
    return raw.filter((kept != "") & ~kept.startswith("//"))


def heads(raw: DataFrame) -> DataFrame:
    """Add what each line is: ``kind``, ``edge``, ``from``, ``to`` and its data as JSON text."""
    head = F.from_json("value", "type string, edge string, `from` string, `to` string, data string")
    return raw.withColumn("h", head).select("value", LINE, "h.*")


def value_schema(p: Prop) -> T.DataType:
    """How a property is read from JSON: dates and times as text, for they may be numbers."""
    if p.type.is_vector:
        return T.ArrayType(T.DoubleType())
    plain = T.StringType() if p.type.scalar in ("Date", "DateTime", "U64") else p.type.spark()
    plain = plain.elementType if isinstance(plain, T.ArrayType) else plain
    return T.ArrayType(plain) if p.type.list else plain


def _typed(c: Column, scalar: str) -> Column:
    """A JSON value as its scalar type, null where it does not fit."""
    if scalar == "Date":
        days = c.try_cast("int")
        return F.coalesce(F.when(days.isNotNull(), F.date_add(F.lit("1970-01-01").cast("date"), days)), F.substring(c, 1, 10).try_cast("date"))
    if scalar == "DateTime":
        ms = c.try_cast("long")
        text = F.try_to_timestamp(c)
        at = F.coalesce(F.when(ms.isNotNull(), F.timestamp_millis(ms)), text)
        utc = F.to_utc_timestamp(at, F.current_timezone())
        return F.date_trunc("millisecond", utc).cast("timestamp_ntz")
    if scalar == "U64":
        return c.try_cast("decimal(20,0)")
    return c


def typed(p: Prop, c: Column) -> Column:
    if p.type.is_vector:
        return F.transform(c, lambda x: x.cast("float"))
    if p.type.list:
        return F.transform(c, lambda x: _typed(x, p.type.scalar)).cast(p.type.spark())
    return _typed(c, p.type.scalar).cast(p.type.spark())


def problem(p: Prop, given: Column, value: Column) -> Column:
    """Text of what is wrong with a property's value, null if nothing is.  ``given`` is its raw JSON text."""
    name = p.name
    there = given.isNotNull()
    tests = []
    if not p.type.nullable and p.embed is None:
        tests.append((~there, f"{name} is required"))
    tests.append((there & value.isNull(), f"{name} is not a {p.type}"))
    if p.type.enum and p.type.list:
        tests.append((F.size(F.array_except(value, F.array(*map(F.lit, p.type.enum)))) > 0, f"{name} is none of {', '.join(p.type.enum)}"))
    elif p.type.enum:
        tests.append((~value.isin(*p.type.enum), f"{name} is none of {', '.join(p.type.enum)}"))
    if p.type.is_vector:
        tests.append((F.size(value) != p.type.dim, f"{name} is not a {p.type}"))
    if p.type.scalar in RANGES and not p.type.list:
        low, high = RANGES[p.type.scalar]
        tests.append(((value < F.lit(str(low)).cast("decimal(20,0)")) | (value > F.lit(str(high)).cast("decimal(20,0)")), f"{name} is out of range"))
    out = F.lit(None).cast("string")
    for cond, text in reversed(tests):
        out = F.when(cond, F.lit(text)).otherwise(out)
    return out


def properties(rows: DataFrame, props: list[Prop], carry: list[str]) -> DataFrame:
    """Columns ``carry``, the properties typed, and ``__problem`` (null where all is well)."""
    shape = T.StructType([T.StructField(p.name, value_schema(p)) for p in props])
    raw = rows.withColumn("__v", F.from_json("data", shape) if props else F.lit(None))
    texts = T.StructType([T.StructField(p.name, T.StringType()) for p in props])
    raw = raw.withColumn("__t", F.from_json("data", texts) if props else F.lit(None))
    values = {p.name: typed(p, F.col(f"__v.`{p.name}`")) for p in props}
    wrong = [problem(p, F.col(f"__t.`{p.name}`"), values[p.name]) for p in props]
    known = F.array(*[F.lit(p.name) for p in props]) if props else F.array().cast("array<string>")
    extra = F.array_except(F.coalesce(F.json_object_keys("data"), F.array().cast("array<string>")), known)
    wrong.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown property "), F.array_join(extra, ", "))))
    return raw.select(*carry, *[v.alias(n) for n, v in values.items()], F.coalesce(*wrong).alias("__problem"))


class Parsed:
    """The nodes and edges of an input by type, still lazy, with the checks that need a pass."""

    def __init__(self, spark: SparkSession, catalog: Catalog, source: str | list[str]):
        self.spark, self.catalog = spark, catalog
        self.head = heads(lines(spark, source))
        self.present: set[str] | None = None

    def check(self) -> None:
        """One pass over the heads: every line is JSON of a known type."""
        nodes, edges = list(self.catalog.nodes), {n for e in self.catalog.edges for n in (e, e[:1].lower() + e[1:])}
        kind = F.when(F.col("type").isin(nodes), F.col("type")).when(F.col("edge").isin(*edges), F.concat(F.upper(F.substring("edge", 1, 1)), F.expr("substring(edge, 2)"))) if edges else F.when(F.col("type").isin(nodes), F.col("type"))
        bad = F.when(kind.isNull(), F.struct(LINE, "value"))
        seen = self.head.groupBy(kind.alias("kind")).agg(F.min(bad).alias("bad")).collect()  # one row a type
        for r in seen:
            if r["bad"] is not None:
                raise LoadError(f"unknown node or edge type, or no JSON object: {r['bad']['value'][:200]}")
        self.present = {r["kind"] for r in seen}

    def nodes(self, node: NodeType) -> DataFrame:
        rows = self.head.filter(F.col("type") == node.name)
        return properties(rows, list(node.props.values()), [LINE])

    def edges(self, edge: EdgeType) -> DataFrame:
        rows = self.head.filter(F.col("edge").isin(edge.name, edge.name[:1].lower() + edge.name[1:]))
        return properties(rows, list(edge.props.values()), [LINE, "from", "to"])


def sure(rows: DataFrame, what: str) -> DataFrame:
    """The rows without ``__problem``; an error that names the first one if there is any."""
    first = rows.filter("__problem IS NOT NULL").agg(F.min(F.struct(LINE, "__problem")).alias("p")).first()["p"]
    if first is not None:
        raise LoadError(f"{what}: {first['__problem']}")
    return rows.drop("__problem")


def key_text(c: Column) -> Column:
    """A key as the text that edges name it by."""
    return c.cast("string")


def export(catalog: Catalog, nodes: dict[str, DataFrame], edges: dict[str, DataFrame], ids: bool = False, vectors: bool = True) -> DataFrame:
    """(value): the portable lines of a graph, nodes before edges.

    Edges name their ends by key, so both end types need one.  ``ids`` adds
    the internal ids; ``vectors=False`` leaves embeddings out.
    """
    parts = []

    def data(props: dict[str, Prop]) -> Column:
        kept = [p for p in props.values() if vectors or not (p.embed or p.type.is_vector)]
        return F.struct(*[_written(p).alias(p.name) for p in kept]) if kept else F.create_map().cast("map<string,string>")

    for order, n in enumerate(catalog.nodes.values()):
        if n.name in nodes:
            shown = [F.lit(n.name).alias("type"), *([F.col(ID).alias("id")] if ids else []), data(n.props).alias("data")]
            parts.append(nodes[n.name].select(F.lit(order).alias("o"), F.col(ID).alias("i"), F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("value")))
    for order, e in enumerate(catalog.edges.values(), len(catalog.nodes)):
        if e.name not in edges:
            continue
        rows = edges[e.name]
        for end, column, kind in (("from", SRC, e.source), ("to", DST, e.target)):
            key = catalog.nodes[kind].key
            if key is None:
                raise LoadError(f"edge {e.name}: type {kind} has no key to name its ends by")
            known = nodes[kind].select(F.col(ID).alias(f"__{end}_id"), key_text(F.col(f"`{key}`")).alias(f"__{end}"))
            rows = rows.join(known, F.col(column) == F.col(f"__{end}_id"))
        shown = [F.lit(e.name).alias("edge"), *([F.col(c).alias(c[2:]) for c in (ID, SRC, DST)] if ids else [])]
        shown += [F.col("__from").alias("from"), F.col("__to").alias("to")]
        if e.props:
            shown.append(data(e.props).alias("data"))
        parts.append(rows.select(F.lit(order).alias("o"), F.col(ID).alias("i"), F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("value")))
    if not parts:
        raise LoadError("the graph is empty")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("o", "i").select("value")


def _written(p: Prop) -> Column:
    """A property as export writes it: times in UTC to the millisecond, with a Z."""
    c = F.col(f"`{p.name}`")

    def one(x: Column) -> Column:
        if p.type.scalar == "DateTime":
            return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return x.cast("string") if p.type.scalar == "Date" else x

    if p.type.scalar not in ("Date", "DateTime"):
        return c
    return F.transform(c, one) if p.type.list else one(c)
