"""Loading: incoming rows against a stored version, by mode."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopline.errors import ConstraintError, LoadError
from hopline.functions.vector import embed
from hopline.plans.schema import DST, ID, SRC, Catalog, EdgeType, NodeType
from hopline.sources.jsonl import LINE, key_text
from hopline.sources.media import BLOB_URI, MEDIA_KEY

MODES = ("overwrite", "append", "merge")


def default_mode(catalog: Catalog) -> str:
    return "merge" if any(n.key for n in catalog.nodes.values()) else "overwrite"


#: Where a staged row lies: its file and its number in it.
PLACE = ("__file", "__row")


def placed(staged: DataFrame) -> DataFrame:
    """Staged rows with their place, which no packing of files into tasks changes."""
    return staged.withColumns({PLACE[0]: F.col("_metadata.file_path"), PLACE[1]: F.col("_metadata.row_index")})


def number(rows: DataFrame, start: int) -> DataFrame:
    """Give placed rows ids from ``start`` by file and position; distinct, dense, the same in every job.

    Counts a file are collected, one small row a file written.
    """
    counts = {r["f"]: r["n"] for r in rows.groupBy(F.col(PLACE[0]).alias("f")).agg((F.max(PLACE[1]) + 1).alias("n")).collect()}
    first, total = [], start
    for f in sorted(counts):
        first.append((f, total))
        total += counts[f]
    table = rows.sparkSession.createDataFrame(first, "__f string, __first bigint")
    out = rows.join(F.broadcast(table), F.col(PLACE[0]) == F.col("__f"))
    return out.withColumn(ID, F.col("__first") + F.col(PLACE[1])).drop("__f", "__first", *PLACE)


def repeated(rows: DataFrame, column: Column) -> object | None:
    """A value that stands in more than one row, if there is one; nulls don't count."""
    found = rows.filter(column.isNotNull()).groupBy(column.alias("v")).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    return found[0]["v"] if found else None


def check_added(node: NodeType, old: DataFrame, new: DataFrame) -> None:
    """Keys and unique properties of added rows: among themselves, and against the rows that hold one of their values."""
    for prop in node.uniques:
        own = F.col(f"`{prop}`")
        twice = repeated(new, own)
        if twice is None:
            asked = new.select(own.alias("__v")).filter("__v IS NOT NULL").distinct()
            there = old.join(asked, own == F.col("__v"), "left_semi").select(own.alias("v")).limit(1).collect()
            twice = there[0]["v"] if there else None
        if twice is not None:
            check_unique(node, old.unionByName(new), [prop])


def check_unique(node: NodeType, rows: DataFrame, props: list[str] | None = None) -> None:
    """Keys and unique properties over a whole table."""
    for prop in node.uniques if props is None else props:
        twice = repeated(rows, F.col(f"`{prop}`"))
        if twice is not None:
            ids = [r[0] for r in rows.filter(F.col(f"`{prop}`") == F.lit(twice)).select(ID).orderBy(ID).limit(2).collect()]
            raise ConstraintError(f"{node.name}.{prop} must be unique, but {twice!r} stands in rows {ids[0]} and {ids[1]}")


def chunks(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of ``size`` characters, each beginning ``overlap`` before the last one's end; a size of 0 is no limit."""
    if size <= 0 or len(text) <= size:
        return [text]
    step = size - min(overlap, size - 1)
    return [text[at : at + size] for at in range(0, max(1, len(text) - size + step), step)]


def pooled(vectors: list[list[float]]) -> list[float]:
    """The mean of the vectors, at unit length."""
    if len(vectors) == 1:
        return vectors[0]
    mean = np.mean(np.array(vectors, np.float64), axis=0).astype(np.float32)
    norm = np.float32(np.sqrt((mean.astype(np.float64) ** 2).sum()))
    return (mean / norm if norm > np.finfo(np.float32).eps else mean).tolist()


def media_key(uri: Column) -> Column:
    """What a media value is embedded by: the id of a stored blob, else the stem of the address's last part."""
    blob = F.when(uri.startswith(BLOB_URI), F.substring(uri, len(BLOB_URI) + 1, 1 << 30))
    last = F.regexp_extract(F.regexp_replace(uri, "[?#].*$", ""), r"([^/]*)$", 1)
    return F.coalesce(blob, F.nullif(F.substring_index(last, ".", 1), F.lit("")), F.concat(F.lit("remote:"), uri))


def _embedder(dim: int, media: bool, chunk: int, overlap: int):
    modality, size = ("media", 0) if media else ("text", chunk)

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        known = {t: pooled([embed(x, dim, modality=modality) for x in chunks(t, size, overlap)]) for t in texts.dropna().unique()}
        return texts.map(known.get)

    return vector


def fill_embeddings(rows: DataFrame, node: NodeType, props: list[str] | None = None, only_null: bool = True, where: Column | None = None, chunk: int = 0, overlap: int = 128) -> DataFrame:
    """Embed the source of each ``@embed`` property where it is null (or everywhere), of the rows for which ``where`` holds.

    Texts of more than ``chunk`` characters (0: no limit) are embedded in
    overlapping pieces, whose vectors are averaged; equal texts of a batch
    once.  Media are embedded by their key (see ``media_key``).
    """
    for p in node.props.values():
        if p.embed is None or props is not None and p.name not in props:
            continue
        dim, media = p.type.dim, node.props[p.embed].media is not None
        vector = _embedder(dim, media, chunk, overlap)
        own, source = F.col(f"`{p.name}`"), F.col(f"`{p.embed}`")
        if media:
            given = f"{MEDIA_KEY}{p.embed}"
            source = F.coalesce(*([F.col(f"`{given}`")] if given in rows.columns else []), media_key(source))
        asked = source.isNotNull() if where is None else source.isNotNull() & where
        # rows that keep their vector are null to Python
        made = vector(F.when(asked & own.isNull() if only_null else asked, source))
        rows = rows.withColumn(p.name, F.coalesce(own, made) if only_null else F.coalesce(made, own))
    return rows


def merge_nodes(node: NodeType, old: DataFrame | None, new: DataFrame, mode: str, next_id: int) -> DataFrame:
    """The table of a node type after ``new`` (placed rows, see ``placed``, sorted by ``__line``) is loaded."""
    columns = [ID, *node.props]
    if node.key is not None:
        twice = repeated(new, F.col(f"`{node.key}`"))
        if twice is not None:
            raise ConstraintError(f"{node.name}.{node.key}: {twice!r} stands twice in the input")
    if old is None or mode == "overwrite" or mode == "merge" and node.key is None:
        return number(new, next_id).select(*[f"`{c}`" for c in columns])
    if mode == "append" or node.key is None:
        return old.select(*[f"`{c}`" for c in columns]).unionByName(number(new, next_id).select(*[f"`{c}`" for c in columns]))
    # merge by key: the row is replaced, its id stays
    known = old.select(F.col(ID).alias("__old"), F.col(f"`{node.key}`").alias("__key"))
    numbered = number(new, next_id).join(known, F.col(f"`{node.key}`") == F.col("__key"), "left")
    came = numbered.withColumn(ID, F.coalesce("__old", ID)).select(*[f"`{c}`" for c in columns])
    kept = old.join(new.select(F.col(f"`{node.key}`").alias("__new")), F.col(f"`{node.key}`") == F.col("__new"), "left_anti")
    return kept.select(*[f"`{c}`" for c in columns]).unionByName(came)


def resolve_ends(edge: EdgeType, rows: DataFrame, catalog: Catalog, node_table) -> DataFrame:
    """Add ``__src`` and ``__dst`` from the keys ``from`` and ``to``; an unknown key is an error."""
    for end, column, kind in (("from", SRC, edge.source), ("to", DST, edge.target)):
        key = catalog.nodes[kind].key
        if key is None:
            raise LoadError(f"edge {edge.name}: type {kind} has no key to name its ends by")
        known = node_table(kind).select(F.col(ID).alias(column), key_text(F.col(f"`{key}`")).alias("__k"))
        rows = rows.join(known, F.col(end) == F.col("__k"), "left").drop("__k")
    lost = rows.filter(F.col(SRC).isNull() | F.col(DST).isNull()).select("from", "to", SRC).limit(1).collect()
    if lost:
        end, kind = ("to", edge.target) if lost[0][SRC] is not None else ("from", edge.source)
        raise LoadError(f"edge {edge.name}: there is no {kind} {lost[0][end]!r}")
    return rows


def merge_edges(edge: EdgeType, old: DataFrame | None, new: DataFrame, next_id: int) -> DataFrame:
    """The table of an edge type after ``new`` (placed rows with both ends and ``__line``); one row a pair, the last wins.

    A pair that was there keeps its edge id and takes the new properties.  Ids
    are given before pairs are merged, so those of repeated pairs are skipped.
    """
    columns = [ID, SRC, DST, *edge.props]
    last = F.row_number().over(Window.partitionBy(SRC, DST).orderBy(F.desc(LINE)))
    numbered = number(new, next_id).withColumn("__n", last).filter("__n = 1").drop("__n")
    if old is None:
        return numbered.select(*[f"`{c}`" for c in columns])
    pair = old.select(F.col(ID).alias("__old"), F.col(SRC).alias("__s"), F.col(DST).alias("__d"))
    came = numbered.join(pair, (F.col(SRC) == F.col("__s")) & (F.col(DST) == F.col("__d")), "left").withColumn(ID, F.coalesce("__old", ID))
    kept = old.join(new.select(F.col(SRC).alias("__s"), F.col(DST).alias("__d")), (F.col(SRC) == F.col("__s")) & (F.col(DST) == F.col("__d")), "left_anti")
    return kept.select(*[f"`{c}`" for c in columns]).unionByName(came.select(*[f"`{c}`" for c in columns]))


def known_pairs(old: DataFrame | None, new: DataFrame) -> bool:
    """Whether some pair of ``new`` is in the table already."""
    if old is None:
        return False
    pair = new.select(F.col(SRC).alias("__s"), F.col(DST).alias("__d"))
    return old.join(pair, (F.col(SRC) == F.col("__s")) & (F.col(DST) == F.col("__d")), "left_semi").limit(1).count() > 0


def diff(kind: str, entity: str, version: int, old: DataFrame | None, new: DataFrame, key: str | None) -> DataFrame:
    """The change rows between two tables of a type, matched by id."""

    def packed(df: DataFrame, side: str) -> DataFrame:
        name = F.col(f"`{key}`").cast("string") if key else F.concat(F.lit("id="), F.col(ID))
        if entity == "edge":
            name = F.concat_ws(",", F.concat(F.lit("id="), F.col(ID)), F.concat(F.lit("src="), F.col(SRC)), F.concat(F.lit("dst="), F.col(DST)))
        return df.select(F.col(ID).alias(f"{side}_id"), name.alias(f"{side}_key"), F.to_json(F.struct(*[f"`{c}`" for c in df.columns])).alias(f"{side}_row"))

    now = packed(new, "n")
    if old is None:
        both = now.withColumns({f"o_{c}": F.lit(None).cast("long" if c == "id" else "string") for c in ("id", "key", "row")})
    else:
        both = now.join(packed(old, "o"), F.col("n_id") == F.col("o_id"), "full_outer")
    change = F.when(F.col("o_id").isNull(), "insert").when(F.col("n_id").isNull(), "delete").when(F.col("n_row") != F.col("o_row"), "update")
    return both.withColumn("change_kind", change).filter("change_kind IS NOT NULL").select(
        F.lit(version).cast("long").alias("graph_version"),
        "change_kind",
        F.lit(entity).alias("entity_kind"),
        F.lit(kind).alias("type_name"),
        F.coalesce("n_id", "o_id").alias("entity_id"),
        F.coalesce("n_key", "o_key").alias("logical_key"),
        F.coalesce("n_row", "o_row").alias("row"),
    )
