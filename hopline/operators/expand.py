"""Traversal of edges, as joins through the distinct pairs of an edge table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopline.operators.bindings import Rows, expected_bytes, key, read_bytes, scan
from hopline.plans.schema import DST, ID, SRC
from hopline.sources import staging

FROM, TO = "__from", "__to"
#: Steps of a bounded walk whose levels are one lazy plan.
LAZY_HOPS = 3
#: Ids that a row of a product looks through for each other row.
SLOT = 64
#: Rows of the smaller set of a product that each row of the larger one meets in turn, and the tasks that share them out.
TILE, SHARES = 256, 16
#: Bytes of tables for each part of the larger set, up to the session's number of shuffle partitions.
PART_BYTES = 16 << 20


def pairs(edges: DataFrame, out: bool, distinct: bool) -> DataFrame:
    """(from, to) along the direction of travel; ``distinct`` if the table already holds each pair once."""
    a, b = (SRC, DST) if out else (DST, SRC)
    found = edges.select(F.col(a).alias(FROM), F.col(b).alias(TO))
    return found if distinct else found.distinct()


def reach(step: DataFrame, low: int, high: int, origins: DataFrame | None) -> DataFrame:
    """(from, to) pairs joined by some walk of ``low`` to ``high`` steps.

    Each level keeps distinct pairs, so a node counts once per origin and
    level but may come back at a later one, the origin included.  Only walks
    from ``origins`` (a column of ids) are followed.  Beyond ``LAZY_HOPS``
    steps a level is staged before the next one is made from it; else the
    union of levels would make each of them again for every later one.
    """
    if low == high == 1:
        return step
    level = step if origins is None else step.join(origins, step[FROM] == origins[ID], "left_semi")
    then = step.withColumnsRenamed({FROM: "__mid", TO: "__next"})
    found = []
    for hop in range(1, high + 1):
        if hop > 1:
            if hop > LAZY_HOPS and staging.available(step.sparkSession):
                level = staging.stage(level, "level")
                if found:
                    found[-1] = level
            level = level.join(then, level[TO] == then["__mid"]).select(FROM, F.col("__next").alias(TO)).distinct()
        if hop >= low:
            found.append(level)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct() if len(found) > 1 else out


def to_new(rows: Rows, src: str, links: DataFrame, dst: str, target: DataFrame | None, kind: str) -> Rows:
    """Go on to a variable that is not bound yet; without ``target`` it is a wildcard and leaves no columns."""
    df = rows.df.join(links, key(src) == links[FROM])
    if target is None:
        return Rows(df.drop(FROM, TO), rows.vars)
    new = scan(target, dst, kind)
    return Rows(df.join(new.df, links[TO] == key(dst)).drop(FROM, TO), rows.vars | new.vars)


def between(rows: Rows, src: str, links: DataFrame, dst: str) -> Rows:
    """Keep the rows whose two bound variables are joined; pairs are distinct, so rows keep their number."""
    kept = rows.df.join(links, (key(src) == links[FROM]) & (key(dst) == links[TO]), "left_semi")
    return Rows(kept, rows.vars)


def across(left: Rows, src: str, links: DataFrame, dst: str, right: Rows) -> Rows:
    """Connect two separate sets of rows through the pairs, the smaller set first."""
    ends = [(left.df, key(src) == F.col(FROM)), (right.df, key(dst) == F.col(TO))]
    if expected_bytes(right.df.select(key(dst))) < expected_bytes(left.df.select(key(src))):
        ends.reverse()
    df = links
    for side, same in ends:
        df = side.join(df, same)
    return Rows(df.drop(FROM, TO), left.vars | right.vars)


def without(rows: Rows, what: Column | DataFrame, keys: list[str]) -> Rows:
    """Drop the rows that fulfil a condition, or whose variables ``keys`` have ids that are in a table."""
    if isinstance(what, Column):
        return Rows(rows.df.filter(~what), rows.vars)
    same = reduce(Column.__and__, [key(v) == what[f"__hit{i}"] for i, v in enumerate(keys)])
    return Rows(rows.df.join(what, same, "left_anti"), rows.vars)


def product(left: Rows, right: Rows, tests: list[tuple[Column | DataFrame, list[str]]], asked: Callable[[Rows], list[str]]) -> Rows:
    """All pairs of rows but those that a test takes away (see ``without``); of columns those that are ``asked`` for.

    The product is never shuffled: the excluded ids of ``left`` travel with
    the rows of ``right``, and each pair is tested as it is made.  A row with
    many of them has copies, each with the ids of one range of hashes, and
    each meets only that range; the ranges of a row leave nothing out.
    """
    vars = left.vars | right.vars
    tile = not left.product and not right.product
    if (tests or tile) and expected_bytes(right.df.select(*map(key, right.vars))) < expected_bytes(left.df.select(*map(key, left.vars))):
        left, right = right, left
    a, b, kept, added = *(rows.df.select(*[f"`{c}`" for c in asked(rows)]) for rows in (left, right)), [], []
    for i, (what, keys) in enumerate(tests):
        if isinstance(what, Column):
            kept.append(~what)
            continue
        low, high, ids, other, hashed = (f"__{x}{i}" for x in ("low", "high", "ids", "other", "hash"))
        hit = {v: F.col(f"__hit{j}") for j, v in enumerate(keys)}
        at = {f"__at{i}_{j}": v for j, v in enumerate(v for v in keys if v in right.vars)}
        rest = [v for v in keys if v in left.vars]
        held = what.dropna().select(*[hit[v].alias(c) for c, v in at.items()], _one([hit[v] for v in rest]).alias(other))
        held = held.withColumn(hashed, F.xxhash64(other)).withColumn("__slot", F.floor((F.rank().over(Window.partitionBy(*at).orderBy(hashed)) - 1) / SLOT))
        held = held.groupBy(*at, "__slot").agg(F.min(hashed).alias(low), F.collect_list(other).alias(ids))
        held = held.withColumn(high, F.lead(low).over(Window.partitionBy(*at).orderBy("__slot")))
        held = held.withColumn(low, F.when(F.col("__slot") > 0, F.col(low)).otherwise(F.lit(-(2**63)))).drop("__slot")
        b = b.join(held, reduce(Column.__and__, [key(v) == F.col(c) for c, v in at.items()]), "left").drop(*at)
        a = a.withColumn(other, _one([key(v) for v in rest])).withColumn(hashed, F.xxhash64(other))
        inside = (F.col(hashed) >= F.col(low)) & (F.col(high).isNull() | (F.col(hashed) < F.col(high)))
        kept.append(F.col(low).isNull() | inside & ~F.coalesce(F.array_contains(F.col(ids), F.col(other)), F.lit(False)))
        added += [low, high, ids, other, hashed]
    df = tiled(a, [key(v) for v in left.vars], b, [key(v) for v in right.vars]) if tile else a.crossJoin(b)
    if kept:
        df = df.filter(reduce(Column.__and__, kept)).drop(*added)
    return Rows(df, vars, product=True)


def tiled(a: DataFrame, a_ids: list[Column], b: DataFrame, b_ids: list[Column]) -> DataFrame:
    """All pairs, in an order that takes little space when it is written.

    A task takes one tile of ``a`` after the other, and each row of ``b`` with
    all rows of the tile.  So the columns of ``b`` stay the same for a tile's
    length, those of ``a`` come again after it, and a task has few different
    values of both: dictionary, run lengths and any codec shrink that to about
    a bit a row, where a longer cycle outgrows a dictionary or a codec's window.
    """
    share, at = "__share", Window.partitionBy("__share").orderBy(*a_ids)
    tiles = a.withColumn(share, F.pmod(F.xxhash64(*a_ids), F.lit(SHARES)).cast("int")).repartitionById(SHARES, F.col(share))
    tiles = tiles.withColumn("__tile", F.floor((F.row_number().over(at) - 1) / TILE))
    tiles = tiles.groupBy(share, "__tile").agg(F.collect_list(F.struct(*[f"`{c}`" for c in a.columns])).alias("__rows")).select("__rows")
    parts = min(-(-read_bytes(b) // PART_BYTES), int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the hint keeps the tiles outside: a broadcast would go through all of them for each row of b
    return tiles.hint("shuffle_replicate_nl").crossJoin(b.repartition(max(1, parts), *b_ids)).select(*[f"`{c}`" for c in b.columns], F.inline("__rows"))


def _one(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.struct(*[c.alias(f"k{j}") for j, c in enumerate(columns)])
