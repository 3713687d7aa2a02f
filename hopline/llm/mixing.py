"""Mixing sources by temperature, with DataFrame functions only.

A source's natural share is its part of all tokens; its weight is that share
to the power of an exponent, normalised.  The exponent (1 natural, 0 uniform)
is bisected until the mixture's entropy reaches a target or no source is
repeated more than a limit.  The weights times a token budget give each
source a quota, and the quota is realised as block permutations: a source's
texts lie in ``BLOCKS`` blocks of ``BLOCKS`` cells by the hash of their id,
each epoch permutes blocks, and cells within them, by a hash of (seed, epoch,
source, block, cell), whole epochs are passed in full, and the last one stops
at the token where the quota ends.

What is small by construction: one row per source and block (``BLOCKS`` a
source at most) after a map-side sum; then one per source and cell of its one
cut block; then one per source.  The texts are read where they lie; only those
of each source's one cut cell, a ``BLOCKS`` squared part of it, go through a
window.  By default the budget is the least for which every text is passed at
least once, so nothing is dropped and small sources are repeated.

Edge cases: a null source is a source of its own; null and empty texts have no
tokens, and a source without tokens is passed once; rows that repeat an id
share its block; an empty table gives an empty table; one source keeps its
weight 1; input columns named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopline.llm import common

BLOCKS = 1024
#: Bits of the exponent; each pass over the sources settles ``STEP_BITS``.
BITS, STEP_BITS = 20, 4


def tokens(text: Column) -> Column:
    """The number of words: each becomes one letter, with the blanks after it; ``regexp_count`` would make an array of them all."""
    letters = F.ltrim(F.regexp_replace(text, F.lit("[^ \\t-\\r]+[ \\t-\\r]*"), F.lit("w")), F.lit(common.BLANKS))
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def _part(doc_id: Column, at: int) -> Column:
    """A number below ``BLOCKS`` from the hash of an id: the block at 1, the cell at 9."""
    return (F.conv(F.substring(_key(F.lit("block"), doc_id), at, 8), 16, 10).cast("long") % BLOCKS).cast("int")


def _cut(parts: DataFrame, name: str) -> DataFrame:
    """One row per ``src``: the key of the part in which ``rest`` runs out, and what is left of it there.

    ``parts`` has src, rest, key and n (tokens), at most ``BLOCKS`` rows a source.
    """
    upto = F.sum("n").over(Window.partitionBy("src").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    past = parts.withColumn("upto", upto).filter("rest > 0 AND upto > rest")
    cut = past.groupBy("src").agg(F.min(F.struct("key", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("cut"))
    return common.stage(cut.select(F.col("src").alias("s2"), F.col("cut.key").alias(name), F.col("cut.left").alias(f"{name}_left")), name)


def exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent by bisection, ``STEP_BITS`` halvings per pass: each pass tries all midpoints they may need.

    Repeats fall and entropy falls as the exponent grows.  For a repetition
    limit the least exponent that keeps it is taken; for a target entropy the
    greatest that reaches it; the limit wins if both can't be met.
    """

    def settle(holds) -> float:
        """The point where ``holds`` turns true, on the grid of 2**-BITS; 0.0 if it holds everywhere."""
        low, width = 0.0, 1.0
        n = 2**STEP_BITS
        first = True
        for _ in range(BITS // STEP_BITS):
            points = [low + width * i / n for i in range(0 if first else 1, n)]
            grid = sources.select("share", F.explode(F.array(*[F.lit(x) for x in points])).alias("a"))
            power = F.pow("share", F.col("a"))
            stats = grid.groupBy("a").agg(
                F.sum(power).alias("z"),
                F.sum(power * F.log("share")).alias("e"),
                F.max(F.pow("share", F.col("a") - 1)).alias("most"),
                F.min(F.pow("share", F.col("a") - 1)).alias("least"),
            )
            known = {r["a"]: r for r in stats.collect()}  # as many rows as points
            held = next((i for i, x in enumerate(points) if holds(x, known[x])), len(points))
            if first and held == 0:
                return 0.0
            at = held if first else held + 1
            low, width, first = low + width * (at - 1) / n, width / n, False
        return low + width

    if max_repeats is None and target_entropy is None:
        return 1.0
    chosen = []
    if max_repeats is not None:
        chosen.append(settle(lambda a, r: r["most"] / r["least"] <= max_repeats))
    if target_entropy is not None:
        past = settle(lambda a, r: math.log(r["z"]) - a * r["e"] / r["z"] < target_entropy)  # 1.0 if never
        chosen.append(max(0.0, past - 2.0**-BITS) if past < 1.0 else 1.0)
    return max(chosen)


def plan(docs: DataFrame, text: str, source: str, doc_id: str, target_entropy: float | None, max_repeats: float | None, budget: int | None, seed: int) -> DataFrame:
    """One row per source: tokens, weight, quota, whole epochs, and where the last epoch is cut."""
    blocks = (
        docs.select(F.col(f"`{source}`").alias("src"), _part(F.col(f"`{doc_id}`"), 1).alias("block"), tokens(F.col(f"`{text}`")).alias("n"))
        .groupBy("src", "block")
        .agg(F.sum("n").alias("n"))
    )
    blocks = common.stage(blocks, "blocks")
    totals = common.stage(blocks.groupBy("src").agg(F.sum("n").alias("n_source")), "totals")
    whole = totals.agg(F.sum("n_source")).first()[0] or 0
    shares = common.stage(totals.withColumn("share", F.col("n_source") / F.lit(max(1, whole))), "shares")
    alpha = exponent(shares.filter("n_source > 0"), target_entropy, max_repeats) if whole else 1.0
    z, least = shares.filter("n_source > 0").agg(F.sum(F.pow("share", F.lit(alpha))), F.max(F.pow("share", F.lit(1 - alpha)))).first()
    z, least = z or 1.0, least or 1.0
    # the least budget that passes every source once is max(n / weight) = whole * z * max(share ** (1 - alpha))
    total = float(budget) if budget is not None else whole * z * least
    quotas = shares.select(
        "src",
        "n_source",
        F.when(F.col("n_source") > 0, F.pow("share", F.lit(alpha)) / F.lit(z)).otherwise(0.0).alias("weight"),
    ).withColumn("quota", F.round(F.col("weight") * F.lit(total)).cast("long"))
    empty = F.col("n_source") == 0
    quotas = quotas.withColumns(
        {
            "exponent": F.lit(alpha),
            "epochs": F.when(empty, 1).otherwise(F.expr("quota div greatest(n_source, 1)")).cast("int"),
            "rest": F.when(empty, 0).otherwise(F.expr("quota % greatest(n_source, 1)")).cast("long"),
        }
    )
    quotas = common.stage(quotas, "quotas")
    # the cut: the block in which the last epoch ends, then the cell within that block
    def with_plan(rows: DataFrame, known: DataFrame) -> DataFrame:
        return rows.join(common.broadcast_if_small(known, 256), F.col("src").eqNullSafe(F.col("s1"))).drop("s1")

    known = quotas.select(F.col("src").alias("s1"), "epochs", "rest")
    turned = with_plan(blocks, known).withColumn("key", _key(F.lit(seed), F.col("epochs") + 1, F.col("src"), F.col("block")))
    cut = _cut(turned, "cut_block")
    known = quotas.join(common.broadcast_if_small(cut, 256), F.col("src").eqNullSafe(F.col("s2"))).select(F.col("src").alias("s1"), "epochs", "cut_block", F.col("cut_block_left").alias("rest"))
    known = common.stage(known, "cutplan")
    own = docs.select(F.col(f"`{source}`").alias("src"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    inside = with_plan(own.withColumn("block", _part(F.col("id"), 1)), known)
    inside = inside.filter(_key(F.lit(seed), F.col("epochs") + 1, F.col("src"), F.col("block")) == F.col("cut_block"))
    cells = inside.withColumn("cell", _part(F.col("id"), 9)).groupBy("src", "block", "epochs", "rest", "cell").agg(F.sum(tokens(F.col("t"))).alias("n"))
    cells = cells.withColumn("key", _key(F.lit(seed), F.col("epochs") + 1, F.col("src"), F.col("block"), F.col("cell")))
    cell = _cut(cells, "cut_cell")
    out = quotas.join(common.broadcast_if_small(cut, 256), F.col("src").eqNullSafe(F.col("s2")), "left").drop("s2")
    return out.join(common.broadcast_if_small(cell, 256), F.col("src").eqNullSafe(F.col("s2")), "left").drop("s2")


ADDED = ["n_tokens", "epoch", "block", "order_key"]


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    target_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """The rows of ``docs``, each once per epoch in which it is passed.

    Adds ``n_tokens``, ``epoch`` (from 1), ``block`` and ``order_key``: the
    mixed stream is the rows in the order of ``order_key`` (no order is
    imposed here, for that would shuffle the texts).
    """
    common.small_batches(docs.sparkSession)
    docs = common.without(docs, ADDED)
    planned = plan(docs, text, source, doc_id, target_entropy, max_repeats, budget, seed)
    planned = common.stage(planned.select(F.col("src").alias("__src"), "epochs", "rest", "cut_block", "cut_cell", "cut_cell_left"), "plan")
    small = common.broadcast_if_small(planned, 256)
    # positions stand for names, which might clash; each row carries its text once
    own = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    s, i, t = (F.col(own[c]) for c in (source, doc_id, text))
    placed = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()])
    placed = placed.withColumns({"n_tokens": tokens(t), "block": _part(i, 1), "__cell": _part(i, 9)}).join(small, s.eqNullSafe(F.col("__src")))
    last = [F.lit(seed), F.col("epochs") + 1, s, F.col("block")]
    placed = placed.withColumns({"__b": _key(*last), "__c": _key(*last, F.col("__cell"))})
    none = F.array().cast("array<int>")
    full = F.when(F.col("epochs") > 0, F.sequence(F.lit(1), F.col("epochs"))).otherwise(none)
    before = (F.col("__b") < F.col("cut_block")) | (F.col("__b") == F.col("cut_block")) & (F.col("__c") < F.col("cut_cell"))
    inside = F.when((F.col("rest") > 0) & (F.col("cut_block").isNull() | before), F.array(F.col("epochs") + 1)).otherwise(none)
    out = [*own.values(), "n_tokens", "block"]
    passed = placed.select(*out, F.explode(F.concat(full, inside)).alias("epoch"))
    # the texts of the one cut cell of each source, in their own order up to the quota
    edge = placed.filter("rest > 0 AND __b = cut_block AND __c = cut_cell")
    order = [_key(F.lit(seed), F.col("epochs") + 1, i), i, F.md5(F.coalesce(t, F.lit("")).cast("binary"))]
    upto = F.sum("n_tokens").over(Window.partitionBy("__src").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("__upto", upto).filter("__upto <= cut_cell_left").select(*out, (F.col("epochs") + 1).alias("epoch"))
    return passed.unionByName(edge).select(
        *[F.col(o).alias(c) for c, o in own.items()],
        "n_tokens",
        "epoch",
        "block",
        F.concat(_key(F.lit(seed), F.col("epoch"), s, F.col("block")), _key(F.lit(seed), F.col("epoch"), i)).alias("order_key"),
    )
