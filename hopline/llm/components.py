"""Connected components of a link table, by alternating stars.

A large-star round hangs every larger neighbour of a node on the node's
smallest neighbour; a small-star round does so for the smaller ones.  The
table of links shrinks to stars whose centre is each component's smallest
node.  Every step is a join or an aggregation with map-side combine on staged
tables: nothing is collected but one row of counts per round, and the joins
are between two scans, so adaptive execution can split a hot centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm import common


def _parents(links: DataFrame) -> DataFrame:
    return common.stage(links.groupBy(F.col("u").alias("p")).agg(F.min("v").alias("top")), "parents")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node reachable.

    Null ends and self links are dropped; repeated and reversed links count
    once.  An empty table gives an empty table.
    """
    now = common.stage(
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        tops = _parents(now)
        # large star: at v, its larger neighbours u move to the smallest neighbour of v (or to v)
        large = now.join(tops, F.col("v") == F.col("p"), "left").select("u", F.coalesce("top", "v").alias("v")).distinct()
        large = common.stage(large, "large")
        # small star: at u, its smaller neighbours and u itself move to the smallest of them
        tops = _parents(large)
        small = large.join(tops, F.col("u") == F.col("p")).select(F.col("v").alias("u"), F.col("top").alias("v")).filter("u <> v")
        now = common.stage(small.unionByName(tops.select(F.col("p").alias("u"), F.col("top").alias("v"))).distinct(), "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state[0] == state[2] and tuple(state) == before or not state[0]:
            break
        before = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
