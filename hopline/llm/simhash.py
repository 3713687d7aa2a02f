"""SimHash near-duplicates: exact Hamming links, compared in tiles.

``fingerprints`` makes the 64-bit SimHash of each text.  ``links`` compares
distinct fingerprints exactly.  They are keyed by pigeonhole: of ``blocks``
blocks, two fingerprints within the radius agree on at least ``blocks -
radius``, so each choice of that many blocks is a key and every link meets
under some key.  Under a key, rows lie in the order of their population
counts and are compared tile by tile with numpy exclusive-or and bit counts;
a tile pair whose population counts differ by more than the radius is
skipped.  Keys with more rows than a tile are split, before any task sees
them, into tiles of one population class each, and only class pairs within
the radius are formed.  A task emits a spanning forest of the links that it
finds, not all pairs, so a group of n near copies gives O(n) rows.

Edge cases: null and empty texts have fingerprint zero and link like any
other; texts of fewer than ``size`` words are one shingle; equal fingerprints
(repeated rows, exact copies) are one node; a null id takes no part in the
minimum, and a group without ids has a null component; empty tables give
empty tables; input columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.llm import common
from hopline.llm.components import components

RADIUS = 3
#: Rows of a tile; two tiles meet in one task at most.
TILE = 4096
#: Groups of up to so many rows are compared side by side, shifted along the sorted rows.
NARROW = 48
#: Hashes that are unpacked to bits at once.
HASHES = 65_536


def fingerprint(raw: bytes, size: int = 3, seed: int = 42) -> int:
    """The SimHash of one text: a bit is set if it is set in over half of the shingles' XXH64."""
    words = raw.lower().split()  # bytes: only A-Z fold
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), HASHES):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + HASHES], last[at : at + HASHES])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > len(first)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """Add ``fingerprint`` (bigint: the 64 bits as a signed number) of each whole text."""

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            made = np.array([fingerprint(x, size, seed) for x in common.blobs(column)], dtype=np.uint64)
            return [pa.array(made.view(np.int64))]

        return work

    return common.map_columns(docs, [text], T.StructType([T.StructField("fingerprint", T.LongType())]), make)


class Forest:
    """Union-find over n rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def tile_forest(left: np.ndarray, right: np.ndarray, radius: int, forest: Forest, base: int, other: int, rows: int = 256) -> None:
    """Join rows of two tiles (sorted by population count) that lie within the radius.

    ``base`` and ``other`` are the tiles' offsets in the forest.  The left tile
    is taken in strips, against the part of the right one whose population
    counts lie within the radius.  A tile against itself is compared from the
    strip onward only.
    """
    ones_l, ones_r = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    for at in range(0, len(left), rows):
        strip, counts = left[at : at + rows], ones_l[at : at + rows]
        low, high = np.searchsorted(ones_r, counts[0] - radius), np.searchsorted(ones_r, counts[-1] + radius, "right")
        if left is right:
            low = max(low, at)
        if low >= high:
            continue
        near = np.bitwise_count(strip[:, None] ^ right[None, low:high]) <= radius
        for i in np.flatnonzero(near.any(1)).tolist():
            own, up = base + at + i, forest.up
            for j in {up[x] for x in (other + low + np.flatnonzero(near[i])).tolist()}:
                forest.join(own, j)


def narrow_forest(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, smallest linked row) within runs of equal keys, all runs side by side.  Rows are sorted by key."""
    n, labels = len(keys), np.arange(len(keys))
    ends_a, ends_b = [], []
    shift = 1
    while shift < n:
        same = keys[shift:] == keys[:-shift]
        if not same.any():
            break
        at = np.flatnonzero(same & (np.bitwise_count(prints[shift:] ^ prints[:-shift]) <= radius))
        ends_a.append(at)
        ends_b.append(at + shift)
        shift += 1
    if not ends_a:
        return labels[:0], labels[:0]
    a, b = np.concatenate(ends_a), np.concatenate(ends_b)
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == labels).all():
            break
        labels = new
    moved = np.flatnonzero(labels != np.arange(n))
    return moved, labels[moved]


def forests(radius: int):
    """A task's work: rows (key, side, print) sorted by key, side and population count, to links (a, b)."""

    def group(side: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        forest = Forest(len(prints))
        cut = int(np.searchsorted(side, 1))
        if cut == 0 or cut == len(prints):  # one tile with itself
            tile_forest(prints, prints, radius, forest, 0, 0)
        else:
            tile_forest(prints[:cut], prints[cut:], radius, forest, 0, cut)
        tops = np.array([forest.top(x) for x in range(len(prints))])
        moved = np.flatnonzero(tops != np.arange(len(prints)))
        return prints[moved], prints[tops[moved]]

    def links_of(keys: np.ndarray, side: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        lengths = np.diff(np.append(starts, len(keys)))
        paired = np.add.reduceat(side, starts) > 0  # two tiles of a split key: compared across only
        narrow = (lengths <= NARROW) & ~paired
        take = np.repeat(narrow & (lengths > 1), lengths)
        if take.any():
            own = prints[take]
            a, b = narrow_forest(keys[take], own, radius)
            yield own[a], own[b]
        for start, length in zip(starts[~narrow].tolist(), lengths[~narrow].tolist()):
            yield group(side[start : start + length], prints[start : start + length])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (list(z) for z in (zip(*found) if found else ((), ()))))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        kept = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)]
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            keys, side, prints = (np.concatenate(x) for x in zip(kept, (new[0], new[1].astype(np.int8), new[2].view(np.uint64))))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on in the next batch
            kept = [keys[cut:], side[cut:], prints[cut:]]
            if cut:
                yield out(list(links_of(keys[:cut], side[:cut], prints[:cut])))
        if len(kept[0]):
            yield out(list(links_of(*kept)))

    return run


def key_plan(n: int, radius: int, tile: int = TILE) -> int:
    """The number of blocks: the fewest for which n random fingerprints fill a key to a quarter tile at most."""
    for blocks in range(radius + 1, radius + 5):
        if n / 2 ** (64 * (blocks - radius) / blocks) <= tile / 4:
            return blocks
    return radius + 4


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) fingerprints: a forest that connects whatever links within the radius connect.

    ``distinct`` holds each fingerprint once and should be staged: it is
    counted for the key plan, keyed twice (counts, rows) and compared.
    """
    blocks = key_plan(distinct.count(), radius, tile)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(number), F.col("fingerprint").bitwiseAND(F.lit(mask).cast("bigint"))))
    # a key is a hash of (choice, block bits): keys that collide are compared together, which is exact all the same
    keyed = distinct.select("fingerprint", F.bit_count("fingerprint").alias("ones"), F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key", "ones").agg(F.count("*").alias("n"))
    wide = common.stage(
        sizes.groupBy("key").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).alias("tiles")))).alias("tiles")).filter(F.col("all") > tile),
        "wide",
    )  # at most 65 population classes per key
    joined = keyed.join(common.broadcast_if_small(wide, 2048), "key", "left")
    narrow = joined.filter("tiles IS NULL").select("key", F.lit(0).alias("side"), "fingerprint", "ones")
    # a tile of a wide key is (ones, part); it meets itself and every later tile within the radius
    part = F.pmod(F.xxhash64("fingerprint"), F.element_at("tiles", F.col("ones")))
    own = joined.filter("tiles IS NOT NULL").withColumn("part", part.cast("int"))
    meets = F.flatten(
        F.transform(
            F.filter(F.map_keys("tiles"), lambda o: F.abs(o - F.col("ones")) <= radius),
            lambda o: F.transform(F.sequence(F.lit(0).cast("bigint"), F.element_at("tiles", o) - 1), lambda p: F.struct(o.alias("o"), p.cast("int").alias("p"))),
        )
    )
    split = own.withColumn("meet", F.explode(meets)).withColumn("me", F.struct(F.col("ones").alias("o"), F.col("part").alias("p")))
    split = split.select(
        F.xxhash64("key", F.least("me", "meet"), F.greatest("me", "meet")).alias("key"),
        F.when(F.col("me") > F.col("meet"), 1).otherwise(0).alias("side"),
        "fingerprint",
        "ones",
    )
    rows = narrow.unionByName(split)
    distinct.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", common._PACKAGE_ROOT)
    dealt = rows.repartition("key").sortWithinPartitions("key", "side", "ones").select("key", "side", "fingerprint")
    return dealt.mapInArrow(forests(radius), "a bigint, b bigint")


def clusters(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, cluster) for each fingerprint of ``prints``, which holds each once and is staged.

    ``cluster`` is the smallest fingerprint (as a signed number) of the group.
    """
    linked = common.stage(components(links(prints.select("fingerprint"), radius)), "linked")
    tied = prints.select("fingerprint").join(linked, F.col("fingerprint") == F.col("node"), "left")
    return common.stage(tied.select("fingerprint", F.coalesce("label", "fingerprint").alias("cluster"), F.col("label").isNotNull().alias("tied")), "clusters")


def classes(docs: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(rows of ``docs``) with ``cluster`` and ``component_id``, the smallest id of the group.

    ``docs`` has ``doc_id`` and ``fingerprint`` and should be staged: it is
    read for the distinct fingerprints and for the final join.
    """
    distinct = common.stage(docs.groupBy("fingerprint").agg(F.min(doc_id).alias("least_id")), "prints")
    tied = common.stage(clusters(distinct, radius).join(distinct, "fingerprint"), "tied")
    least = tied.filter("tied").groupBy(F.col("cluster").alias("c")).agg(F.min("least_id").alias("least_all"))
    least = common.stage(least, "least")
    named = tied.join(least, F.col("cluster") == F.col("c"), "left").select(
        F.col("fingerprint").alias("__f"), "cluster", F.when(F.col("tied"), F.col("least_all")).otherwise(F.col("least_id")).alias("component_id")
    )
    named = common.stage(named, "named")
    docs = common.without(docs, ["cluster", "component_id"])
    return docs.join(named, F.col("fingerprint") == F.col("__f")).drop("__f")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group, with its own columns: that of the smallest id, of equal ids the smallest text.

    Ids and fingerprints are staged apart from the texts and summed up by
    fingerprint (map side first, so copies of one text cost one row a task)
    before groups are formed.  The texts are read again: rows whose id stands
    in no row that goes, nor in several rows, stay where they lie, and only
    the others (a bitmap of ids tells them apart) are fingerprinted again and
    joined by (id, fingerprint) to the one row that stays.
    """
    columns = docs.columns
    ids = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("__t"))
    prints = common.stage(fingerprints(ids, "__t").drop("__t"), "docprints")
    # the smallest id of a fingerprint, and how many rows share it
    named = common.stage(prints.groupBy("fingerprint", "id").agg(F.count("*").alias("n")), "named")
    least = named.groupBy("fingerprint").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fingerprint", "n")).alias("name"))
    least = common.stage(least, "prints")
    firsts = clusters(least.select("fingerprint")).select("fingerprint", "cluster").join(least, "fingerprint")
    firsts = firsts.groupBy("cluster").agg(F.min("name").alias("f")).select(F.col("f.id").alias("__id"), F.col("f.fingerprint").alias("__f"), F.col("f.n").alias("__n"))
    firsts = common.stage(firsts, "firsts")
    same = named["id"].eqNullSafe(F.col("__id")) & (named["fingerprint"] == F.col("__f"))
    unsure = named.filter("n > 1").select("id").unionByName(named.join(firsts, same, "left_anti").select("id"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(f"`{doc_id}`").alias("__i"), F.col(f"`{text}`").alias("__t"))
    packed = common.maybe_in(packed, common.bitmap(unsure, F.col("id")), F.col("__i"))
    sure = packed.filter("NOT __maybe").select("__row.*")
    again = fingerprints(packed.filter("__maybe").drop("__maybe"), "__t")
    kept = again.join(firsts, again["__i"].eqNullSafe(F.col("__id")) & (again["fingerprint"] == F.col("__f")))
    alone = sure.unionByName(kept.filter("__n = 1").select("__row.*"))
    if not firsts.filter("__n > 1").limit(1).count():
        return alone
    # repeated rows: of those with one id and fingerprint the smallest text
    shared = kept.filter("__n > 1").groupBy("__id", "__f").agg(F.min_by("__row", F.coalesce(F.col("__t"), F.lit(""))).alias("__row"))
    return alone.unionByName(shared.select("__row.*"))
