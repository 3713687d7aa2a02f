"""Exact top-k by inner product over norm-sorted vectors.

Components become the integers floor(scale * x).  Candidates are cut into
ranges of descending length, queries into blocks.  A query is live for a range
(and within it for a tile) while its length times the greatest length there
can still reach the query's k-th best score (Cauchy-Schwarz).  For live
queries the vectors, rotated onto the singular directions of a bounded sample,
are multiplied over the leading dimensions only, and the rest is bounded by
the product of the residual lengths; pairs whose bound falls short are
dropped, the others are scored exactly.  The rotation only affects speed.

The plan: vectors are staged by length, a range a task.  Each query meets the
longest ``SEED`` vectors first, and the k-th best score from them, staged with
it, is its floor.  Blocks are joined to the ranges that some floor of theirs
leaves, a small table of pairs; candidates and queries follow those pairs and
meet in one group for each, whose size is bounded on both sides.  What the
groups find is merged for each query.  Nothing but the sample and the seeds,
both bounded, passes through the driver, and there is no loop over blocks.

Queries are a stated set, each against all rows.  The work is quadratic where
lengths hardly differ.

Edge cases: vectors that are null or hold null or non-finite components (also
once scaled), and rows without an id, take no part; every row is a candidate
of its own, also where an id stands in several, and for a query all rows but
itself are; query rows that share an id are searched each by itself, and each
gives its own ranks; only vectors of equal dimension meet; with fewer than k
candidates all are given; ties go to the smaller id; sums beyond 2**53 are
taken with whole numbers of any size and clipped to 64 bits; empty tables give
empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopline.llm import common

K, SCALE = 10, 1024
#: Queries in one block, about; rows of a range, about; longest vectors that seed the floors; rows of a tile; rows that fit the rotation, about.
BLOCK, RANGE, SEED, TILE, SAMPLE = 4096, 32_768, 1024, 1024, 4096
#: Allowance for rounding when bounds are compared, relative and absolute.
SLACK = (1e-9, 1e-6)
EXACT = 2.0**53
LIMIT = 2**63 - 1


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, x: integers as array<double>, d, length), one row for each that takes part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float("inf")))
    rows = vectors.filter(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{vector}`").isNotNull()).filter(fine)
    big = 2.0**52  # from here on every double is whole
    rows = rows.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.when(F.abs(v * scale) < big, F.floor(v * scale).cast("double")).otherwise(v * scale)).alias("x"),
    )
    return rows.withColumns({"d": F.size("x"), "length": F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))})


def rotation(rows: np.ndarray) -> np.ndarray:
    """Right singular vectors of a sample, strongest first."""
    with np.errstate(all="ignore"):
        usable = len(rows) and np.isfinite(rows @ rows.T).all()
    return np.linalg.svd(rows, full_matrices=len(rows) < rows.shape[1])[2].T if usable else np.eye(rows.shape[1])


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows of whole numbers, as 64-bit integers."""
    if len(a) == 0:
        return np.zeros(0, np.int64)
    if (np.linalg.norm(a, axis=1).max() + 1) * (np.linalg.norm(b, axis=1).max() + 1) < EXACT:  # no partial sum can round
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    sums = [sum(int(p) * int(q) for p, q in zip(u, v)) for u, v in zip(a.tolist(), b.tolist())]
    return np.array([max(-LIMIT - 1, min(LIMIT, s)) for s in sums], dtype=np.int64)


class Search:
    """Queries of one dimension, with their best scores so far.  ``rows`` numbers each row of the table; ids may repeat."""

    def __init__(self, own: np.ndarray, vectors: np.ndarray, turn: np.ndarray, floor: np.ndarray, k: int):
        self.own, self.vectors, self.turn, self.k = own, vectors, turn, k
        self.floor = floor.astype(np.float64)  # no score below this can be among the best
        with np.errstate(all="ignore"):
            self.lengths = np.linalg.norm(vectors, axis=1)
            d = vectors.shape[1]
            self.lead = max(1, d // 4)
            turned = vectors @ turn
            self.head = turned[:, : self.lead]
            self.rest = np.linalg.norm(turned[:, self.lead :], axis=1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in own]  # (-score, vec_id)
        self.pairs_scored = self.tiles_skipped = 0

    def tile(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> bool:
        """Take a tile; false if no query was live, so that none of its vectors, nor any shorter one, can matter.

        Tests are written as "not less than", so that bounds lost to overflow keep a pair.
        """
        with np.errstate(all="ignore"):
            return self._tile(rows, ids, vectors)

    def all(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take many rows, longest first, tile by tile."""
        with np.errstate(all="ignore"):
            order = np.argsort(-np.linalg.norm(vectors, axis=1), kind="stable")
        for at in range(0, len(order), TILE):
            some = order[at : at + TILE]
            if not self.tile(rows[some], ids[some], vectors[some]):
                break

    def _tile(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> bool:
        lengths = np.linalg.norm(vectors, axis=1)
        reach = lengths.max() if len(vectors) else 0.0
        slack = SLACK[0] * (self.lengths * reach) + SLACK[1]
        live = np.flatnonzero(~(self.lengths * reach + slack < self.floor))
        if not len(live):
            self.tiles_skipped += 1
            return False
        turned = vectors @ self.turn
        rest = np.linalg.norm(turned[:, self.lead :], axis=1)
        bound = self.head[live] @ turned[:, : self.lead].T + self.rest[live][:, None] * rest[None, :]
        near = ~(bound + slack[live][:, None] < self.floor[live][:, None]) & (self.own[live][:, None] != rows[None, :])
        q, c = np.nonzero(near)
        for at in range(0, len(q), 65_536):
            own, other = live[q[at : at + 65_536]], c[at : at + 65_536]
            scores = exact_scores(self.vectors[own], vectors[other])
            self.pairs_scored += len(scores)
            good = scores >= self.floor[own]
            self.add(own[good], ids[other[good]], scores[good])
        return True

    def add(self, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids, -scores.astype(np.float64), own))
        own, ids, scores = own[order], ids[order], scores[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else []
        for start, end in zip(starts, [*starts[1:], len(own)]):
            i = own[start]
            best = self.best[i]
            best += [(-s, v) for s, v in zip(scores[start:end].tolist(), ids[start:end].tolist())]
            best.sort()
            del best[self.k :]
            if len(best) == self.k:
                kth = float(-best[-1][0])
                self.floor[i] = max(self.floor[i], kth if abs(kth) < EXACT else np.nextafter(kth, -np.inf))

    def found(self) -> list[tuple[int, int, int]]:
        """(row of the query, vec_id, score)."""
        return [(q, v, -s) for q, best in zip(self.own.tolist(), self.best) for s, v in best]


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    flat = pc.list_flatten(column)
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), d) if isinstance(flat, pa.Array) else flat.to_numpy().reshape(len(column), d)


def _taken(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, ids, matrix) of a bounded selection, on the driver."""
    table = rows.select("row", "vec_id", "x").toArrow()
    return table["row"].to_numpy(), table["vec_id"].to_numpy(), _matrix(table["x"], d) if len(table) else np.zeros((0, d))


FOUND = "row bigint, vec_id bigint, score bigint"


def _with_floors(queries: DataFrame, seeds: Broadcast, k: int) -> DataFrame:
    """Add ``floor``: the k-th best score among the seeds, -inf where there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, vectors, turn = seeds.value
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                first = Search(own, _matrix(batch.column(2), vectors.shape[1]), turn, np.full(len(own), -np.inf), k)
                first.all(rows, ids, vectors)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first.floor)], names=["row", "vec_id", "x", "length", "floor"])

    return queries.select("row", "vec_id", "x", "length").mapInArrow(run, "row bigint, vec_id bigint, x array<double>, length double, floor double")


def _pairs(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(block, range) where some query of the block may find one of its best in the range."""
    relative, absolute = SLACK
    reach = F.when(F.col("length") > 0, (F.col("floor") - absolute) / (F.col("length") * (1 + relative))).when(F.col("floor") > absolute, float("inf")).otherwise(float("-inf"))
    need = blocks.groupBy("block").agg(F.min(F.when(F.col("floor") == float("-inf"), float("-inf")).otherwise(reach)).alias("need"))
    return common.stage(need.join(ranges, F.col("longest") >= F.col("need")).select("block", "range"), "pairs")


def _search(turn: Broadcast, d: int, k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        search = Search(queries["row"].to_numpy(), _matrix(queries["x"], d), turn.value, queries["floor"].to_numpy(), k)
        search.all(candidates["row"].to_numpy(), candidates["vec_id"].to_numpy(), _matrix(candidates["x"], d))
        found = list(zip(*search.found())) or ((), (), ())
        return pa.table([pa.array(c, type=pa.int64()) for c in found], names=["row", "vec_id", "score"])

    return run


def topk(
    vectors: DataFrame,
    is_query: str = "vec_id % 100 = 0",
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of each query row."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    sc.environment.setdefault("PYTHONPATH", common._PACKAGE_ROOT)
    rows = whole_vectors(vectors, vec_id, vector, scale)
    shuffled = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(shuffled, -(-vectors.count() // RANGE))
    # by length, longest first: a task holds a range of lengths; the id splits what has one length (copies of a common vector)
    order = [F.col("d"), F.col("length").desc(), F.col("vec_id")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = common.stage(rows.withColumns({"range": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "vectors")
    counts = {r["d"]: r for r in rows.groupBy("d").agg(F.count("*").alias("n"), F.count(F.when(F.expr(is_query), 1)).alias("q")).collect()}  # one row a dimension
    found: list[DataFrame] = []
    asked: list[DataFrame] = []
    for d in sorted(d for d, c in counts.items() if d and c["q"]):  # no components, or nothing asked: nothing to score
        n = counts[d]["n"]
        own = rows.filter(F.col("d") == d)
        part = F.pmod(F.xxhash64(F.lit("fit"), "row"), F.lit(1 << 20)) / (1 << 20)
        turn = rotation(_taken(own.filter(part < SAMPLE / n).limit(2 * SAMPLE), d)[2])
        seeds = _taken(own.orderBy(F.col("length").desc(), "vec_id", "row").limit(SEED), d)
        queries = common.stage(_with_floors(own.filter(is_query), sc.broadcast((*seeds, turn)), k), "queries")
        blocks = -(-counts[d]["q"] // BLOCK)
        queries = queries.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "row"), F.lit(blocks)).cast("int"))
        pairs = _pairs(queries, own.groupBy("range").agg(F.max("length").alias("longest")))
        left = queries.join(common.broadcast_if_small(pairs, 16), "block").select("block", "range", "row", "x", "floor")
        right = own.join(common.broadcast_if_small(pairs, 16), "range").select("block", "range", "row", "vec_id", "x")
        found.append(left.groupBy("block", "range").cogroup(right.groupBy("block", "range")).applyInArrow(_search(sc.broadcast(turn), d, k), FOUND))
        asked.append(queries.select("row", F.col("vec_id").alias("query_id")))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    best = reduce(DataFrame.unionByName, found)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    best = best.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.join(reduce(DataFrame.unionByName, asked), "row").select("query_id", "rank", "vec_id", "score")
