"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document is the logistic function of
``w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``, that
is, all pairwise interactions in time linear in its features.  Features are
its distinct words hashed to ``WORDS`` places (each 1/sqrt of their number),
standardised structure statistics of the text, and the length bucket as
metadata.

Training takes a bounded sample of labelled documents (``SAMPLE`` ids by the
order of a hash, their texts whole whatever their length), extracts features
on the executors and fits on the driver with full-batch Adam; scoring takes
every document, whole.

Edge cases: null and empty texts have no words and are scored by the rest;
labels other than 0 and 1 and null ids are left out, an id with two labels
takes the lower; without both labels in the sample the score is the share of
label 1 (one half without labels); repeated rows score alike; empty tables
give empty tables; input columns named like an added one are replaced.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.llm import common

WORDS = 1 << 15
FACTORS = 6
#: Labelled documents that train at most.
SAMPLE = 4000
STEPS, RATE, DECAY = 60, 0.05, 1e-4
BUCKETS = 16
BLANKS = common.BLANKS.encode()
SYMBOLS, DIGITS = b"#*$%&|<>@_=+~^{}[]\\", b"0123456789"
STOPS, UPPER = b".!?", bytes(range(65, 91))
STATS = 12


def _share(raw: bytes, members: bytes, size: int) -> float:
    return (len(raw) - len(raw.translate(None, members))) / size


def statistics(raw: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Structure of a text, as ratios and logarithms."""
    size, n = max(1, len(raw)), max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    m = max(1, len(lines))
    return [
        math.log1p(len(words)),
        math.log1p(len(lines)),
        _share(raw, SYMBOLS, size),
        _share(raw, DIGITS, size),
        _share(raw, UPPER, size),
        _share(raw, STOPS, size),
        _share(raw, b"!", size),
        _share(raw, b",;:", size),
        (len(raw) - n) / n / 10,
        distinct / n,
        (len(lines) - len(set(lines))) / m,
        sum(1 for x in lines if x.rstrip(BLANKS)[-1:] in b".!?\"'") / m,
    ]


def features(raw: bytes) -> tuple[list[int], list[float], int]:
    """(places of the distinct words, statistics, length bucket) of one text."""
    words = raw.split()
    own = set(words)
    return [x & (WORDS - 1) for x in map(zlib.crc32, own)], statistics(raw, words, len(own)), min(BUCKETS - 1, len(raw).bit_length())


@dataclass
class Machine:
    """Weights: hashed words first, then statistics, then length buckets."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, rows: list[tuple[list[int], list[float], int]]) -> np.ndarray:
        x = Sparse(rows, self.mean, self.scale)
        return 1 / (1 + np.exp(-np.clip(x.margin(self)[0], -30, 30)))


class Sparse:
    """Rows of features in CSR form."""

    def __init__(self, rows: list[tuple[list[int], list[float], int]], mean: np.ndarray, scale: np.ndarray):
        sizes = np.array([len(r[0]) for r in rows]) + STATS + 1
        self.n, self.starts = len(rows), np.concatenate(([0], np.cumsum(sizes)))[:-1]
        total = int(sizes.sum())
        self.places, self.values = np.empty(total, np.int64), np.empty(total, np.float32)
        for at, (words, stats, bucket) in zip(self.starts.tolist(), rows):
            end = at + len(words)
            self.places[at:end], self.values[at:end] = words, 1 / math.sqrt(max(1, len(words)))
            self.places[end : end + STATS], self.values[end : end + STATS] = range(WORDS, WORDS + STATS), np.clip((np.array(stats) - mean) / scale, -4, 4) / math.sqrt(STATS)
            self.places[end + STATS], self.values[end + STATS] = WORDS + STATS + bucket, 0.5
        self.row = np.repeat(np.arange(self.n), sizes)

    def margin(self, m: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margin, sum of v x per row and factor, v x per feature); the pairwise part by the sum of squares."""
        vx = m.v[self.places] * self.values[:, None]
        sums = np.add.reduceat(vx, self.starts, axis=0)
        squares = np.add.reduceat(vx * vx, self.starts, axis=0)
        linear = np.add.reduceat(m.w[self.places] * self.values, self.starts)
        return m.bias + linear + 0.5 * (sums * sums - squares).sum(1), sums, vx


def fit(rows: list[tuple[list[int], list[float], int]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Full-batch Adam on the logistic loss, the rarer label weighted up to parity by half."""
    size = WORDS + STATS + BUCKETS
    stats = np.array([r[1] for r in rows]) if rows else np.zeros((0, STATS))
    mean, scale = (stats.mean(0), stats.std(0) + 1e-6) if rows else (np.zeros(STATS), np.ones(STATS))
    share = float(labels.mean()) if len(labels) else 0.5
    m = Machine(0.0, np.zeros(size), np.zeros((size, FACTORS)), mean, scale)
    if share in (0.0, 1.0) or not rows:
        share = min(max(share, 1e-6), 1 - 1e-6)
        m.bias = math.log(share / (1 - share))
        return m
    random = np.random.default_rng(seed)
    x = Sparse(rows, mean, scale)
    used, x.places = np.unique(x.places, return_inverse=True)  # train only the places that occur
    m.w, m.v = np.zeros(len(used), np.float32), random.normal(0, 0.05, (len(used), FACTORS)).astype(np.float32)
    m.bias = math.log(share / (1 - share))
    weight = np.where(labels == 1, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)
    weight /= weight.sum()
    by_place = np.argsort(x.places, kind="stable")
    cuts = np.searchsorted(x.places[by_place], np.arange(len(used)))
    first, second = [np.zeros(1), np.zeros_like(m.w), np.zeros_like(m.v)], [np.zeros(1), np.zeros_like(m.w), np.zeros_like(m.v)]
    for step in range(1, STEPS + 1):
        margin, sums, vx = x.margin(m)
        slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) * weight).astype(np.float32)
        own = (slope[x.row] * x.values)[by_place]
        grad_w = np.add.reduceat(own, cuts) + DECAY * m.w
        grad_v = np.add.reduceat(own[:, None] * (sums[x.row] - vx)[by_place], cuts, axis=0) + DECAY * m.v
        moved = []
        for i, (now, grad) in enumerate(((np.array([m.bias]), np.array([slope.sum()])), (m.w, grad_w), (m.v, grad_v))):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad * grad
            moved.append(now - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8))
        m.bias, m.w, m.v = float(moved[0][0]), moved[1], moved[2]
    w, v = np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32)
    w[used], v[used] = m.w, m.v
    return Machine(m.bias, w, v, mean, scale)


def train(docs: DataFrame, labels: DataFrame, use: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled ids for which ``use`` (over ``doc_id`` of ``labels``) holds.

    Only ids and labels are ranked for the sample; it has a proven bound, so
    it is broadcast to the documents, and only features come to the driver.
    """
    fine = labels.filter(use & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    chosen = fine.groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).cast("int").alias("__label"))
    chosen = common.stage(chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample), "labelled")
    rows = docs.select(F.col(f"`{doc_id}`").alias("__d"), F.col(f"`{text}`").alias("__t")).join(F.broadcast(chosen), F.col("__d") == F.col("__id"))

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            words, stats, buckets = zip(*map(features, common.blobs(column))) if len(column) else ((), (), ())
            return [pa.array(words, type=pa.list_(pa.int32())), pa.array(stats, type=pa.list_(pa.float64())), pa.array(buckets, type=pa.int32())]

        return work

    fields = T.StructType([T.StructField("w", T.ArrayType(T.IntegerType())), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("b", T.IntegerType())])
    made = common.map_columns(rows, ["__t"], fields, make, ["__d", "__label"])
    # an id with many rows gives one
    made = made.groupBy("__d").agg(F.min(F.struct("w", "s", "b", "__label")).alias("r")).select("__d", "r.*")
    taken = made.toArrow().sort_by("__d").to_pydict()
    return fit(list(zip(taken["w"], taken["s"], taken["b"])), np.array(taken["__label"], dtype=float))


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from one half on) of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # WORDS * (FACTORS + 1) numbers, whatever the input

    def make():
        own = sent.value

        def work(column: pa.Array) -> list[pa.Array]:
            made = own.scores([features(x) for x in common.blobs(column)]) if len(column) else np.zeros(0)
            return [pa.array(made, type=pa.float64()), pa.array((made >= 0.5).astype(np.int32))]

        return work

    return common.map_columns(docs, [text], T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]), make)
