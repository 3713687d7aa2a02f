"""Rank scores over the rows of a match: BM25 and reciprocal rank fusion."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopline.functions.text import count as token_count
from hopline.functions.text import times, tokens_of

#: Fixed values of the formula.
K1, B, RRF_K = 1.2, 0.75, 60


@dataclass(frozen=True)
class Statistics:
    """One row of sums over a corpus, for any number of queries on one field."""

    row: DataFrame
    mean: str
    n: str
    held: dict[str, str]  # column of each term


def statistics(rows: DataFrame, field: Column, terms: list[str], label: str, stored: Column | None = None) -> Statistics:
    """The texts that are not null, their mean length, and how many hold each term: one aggregation to one row."""
    held = {t: f"__df{label}_{i}" for i, t in enumerate(terms)}
    mean, n = f"__mean{label}", f"__n{label}"
    low = None
    if stored is None:  # one lower-case text for all terms
        rows, low = rows.select(field.alias("__text"), F.lower(field).alias("__low")), F.col("__low")
        field = F.col("__text")
    row = rows.agg(
        F.count(field if stored is None else stored).alias(n),
        F.avg(token_count(field, stored)).alias(mean),
        *[F.count(F.when(times(field, t, stored, low) > 0, 1)).alias(c) for t, c in held.items()],
    )
    return Statistics(row, mean, n, held)


def bm25(
    df: DataFrame, field: Column, queries: dict[str, str], corpus: tuple[DataFrame, Column, Column | None] | None = None, label: str = "", stored: Column | None = None
) -> DataFrame:
    """Add for each name of ``queries`` the BM25 score of ``field`` among the rows of ``df`` (or of ``corpus``).

    The statistics of all queries are one aggregation, which is joined back by
    broadcast; no tokens are exploded or shuffled.  A row's length is counted
    only where one of the terms stands.
    """
    asked = {out: sorted(Counter(tokens_of(query or "")).items()) for out, query in queries.items()}
    terms = sorted({t for own in asked.values() for t, _ in own})
    if not terms:
        return df.withColumns({out: F.lit(0.0) for out in queries})
    rows, text, tokens = corpus or (df, field, stored)
    stats = statistics(rows, text, terms, label, tokens)
    low = None if stored is not None else F.col(f"__low{label}")
    own = df if low is None else df.withColumn(f"__low{label}", F.lower(field))
    own = own.withColumns({f"__tf{label}_{i}": times(field, t, stored, low).cast("double") for i, t in enumerate(terms)})
    tf = {t: F.col(f"__tf{label}_{i}") for i, t in enumerate(terms)}
    some = reduce(Column.__or__, [c > 0 for c in tf.values()])
    joined = own.withColumn(f"__size{label}", F.when(some, token_count(field, stored))).join(F.broadcast(stats.row))
    mean = F.col(stats.mean)
    norm = F.when(mean > 0, K1 * (1 - B + B * F.col(f"__size{label}") / mean)).otherwise(F.lit(K1))
    scores = {}
    for out, pairs in asked.items():
        score = F.lit(0.0)
        for term, repeats in pairs:
            n, held = F.col(stats.n), F.col(stats.held[term])
            idf = F.log(1 + (n - held + 0.5) / (held + 0.5))
            score = score + F.when(tf[term] > 0, idf * (tf[term] * (K1 + 1) / (tf[term] + norm)) * repeats).otherwise(0.0)
        scores[out] = F.coalesce(score, F.lit(0.0))
    return joined.withColumns(scores).drop(f"__low{label}", f"__size{label}", stats.n, stats.mean, *stats.held.values(), *[f"__tf{label}_{i}" for i in range(len(terms))])


#: Steps of a score that share a bucket, and node ids that share a slice, when positions are counted in parts.
STEPS, SLICE, FAR = 4096, 65_536, 2.0**20


def positions(df: DataFrame, score: str, down: bool, ties: list[str], out: str) -> DataFrame:
    """Add ``out``: the position of each row by ``score`` and then ``ties``, counted in parts.

    It is the rows of better buckets, plus those of better scores in the row's
    bucket, plus those of earlier id slices at the row's score, plus the place
    within the slice.  Each part is a small aggregation, and no window holds
    more than one bucket's scores or one slice's rows, so many equal scores
    (documents without any term) don't meet in one task.  ``df`` is evaluated
    for each part.
    """
    sign = -1 if down else 1
    own = F.greatest(F.least(F.col(score) * sign, F.lit(FAR)), F.lit(-FAR))
    rows = df.withColumns({"__s": F.col(score) * sign, "__b": F.floor(own * STEPS), "__i": F.floor(F.col(f"`{ties[0]}`") / SLICE)})
    slices = rows.groupBy("__b", "__s", "__i").agg(F.count("*").alias("__n"))

    def ahead(partition: list[str], order: str) -> Column:
        """The rows before, among what stands in the same partition."""
        w = Window.partitionBy(*partition) if partition else Window.partitionBy()
        return F.coalesce(F.sum("__n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    scores = slices.groupBy("__b", "__s").agg(F.sum("__n").alias("__n"))
    buckets = scores.groupBy("__b").agg(F.sum("__n").alias("__n")).select("__b", ahead([], "__b").alias("__p1"))
    scores = scores.select("__b", "__s", ahead(["__b"], "__s").alias("__p2"))
    slices = slices.select("__b", "__s", "__i", ahead(["__b", "__s"], "__i").alias("__p3"))
    before = slices.join(scores, ["__b", "__s"]).join(buckets, "__b").select("__b", "__s", "__i", (F.col("__p1") + F.col("__p2") + F.col("__p3")).alias("__p"))
    place = F.row_number().over(Window.partitionBy("__b", "__s", "__i").orderBy(*[f"`{t}`" for t in ties]))
    placed = rows.withColumn("__at", place).join(before, ["__b", "__s", "__i"], "left")
    return placed.withColumn(out, F.col("__p") + F.col("__at")).drop("__b", "__s", "__i", "__p", "__at")


#: Rows that Catalyst expects to be smaller than this are numbered in one sequence, others in parts.
ONE_SEQUENCE_BYTES = 64 << 20


def in_parts(df: DataFrame, columns: list[str]) -> bool:
    """Whether the optimiser expects more rows than one task should sort; it guesses high, never by running anything.

    To be asked of the matched rows, before one-row statistics are joined,
    which it takes for a product.
    """
    plan = df.select(*[f"`{c}`" for c in columns])._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes())) > ONE_SEQUENCE_BYTES


def rrf(df: DataFrame, ranks: list[tuple[str, bool]], ties: list[str], k: int, out: str, parts: bool = False) -> DataFrame:
    """Add ``out``: the sum of 1 / (k + position) over the score columns ``ranks`` (name, descending).

    A position is that among all rows, equal scores in the order of the
    columns ``ties``.  With ``parts`` it is counted in parts (see
    ``positions``), without it is a row number over one sorted sequence; see
    ``in_parts`` for which to choose.
    """
    if k <= 0:
        raise ValueError("rrf() needs a k above 0")
    total = F.lit(0.0)
    for i, (name, down) in enumerate(ranks):
        sure = F.when(F.col(name).isNull(), F.raise_error(F.lit("rrf(): a rank score is null")).cast("double")).otherwise(F.col(name))
        df = df.withColumn(name, sure)
        if parts:
            df = positions(df, name, down, ties, f"__rank{i}")
        else:
            order = F.desc_nulls_last(name) if down else F.asc_nulls_last(name)
            df = df.withColumn(f"__rank{i}", F.row_number().over(Window.orderBy(order, *[f"`{t}`" for t in ties])))
        total = total + 1.0 / (k + F.col(f"__rank{i}"))
    return df.withColumn(out, total).drop(*[f"__rank{i}" for i in range(len(ranks))])
