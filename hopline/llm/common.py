"""Shared plumbing of the text operators: column mapping over Arrow, staging, size-checked joins."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.sources.staging import clear, drop, shared_dir, stage

__all__ = ["clear", "drop", "shared_dir", "stage"]

#: The word of every contract: a run of anything but the six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of text that one Python step handles at once; a longer text is a step of its own.
STEP_BYTES = 4 << 20
#: A side is broadcast only if its counted rows times its row bound stay below this.
BROADCAST_BYTES = 8 << 20

_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows that the Parquet reader and the way to Python hold at once, for rows that carry whole texts; Spark's own
#: defaults are meant for narrow rows, and a batch of them can take a large part of an executor.
BATCH_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "256"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024")}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes for tables of texts where they are at Spark's defaults; a size set by hand stays."""
    for key, (default, own) in BATCH_ROWS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, own)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def broadcast_if_small(staged: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast when the counted rows prove the size; otherwise leave the join to shuffle."""
    limit = BROADCAST_BYTES // row_bytes
    return F.broadcast(staged) if staged.limit(limit + 1).count() <= limit else staged


#: Bits of a bitmap of hashed keys: a row for each 64 of them that holds one, so 8 MB at most.
BITMAP_BITS = 32 << 20


def bitmap(keys: DataFrame, *columns: Column) -> DataFrame:
    """A broadcast-sized set of hashed keys, for ``maybe_in``; the more keys, the more others it takes for one."""
    at = F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS))
    bits = keys.select(at.alias("at")).groupBy(F.expr("at div 64").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("__bits"))
    return stage(bits, "bitmap")


def maybe_in(df: DataFrame, bits: DataFrame, *columns: Column, out: str = "__maybe") -> DataFrame:
    """Add ``out``: false only if the key of these columns is surely not in the bitmap.  Nothing is shuffled."""
    df = df.withColumn("__at", F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS)))
    df = df.withColumn("__w", F.expr("__at div 64")).join(F.broadcast(bits), F.col("__w") == F.col("__word"), "left")
    hit = F.col("__bits").bitwiseAND(F.expr("shiftleft(1L, cast(__at % 64 as int))")) != 0
    return df.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__at", "__w", "__word", "__bits")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns whose names clash (in any case) with what an operator adds."""
    clash = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


def steps(batch: pa.RecordBatch, columns: Sequence[int], limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of one step stay near ``limit`` bytes."""
    sizes = [pc.fill_null(pc.binary_length(batch.column(i)), 0).to_pylist() for i in columns if pa.types.is_string(batch.column(i).type) or pa.types.is_binary(batch.column(i).type)]
    start = held = 0
    for row in range(batch.num_rows):
        size = sum(s[row] for s in sizes)
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size + 64
    if start < batch.num_rows:
        yield batch.slice(start)


def map_columns(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: T.StructType,
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    keep: Sequence[str] | None = None,
    limit: int = STEP_BYTES,
) -> DataFrame:
    """Add ``outputs`` computed in Python from ``inputs``, a step of rows at a time over Arrow.

    ``make()`` runs once per task and returns the function from input arrays
    to output arrays.  All other columns pass through (or only ``keep``); an
    input column whose name clashes with an output is replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    spark.sparkContext.environment.setdefault("PYTHONPATH", _PACKAGE_ROOT)
    names = [f.name for f in outputs.fields]
    clash = {n.lower() for n in names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in clash]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([df.schema[c] for c in kept] + list(outputs.fields))
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in steps(batch, range(n, batch.num_columns), limit):
                made = work(*part.columns[n:])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=kept + names)
                del part, made
            pa.default_memory_pool().release_unused()  # what a step held is not kept for the next

    return source.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Whole texts, null as empty."""
    return [x or "" for x in column.to_pylist()]


def blobs(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8 bytes, null as empty.  ``bytes.split()`` cuts at exactly the six blanks."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def held(doc_id: Column, parts: int, out: int) -> Column:
    """Whether a document is held out: crc32 of its id as text leaves the remainder ``out``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == out, F.lit(False))
