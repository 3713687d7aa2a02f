"""Small tables that hold every awkward case."""

import pyarrow as pa
import pyarrow.parquet as pq

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

PROSE = "The quick brown fox jumps over the lazy dog near the river bank. It was a bright cold day in April and the clocks were striking. " * 3
AWKWARD = [
    (1, PROSE, "en", "a", 10),
    (2, PROSE, "en", "a", 10),  # an exact copy
    (2, PROSE, "en", "a", 10),  # a repeated row
    (3, None, "en", "a", 10),
    (4, "", None, "b", None),
    (5, " \t\n\x0b\x0c\r ", "de", None, 3),
    (None, "Ein kurzer Text über Größe, 💩 und mehr. Noch ein Satz steht hier für sich allein und endet bald.", "de", "b", 5),
    (None, None, None, None, None),
    (6, "x" * 200_000, "en", "a", 200_000),
    (7, "word " * 50_000, "en", "a", 250_000),
    (8, "    a\x1cb \x85 ﬁ İ ſ K 1²3 \U0001f600", "fr", "c", 4),
    (9, PROSE.replace("lazy", "sleepy"), "en", "c", 4),
]


def docs(spark, rows=AWKWARD, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(df, *names):
    """The table with extra columns that are named like what the operator adds."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df.withColumn("extra", F.lit(1))


def write(spark, path, rows=AWKWARD, schema=SCHEMA, table="documents"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")


def read_table(path, table):
    return pq.read_table(f"{path}/{table}.parquet")


__all__ = ["pa"]
