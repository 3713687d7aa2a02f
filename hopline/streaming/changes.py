"""The change log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.session import GraphSession
from hopline.sources.store import CHANGES


def tail(session: GraphSession, after: int = 0, files_per_trigger: int = 64) -> DataFrame:
    """A streaming DataFrame of change rows of the versions after ``after``, as they are committed.

    Each commit adds one folder of change rows, which the file source finds;
    folders never change, so a checkpointed query sees each row once.
    """
    spark = session.spark
    rows = (
        spark.readStream.schema(T._parse_datatype_string(CHANGES))
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{session.store.path}/changes")
    )
    return rows.filter(F.col("graph_version") > after)


def counts(changes: DataFrame) -> DataFrame:
    """Running number of changes by version, type and kind; batch or stream."""
    return changes.groupBy("graph_version", "type_name", "change_kind").agg(F.count("*").alias("n"))
