"""The corpus pipeline: documents to token ids, five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopline.llm import common, mixing, quality_rules, secret_scan, simhash
from hopline.llm.queries import digest_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no base rule and none that counts at their host, from hosts that are not rejected."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that of the smallest id."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts blanked out."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources in further epochs up to their weight."""
    columns = docs.columns
    return mixing.mix(docs).select(*[f"`{c}`" for c in columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row and their decoding, as digests."""
    return digest_tokens(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources", mixture),
    ("byte-level BPE", tokens),
]

#: SimHash groups, zstandard novelty and merge replay have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        before, docs = docs, common.stage(function(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        common.drop(before)  # nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)
