"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.llm import (
    byte_bpe,
    common,
    crf_language,
    exact_topk,
    factor_machine,
    mixing,
    quality_rules,
    secret_scan,
    sentence_spans,
    simhash,
    token_counts,
)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and its verdict by text and by host (its source)."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    measured = common.stage(quality_rules.measure(docs, keep=["doc_id", "source"]), "measures")
    out = quality_rules.judge(measured)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source",
        F.round("host_rate", 6).alias("host_rate"), "host_rejected", "rule_failed",
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, a digest of the patterns' spans, and all spans."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs).drop("text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        n("novel").alias("n_novel"),
    )


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that a non-first repeated span covers."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    done = sentence_spans.dedup(docs)
    return done.select("doc_id", "n_sentences", "n_removed", "words_removed", F.col("clean_text").alias("text"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by merge replay, decoded again; digests of both."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_bpe(docs)


def digest_bpe(docs: DataFrame) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded").drop("text")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labelled rows that are not held out."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = factor_machine.train(docs, common.read(spark, sf_dir, "labels").select("doc_id", "quality"), ~common.held(F.col("doc_id"), 3, 1))
    held = common.held(F.col("doc_id"), 3, 1).alias("held_out")
    return factor_machine.score(docs, machine).select("doc_id", held, "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    prints = common.stage(simhash.fingerprints(docs).drop("text"), "docprints")
    return simhash.classes(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every hundredth vector with all others."""
    return exact_topk.topk(common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once per epoch of its source, no source repeated more than twice."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).drop("text")


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows that are not held out."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = crf_language.train(docs, ~common.held(F.col("doc_id"), 4, 2))
    held = common.held(F.col("doc_id"), 4, 2).alias("held_out")
    return crf_language.predict(docs.drop("lang"), model).select("doc_id", held, "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scan": op3_secret_scan,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_factor_machine": op6_factor_machine,
    "op7_simhash": op7_simhash,
    "op8_exact_topk": op8_exact_topk,
    "op9_mixing": op9_mixing,
    "op10_crf_language": op10_crf_language,
}


def digest_tokens(docs: DataFrame) -> DataFrame:
    """The last stage of the pipeline: ids and decoded bytes of each row, as digests."""
    return digest_bpe(docs.select("doc_id", "text"))
