"""Quality rules with host verdicts.

``measure`` takes the statistics of each text, ``RULES`` names what it fails,
and ``host_verdicts`` aggregates failures by host and shrinks each host's
failure rate of each rule with a beta prior fitted to all hosts by the method
of moments, sampling variance taken off.  ``judge`` joins the verdicts back to
the documents, on two levels: where a rule's shrunk rate passes ``MAX_RATE``
the whole host is rejected; where it reaches ``STRICT_RATE`` the rule counts
at this host, so that its documents that fail it are rejected.  (Where a rule
hardly ever fails, a failure says more of the text's form, say of a table in
it, than of its quality.)

Edge cases: a null or empty text has no words and fails; a null host has no
verdict, so only the text counts; repeated rows are judged alike and each
counts for its host; an empty table gives an empty table; input columns named
like an added one are replaced.  Texts of any length are measured whole.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.llm import common

BLANKS = common.BLANKS.encode()
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Each rule as SQL over the measures; true means that the document fails it.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}
#: A document that fails one of these is rejected whatever its host.
BASE_RULES = ("few_words", "repeated_words")
#: A host is rejected if its shrunk failure rate of any rule passes this.
MAX_RATE = 0.5
#: A rule counts at a host whose shrunk failure rate of it reaches this.
STRICT_RATE = 0.05
#: The prior weighs at least and at most so many documents.
PRIOR_WEIGHT = (1.0, 1000.0)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    inside = bytearray(len(words))
    for at, window in enumerate(windows):
        if times[window] > 1:
            inside[at : at + 3] = b"\1\1\1"
    return sum(inside)


def lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier line."""
    own = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    return len(own), len(own) - len(set(own))


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the measures (long) of each whole text."""

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            points = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            rows = []
            for raw, n in zip(common.blobs(column), points):
                words = raw.split()
                blank = len(raw) - len(raw.translate(None, BLANKS))
                symbols = len(raw) - len(raw.translate(None, SYMBOLS))
                rows.append((len(words), n - blank, symbols, *lines(raw), repeat_words(words)))
            return [pa.array(x, type=pa.int64()) for x in (zip(*rows) if rows else [[]] * len(MEASURES))]

        return work

    return common.map_columns(docs, [text], T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]), make, keep)


def prior_weight(n: int, hosts: int, squares: float, failures: int, spread: float) -> tuple[float, float]:
    """(mean, weight) of the beta prior of a rule's failure rate.

    ``n`` documents, ``squares`` the sum of the hosts' squared sizes, and
    ``spread`` the sum of failures squared over size.  Rates of hosts with one
    common chance would spread by m(1-m) for each host but one; what they
    spread beyond that, in parts of what wholly different hosts would, is the
    correlation rho within hosts, and the weight is 1/rho - 1.
    """
    low, high = PRIOR_WEIGHT
    mean = failures / n if n else 0.0
    alike = mean * (1 - mean)
    room = n - squares / n - (hosts - 1) if n else 0.0
    if alike <= 0 or room <= 0:
        return mean, high
    rho = ((spread - failures * mean) / alike - (hosts - 1)) / room
    return mean, min(high, max(low, 1 / rho - 1)) if rho > 1e-9 else high


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = MAX_RATE, strict_rate: float = STRICT_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and strictness of each rule, and whether it is rejected.

    The shrunk rate is (failures + mean * weight) / (documents + weight).
    Counts are summed as integers before any division, map side first; the
    pooled sums are one row.
    """
    counted = (
        measured.filter(F.col(f"`{host}`").isNotNull())
        .groupBy(F.col(f"`{host}`").alias("host"))
        .agg(F.count("*").alias("n"), *[F.sum(F.expr(rule).cast("long")).alias(f"f_{name}") for name, rule in RULES.items()])
    )
    counted = common.stage(counted, "hosts")
    pooled = counted.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("hosts"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        *chain.from_iterable((F.sum(f"f_{r}").alias(f"f_{r}"), F.sum(F.col(f"f_{r}").cast("double") * F.col(f"f_{r}") / F.col("n")).alias(f"sq_{r}")) for r in RULES),
    ).first()
    rates = []
    for r in RULES:
        mean, weight = prior_weight(pooled["n"] or 0, pooled["hosts"], pooled["squares"] or 0.0, pooled[f"f_{r}"] or 0, pooled[f"sq_{r}"] or 0.0)
        rates.append(((F.col(f"f_{r}") + mean * weight) / (F.col("n") + weight)).alias(f"rate_{r}"))
    out = counted.select("host", "n", *[f"f_{r}" for r in RULES], *rates)
    out = out.withColumns({f"strict_{r}": F.col(f"rate_{r}") >= strict_rate for r in RULES})
    return out.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > max_rate)


def base_failed():
    return F.expr(" OR ".join(f"({RULES[r]})" for r in BASE_RULES))


def strictly_failed():
    """Whether a document fails a rule that counts at its host."""
    return reduce(Column.__or__, [F.expr(rule) & F.coalesce(f"strict_{r}", F.lit(False)) for r, rule in RULES.items()])


VERDICT = ["host_rejected", *[f"strict_{r}" for r in RULES]]


def judge(measured: DataFrame, host: str = "source", max_rate: float = MAX_RATE, strict_rate: float = STRICT_RATE) -> DataFrame:
    """Add ``base_failed``, ``host_rate`` (the worst rule's shrunk rate), ``host_rejected``, ``rule_failed`` and ``kept``.

    Join sides: one small row per measured document and one row per host; the
    hosts are broadcast only when their counted number proves the size, and
    else the join shuffles measures, whose hot keys adaptive execution splits.
    """
    measured = common.without(measured, ["base_failed", "host_rate", "rule_failed", "kept", *VERDICT])
    rate = F.greatest(*[F.col(f"rate_{r}") for r in RULES]).alias("host_rate")
    verdicts = common.stage(host_verdicts(measured, host, max_rate, strict_rate).select(F.col("host").alias("__host"), rate, *VERDICT), "verdicts")
    joined = measured.join(common.broadcast_if_small(verdicts, 256), F.col(f"`{host}`") == F.col("__host"), "left").drop("__host")
    joined = joined.withColumns({"base_failed": base_failed(), "host_rejected": F.coalesce("host_rejected", F.lit(False)), "rule_failed": strictly_failed()})
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected") & ~F.col("rule_failed")).drop(*VERDICT[1:])


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Measures are small and staged for the verdicts; the texts are then read
    once more and filtered where they lie, so no text is shuffled unless the
    hosts with a verdict are too many to broadcast.
    """
    columns = docs.columns
    verdicts = host_verdicts(measure(docs.select(text, host), text, [host]), host)
    some = reduce(Column.__or__, [F.col(v) for v in VERDICT])
    verdicts = common.stage(verdicts.filter(some).select(F.col("host").alias("__host"), *VERDICT), "verdicts")
    # struct: the documents' own columns stay untouched by added names
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(f"`{text}`").alias("__text"), F.col(f"`{host}`").alias("__h"))
    good = measure(packed, "__text", ["__row", "__h"]).filter(~base_failed())
    good = good.join(common.broadcast_if_small(verdicts, 128), F.col("__h") == F.col("__host"), "left")
    return good.filter(~F.coalesce("host_rejected", F.lit(False)) & ~strictly_failed()).select("__row.*")
