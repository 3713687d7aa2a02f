"""Substring dedup by sliding sentence spans.

A text is cut into sentences.  Every run of consecutive sentences, the
shortest from each sentence on that has at least ``span`` sentences and
``min_words`` words, is hashed.  Equal runs meet in one global aggregation,
whose first member in the order of (id, position) stays; each sentence that a
non-first run covers is removed.

A sentence ends after ``.``, ``!`` or ``?`` and a blank, or at a line's end.
One of more than ``LONG`` words is cut further behind words whose CRC-32 is
divisible by ``CUT``, and after ``LONG`` words without one, so that what is
shared is cut alike and goes in pieces; but for the ``span`` of a run it stays
one sentence, so no run lies within a single one.

A passage that starts and ends within sentences may hold too few whole ones.
So each text also has anchored spans of ``GRAM`` words, wherever they lie: of
every ``PASSAGE`` words in a row those whose hash is the least (winnowing).
Equal passages of ``PASSAGE`` words have equal anchored spans, whatever stands
around them.  They meet like runs, and the words of one whose first is in
another document are removed (what a text repeats of itself outside of
sentences is not a passage).  Neighbouring ones are at most
``PASSAGE - GRAM + 1`` words apart, so they cover a longer repeated passage
but for fewer than that many words at either end.

Shuffles: 64-bit run and span hashes, once summed by hash with map-side combine and once
joined, from staged tables, to the hashes that occur twice or more (so
adaptive execution can split a hot hash); then the texts of documents of which
something goes, to meet what does.  A bitmap of hashed ids (``common.bitmap``),
broadcast, tells the other texts apart, which stay where they lie; with about
as many such documents as it has bits it lets all texts through, and they are
all shuffled.

Edge cases: null and empty texts have no sentences and stay as they are; rows
that repeat an id are one document, so their equal positions are not repeats
of each other; rows without an id are told apart by their text; ``n_removed``
counts a sentence of which some words are removed; empty tables give empty tables; input columns named like an added one are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.llm import common

SPAN, MIN_WORDS = 2, 24
LONG, CUT = 24, 8
#: Words of the passages that are always found, and of an anchored span.
PASSAGE, GRAM = 51, 28
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: On UTF-8 bytes; the six ASCII blanks.
BREAK = re.compile(rb"[.!?]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*")
WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def sentences(raw: bytes) -> list[tuple[int, int, int, bytes, bool]]:
    """(start, end, words, normal form, whether a sentence begins) of each piece; they cover the text but for leading blanks."""
    out, at = [], 0
    ends = [m.end() for m in BREAK.finditer(raw)]
    if not ends or ends[-1] < len(raw):
        ends.append(len(raw))
    for end in ends:
        words = raw[at:end].split()
        if len(words) > LONG:
            start, own, begins = at, [], True
            for m in WORD.finditer(raw, at, end):
                word = m[0].rstrip()
                own.append(word)
                if zlib.crc32(word) % CUT == 0 or len(own) == LONG:
                    out.append((start, m.end(), len(own), b" ".join(own), begins))
                    start, own, begins = m.end(), [], False
            if own:
                out.append((start, end, len(own), b" ".join(own), begins))
        elif words:
            out.append((at, end, len(words), b" ".join(words), True))
        at = end
    return out


def runs(found: list[tuple[int, int, int, bytes, bool]], span: int, min_words: int) -> list[int]:
    """For each piece the end (exclusive) of the run that begins there, where there is one.

    A run touches at least ``span`` sentences: the one it begins in, and those that begin in it.
    """
    out, end, words, begun = [], 0, 0, 0
    for start, (_, _, n, _, begins) in enumerate(found):
        # the first piece counts for its sentence, whether that begins with it or not
        while end < len(found) and (begun + (not begins) < span or words < min_words):
            words += found[end][2]
            begun += found[end][4]
            end += 1
        if begun + (not begins) < span or words < min_words:
            break
        out.append(end)
        words -= n
        begun -= begins
    return out


def hashes(raw: bytes, span: int, min_words: int) -> list[int]:
    """Signed 64-bit hash of the run that begins at each sentence."""
    found = sentences(raw)
    forms = [x[3] for x in found]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b"\n".join(forms[i:end])) for i, end in enumerate(runs(found, span, min_words))], dtype=np.uint64).view(np.int64).tolist()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, 1)
        return found


def _extreme(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, signed hash) of the anchored spans of all texts, in order."""
    known = _WordHashes()
    parts, sizes = [], []
    for raw in raws:
        words = raw.split()
        sizes.append(len(words))
        if len(words) >= PASSAGE:
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    sizes = np.array(sizes, dtype=np.int64)
    of = np.flatnonzero(sizes >= PASSAGE)
    if not len(of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, text = np.concatenate(parts), np.repeat(of, sizes[of])
    n = len(words)
    powers, inverse = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    powers, inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(words * powers)))
    grams = (sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        grams = (grams ^ (grams >> np.uint64(shift))) * np.uint64(factor)
    grams ^= grams >> np.uint64(31)
    width = PASSAGE - GRAM + 1
    least = _extreme(grams, width, np.minimum)
    least[text[: n - PASSAGE + 1] != text[PASSAGE - 1 :]] = 0  # of two texts
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero((_extreme(np.concatenate((edge, least, edge)), width, np.maximum) == grams) & (grams > 0))
    starts = np.zeros(len(sizes), np.int64)
    starts[of] = np.cumsum(sizes[of]) - sizes[of]
    return text[at], at - starts[text[at]], grams[at].view(np.int64)


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Add ``__id`` and, for rows without one, ``__h`` from the text."""
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumns({"__id": F.col(f"`{doc_id}`"), "__h": F.when(F.col(f"`{doc_id}`").isNull(), F.xxhash64(own)).otherwise(F.lit(0))})


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", span: int = SPAN, min_words: int = MIN_WORDS, anchored: bool = True) -> DataFrame:
    """(__id, __h, __at): for each document where a non-first repeated run or anchored span begins.

    That is twice the sentence of a run, and twice the first word of a span and one more.
    """
    held = T.ArrayType(T.StructType([T.StructField("p", T.LongType()), T.StructField("run", T.LongType())]))

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            raws = common.blobs(column)
            own = [hashes(x, span, min_words) for x in raws]
            sizes = np.array([len(x) for x in own], dtype=np.int64)
            text, at, gram = anchors(raws if anchored else [])
            rows = np.concatenate((np.repeat(np.arange(len(raws)), sizes), text))
            places = np.concatenate([*(np.arange(x) * 2 for x in sizes.tolist()), at * 2 + 1])
            order = np.argsort(rows, kind="stable")
            runs_and_spans = np.concatenate((np.array([x for y in own for x in y], dtype=np.int64), gram))
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(raws)))))
            both = pa.StructArray.from_arrays([pa.array(places[order]), pa.array(runs_and_spans[order])], names=["p", "run"])
            return [pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), both)]

        return work

    keyed = _keyed(docs.select(doc_id, text), text, doc_id).select("__id", "__h", F.col(f"`{text}`").alias("__t"))
    hashed = common.map_columns(keyed, ["__t"], T.StructType([T.StructField("__runs", held)]), make, ["__id", "__h"])
    hashed = common.stage(hashed, "runs")
    each = hashed.select("__id", "__h", F.inline("__runs").alias("__p", "__run"))
    place = F.struct(F.col("__id").isNull().alias("none"), "__id", "__h", "__p")
    twice = each.groupBy("__run").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("__run").alias("__r"), "first")
    twice = common.stage(twice, "twice")
    elsewhere = ~(F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("__h") == F.col("first.__h")))
    later = each.join(twice, F.col("__run") == F.col("__r")).filter(elsewhere | (F.col("__p") % 2 == 0) & (F.col("__p") != F.col("first.__p")))
    return later.groupBy("__id", "__h").agg(F.collect_set("__p").alias("__at"))


ADDED = T.StructType(
    [
        T.StructField("n_sentences", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("words_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("clean_text", T.StringType()),
    ]
)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", span: int = SPAN, min_words: int = MIN_WORDS, anchored: bool = True) -> DataFrame:
    """Add the counts, ``removed`` (byte ranges of the text) and ``clean_text``, the text without them; ``anchored=False`` for runs alone."""
    docs = common.without(docs, ADDED.names)
    marks = common.stage(repeated(docs, text, doc_id, span, min_words, anchored), "marks")
    keyed = _keyed(docs, text, doc_id)
    # documents of which nothing goes are told apart by a bitmap, and never shuffled
    keyed = common.maybe_in(keyed, common.bitmap(marks, F.col("__id"), F.col("__h")), F.col("__id"), F.col("__h"))
    marks = marks.withColumnsRenamed({"__id": "__id2", "__h": "__h2"})
    some = keyed.filter("__maybe").join(marks, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__h") == F.col("__h2")), "left")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    none = keyed.filter("NOT __maybe").select(*kept, F.lit(None).cast("array<bigint>").alias("__at"))
    joined = none.unionByName(some.select(*kept, "__at"))
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def work(column: pa.Array, starts: pa.Array) -> list[pa.Array]:
            rows = []
            for whole, raw, marked in zip(column.to_pylist(), common.blobs(column), starts.to_pylist()):
                found = sentences(raw)
                if not marked:
                    rows.append((len(found), 0, 0, [], whole))
                    continue
                ends, gone = runs(found, span, min_words), bytearray(len(found))
                for at in (x // 2 for x in marked if x % 2 == 0):
                    if at < len(ends):  # of rows that repeat an id, marks of another text may lie outside
                        gone[at : ends[at]] = b"\1" * (ends[at] - at)
                pieces = [(start, end) for (start, end, *_), away in zip(found, gone) if away]
                words = sum(x[2] for x, away in zip(found, gone) if away)
                removed = sum(gone)
                if grams := [x // 2 for x in marked if x % 2]:
                    spots = [m.span() for m in WORD.finditer(raw)]
                    lost = bytearray(len(spots))
                    for at in grams:
                        if at + GRAM <= len(spots):
                            lost[at : at + GRAM] = b"\1" * GRAM
                            pieces.append((spots[at][0], spots[at + GRAM - 1][1]))
                    first = 0
                    for (_, _, n, *_), away in zip(found, gone):
                        own = sum(lost[first : first + n])
                        first += n
                        if own and not away:
                            removed, words = removed + 1, words + own
                cuts: list[list[int]] = []
                for start, end in sorted(pieces):
                    if cuts and cuts[-1][1] >= start:
                        cuts[-1][1] = max(cuts[-1][1], end)
                    else:
                        cuts.append([start, end])
                edges = [0, *[x for cut in cuts for x in cut], len(raw)]
                clean = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
                rows.append((len(found), removed, words, [{"start": a, "end": b} for a, b in cuts], clean))
            n, removed, words, spans, clean = zip(*rows) if rows else ([],) * 5
            return [*(pa.array(x, type=pa.int64()) for x in (n, removed, words)), pa.array(spans, type=ranges), pa.array(clean, type=pa.string())]

        return work

    return common.map_columns(joined, [text, "__at"], ADDED, make, docs.columns)
