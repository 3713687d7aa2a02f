"""Language identification of code-switched text by a linear-chain CRF.

Each word (run of letters) of a text is a position, each language a label.
A word's scores are the sum of learned weights of its features: byte n-grams
of the lower-cased word between boundary marks (those that touch a mark are
its affixes), each hashed to ``PLACES``, and the word itself (the lexicon),
hashed apart.  Learned transitions link neighbouring labels.  Forward and
backward passes give every word's posterior; a text's language is the one
with the greatest posterior summed over its words, its score the mean.

Training takes a bounded sample: at most ``SAMPLE_DOCS`` texts of each of the
``LANGUAGES`` most frequent languages, by the order of a hash.  Texts of any
length may be drawn; on the executors each is cut into pieces of
``PIECE_WORDS`` words, of which at most ``TEXT_PIECES`` from all over the text
and ``PIECES`` a language come to the driver.  These are shuffled into
code-switched chains with word labels.  Scoring takes every text whole: the chains of a step
are laid side by side, longest first, and each pass goes over positions for
all chains at once.

Edge cases: null texts and texts without letters get ``und`` and score 0;
null languages are not learned from, nor are those beyond the ``LANGUAGES``
most frequent (ties by name), which bounds the model whatever a dirty column
holds; with no language to learn every text is ``und``; repeated rows score alike; empty tables give empty tables; input
columns named like an added one are replaced; ties go to the language that
sorts first.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hopline.llm import common
from hopline.llm.byte_bpe import WordIds

PLACES = 1 << 16
LEXICON = 1 << 16
SIZES = (2, 3, 4)
#: Bounds of the training sample: languages, texts a language, pieces a text, pieces a language, words a piece.
LANGUAGES, SAMPLE_DOCS, TEXT_PIECES, PIECES, PIECE_WORDS = 64, 150, 40, 400, 30
STEPS, RATE, DECAY = 30, 0.2, 1e-3
#: Bytes of text whose chains are laid side by side.
STEP_BYTES = 6 << 20
LETTERS = regex.compile(r"\p{L}+")


def word_features(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places of all words' features one after the other, first place of each word)."""
    raw = [b"\x01" + w.encode() + b"\x02" for w in words]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))  # bytes up to the word's end
    owner = np.repeat(np.arange(len(raw)), sizes)
    places, owners = [], []
    code = data.copy()
    for n in range(2, max(SIZES) + 1):
        code = code[: len(data) - n + 1] * np.uint64(256) + data[n - 1 :]
        if n in SIZES:
            inside = left[: len(code)] >= n
            mixed = (code[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            places.append((mixed >> np.uint64(48)).astype(np.int64) % PLACES)
            owners.append(owner[: len(code)][inside])
    places.append(np.fromiter((PLACES + zlib.crc32(w) % LEXICON for w in raw), dtype=np.int64, count=len(raw)))
    owners.append(np.arange(len(raw)))
    places, owners = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return places[order], np.searchsorted(owners[order], np.arange(len(raw)))


class Chains:
    """Chains of word numbers side by side, longest first, position by position."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.n = len(lengths)
        self.order = np.argsort(-lengths, kind="stable")
        rank = np.empty(self.n, np.int64)
        rank[self.order] = np.arange(self.n)
        self.live = np.bincount(lengths, minlength=1)[::-1].cumsum()[::-1][1:]  # chains that have position t
        self.at = np.concatenate(([0], np.cumsum(self.live))).astype(np.int64)
        place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.slot = self.at[place] + np.repeat(rank, lengths)
        self.words = np.empty(len(words), np.int64)
        self.words[self.slot] = words

    def passes(self, scores: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False):
        """(posteriors by slot, log partition, expected transitions if ``pairs``) from word scores by slot."""
        labels = scores.shape[1]
        top = scores.max(1, keepdims=True) if len(scores) else scores
        force, steps = np.exp(scores - top), np.exp(moves)
        forward = np.empty_like(force)
        total = float(top.sum())
        live, at = self.live.tolist(), self.at.tolist()
        now = None
        for t, c in enumerate(live):
            own = force[at[t] : at[t] + c]
            now = own * np.exp(start) if t == 0 else own * (now[:c] @ steps)
            norm = now.sum(1, keepdims=True)
            now = now / norm
            if pairs:
                total += float(np.log(norm).sum())
            forward[at[t] : at[t] + c] = now
        expected = np.zeros((labels, labels))
        back = np.ones((0, labels))
        for t in range(len(live) - 1, -1, -1):
            c = live[t]
            if len(back) < c:
                back = np.concatenate([back, np.ones((c - len(back), labels))])
            here = forward[at[t] : at[t] + c]
            through = back * force[at[t] : at[t] + c]
            joint = here * back
            forward[at[t] : at[t] + c] = joint / joint.sum(1, keepdims=True)
            if t:
                if pairs:
                    before = forward_before = forward[at[t - 1] : at[t - 1] + c]
                    weight = ((before @ steps) * through).sum(1, keepdims=True)
                    expected += steps * ((forward_before / weight).T @ through)
                back = through @ steps.T
                back /= back.sum(1, keepdims=True)
        return forward, total, expected


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features by languages
    moves: np.ndarray  # from, to
    start: np.ndarray

    def word_scores(self, words: Iterable[str]) -> np.ndarray:
        places, starts = word_features(words)
        return np.add.reduceat(self.weights[places], starts, axis=0).astype(np.float64) if len(starts) else np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = WordIds()
        number, runs, lengths = known.__getitem__, array("i"), []
        for x in texts:
            size = len(runs)
            if x:
                runs.extend(map(number, LETTERS.findall(x.lower())))
            lengths.append(len(runs) - size)
        if not runs or not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        lengths = np.array(lengths)
        chains = Chains(np.frombuffer(runs, dtype=np.int32), lengths)
        posterior, _, _ = chains.passes(self.word_scores(known)[chains.words], self.moves, self.start)
        sums = np.zeros((len(texts), len(self.languages)))
        for t, c in enumerate(chains.live.tolist()):
            sums[:c] += posterior[chains.at[t] : chains.at[t] + c]
        mean = np.empty_like(sums)
        mean[chains.order] = sums
        mean /= np.maximum(lengths, 1)[:, None]
        best = mean.argmax(1)
        labels = [self.languages[b] if n else "und" for b, n in zip(best.tolist(), lengths.tolist())]
        return labels, [float(min(1.0, m)) if n else 0.0 for m, n in zip(mean[np.arange(len(texts)), best], lengths.tolist())]


def pieces_of(text: str) -> list[list[str]]:
    """Pieces of a text's words; of more than ``TEXT_PIECES`` so many, evenly spread over it."""
    words = LETTERS.findall(text.lower())
    starts = range(0, len(words), PIECE_WORDS)
    if len(starts) > TEXT_PIECES:
        starts = [starts[i * len(starts) // TEXT_PIECES] for i in range(TEXT_PIECES)]
    return [words[i : i + PIECE_WORDS] for i in starts]


def switched(pieces: list[tuple[str, list[str]]], seed: int = 11) -> tuple[list[list[str]], list[list[str]]]:
    """Chains of words and their languages: one to three pieces each, in a shuffled order."""
    random = np.random.default_rng(seed)
    pool = [pieces[i] for i in random.permutation(len(pieces)).tolist()]
    chains, labels, at = [], [], 0
    while at < len(pool):
        some = pool[at : at + int(random.integers(1, 4))]
        at += len(some)
        chains.append([w for _, own in some for w in own])
        labels.append([lang for lang, own in some for _ in own])
    return chains, labels


def fit(pieces: list[tuple[str, list[str]]]) -> Model:
    """Maximum conditional likelihood by full-batch Adam: observed less expected features.  ``pieces``: (language, words)."""
    languages = sorted({lang for lang, _ in pieces})
    size, n = PLACES + LEXICON, len(languages)
    chains, labels = switched(pieces) if n > 1 else ([], [])
    if not chains:
        return Model(languages, np.zeros((size, n), np.float32), np.zeros((n, n)), np.zeros(n))
    known = WordIds()
    runs = np.array([known[w] for own in chains for w in own])
    lengths = np.array([len(x) for x in chains])
    side = Chains(runs, lengths)
    truth = np.empty(len(runs), np.int64)
    truth[side.slot] = [languages.index(lang) for own in labels for lang in own]
    observed = np.zeros((len(runs), n))
    observed[np.arange(len(runs)), truth] = 1
    first_rows = np.arange(side.live[0])
    places, starts = word_features(known)
    used, places = np.unique(places, return_inverse=True)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(places))))
    seen = np.zeros((n, n))
    for t in range(1, len(side.live)):
        c = side.live[t]
        np.add.at(seen, (truth[side.at[t - 1] : side.at[t - 1] + c], truth[side.at[t] : side.at[t] + c]), 1)
    w, moves, start = np.zeros((len(used), n)), np.zeros((n, n)), np.zeros(n)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, moves, start)]
    scale = 1 / len(runs)
    for step in range(1, STEPS + 1):
        word = np.add.reduceat(w[places], starts, axis=0)
        posterior, _, expected = side.passes(word[side.words], moves, start, pairs=True)
        gap = posterior - observed
        by_word = np.stack([np.bincount(side.words, gap[:, k], len(starts)) for k in range(n)], 1)
        grad_w = np.stack([np.bincount(places, by_word[owner, k], len(used)) for k in range(n)], 1) * scale
        grads = (grad_w + DECAY * scale * w, (expected - seen) * scale + DECAY * moves * scale, gap[first_rows].sum(0) * scale)
        new = []
        for p, grad, (m, v) in zip((w, moves, start), grads, state):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            new.append(p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9))
        w, moves, start = new
    weights = np.zeros((size, n), np.float32)
    weights[used] = w
    return Model(languages, weights, moves, start)


def train(docs: DataFrame, use: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fit on a sample of the rows for which ``use`` holds; its size does not follow the input, nor the texts' lengths.

    Rows are drawn by the order of a hash of id and text: first the hashes
    alone give each language's greatest one to draw, then texts up to it are
    taken, and ``SAMPLE_DOCS`` of them where many rows are alike.
    """
    fine = docs.filter(use & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    fine = fine.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{lang}`").alias("l"), F.col(f"`{text}`").alias("t"))
    counts = fine.groupBy(F.col("l").alias("l2")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l2").limit(LANGUAGES)
    counts = common.stage(counts.select("l2"), "languages")
    hashed = fine.join(F.broadcast(counts), F.col("l") == F.col("l2"), "left_semi").withColumn("h", F.xxhash64(F.lit("sample"), "d", "t"))
    by_hash = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    last = hashed.select("l", "h").withColumn("n", by_hash).filter(F.col("n") <= SAMPLE_DOCS).groupBy(F.col("l").alias("l2")).agg(F.max("h").alias("last"))
    drawn = hashed.join(F.broadcast(common.stage(last, "last")), (F.col("l") == F.col("l2")) & (F.col("h") <= F.col("last")))
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "d", "t"))
    drawn = drawn.withColumn("place", first).filter(F.col("place") <= SAMPLE_DOCS).select("l", "place", "t")

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            return [pa.array([pieces_of(x) for x in common.texts(column)], type=pa.list_(pa.list_(pa.string())))]

        return work

    cut = common.map_columns(drawn, ["t"], T.StructType([T.StructField("pieces", T.ArrayType(T.ArrayType(T.StringType())))]), make, ["l", "place"])
    # a text without words still makes its language known
    each = cut.select("l", "place", F.posexplode_outer("pieces").alias("at", "words"))
    some = F.row_number().over(Window.partitionBy("l").orderBy(F.col("words").isNull(), F.xxhash64("place", "at"), "place", "at"))
    rows = each.withColumn("n", some).filter(F.col("n") <= PIECES).select("l", "n", "words").toArrow().to_pydict()
    return fit([(lang, words or []) for lang, _, words in sorted(zip(rows["l"], rows["n"], rows["words"]), key=lambda r: r[:2])])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # features by at most LANGUAGES, whatever the input

    def make():
        own = sent.value

        def work(column: pa.Array) -> list[pa.Array]:
            labels, scores = own.predict(column.to_pylist())
            return [pa.array(labels, type=pa.string()), pa.array(scores, type=pa.float64())]

        return work

    return common.map_columns(docs, [text], T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), make, limit=STEP_BYTES)
