"""Byte-level BPE by replaying merges over many words at once.

Distinct pre-tokens are laid out as one long row of symbols with gaps between
words.  An inverted index leads from each rank to the positions where a pair
of that rank stands; ranks are taken in ascending order from a heap, all
positions of the rank are merged together, and only the two pairs beside a
merged one are indexed anew.  Texts are then read off as runs of word ids.

A task goes through its part of the corpus in steps (the texts of
``BLOCK_BYTES``) and remembers the words that it has merged, so a word is
merged once a task; after ``MEMO_WORDS`` words it begins anew, so memory
follows neither the partition nor the corpus.

Edge cases: a null or empty text has no ids and decodes to empty bytes;
repeated rows give equal results; an empty table gives an empty table; an
input column named like an output is replaced; a text of any length is one
step, whose memory follows that text.  A null id list decodes to empty bytes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hopline.llm import common

#: Bytes of text in a step, and words that a task remembers at most (beyond those of one step).
BLOCK_BYTES, MEMO_WORDS = 2 << 20, 250_000


class WordIds(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class MergeReplay:
    """The merges of one rank file, applied to blocks of words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.byte_symbols = np.array(self.byte_ids, dtype=np.int32)
        self.byte_pairs = np.full((256, 256), -1, dtype=np.int32)
        for a in range(256):
            for b in range(256):
                self.byte_pairs[a, b] = self.pairs.get((self.byte_ids[a], self.byte_ids[b]), -1)
        left, right, rank = (np.array(x, dtype=np.int32) for x in zip(*((a, b, r) for (a, b), r in self.pairs.items())))
        self.behind, self.ahead = self._partners(left, right, rank), self._partners(right, left, rank)

    def _partners(self, own: np.ndarray, other: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each symbol the symbols it pairs with on one side, and the ranks of those pairs."""
        order = np.argsort(own, kind="stable")
        return np.searchsorted(own[order], np.arange(self.size + 1)), other[order], rank[order]

    def block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a block, one after the other, and the number of ids of each.

        A position is merged at rank r only while its pair still has rank r.
        Where positions of one rank overlap (``aaa``) every second one of the
        run is taken, from the left.  Should a merge make a pair of no higher
        rank in a word, which the order by ranks can't serve for all words at
        once, that word is merged by itself (``one``).
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        place = np.arange(len(data), dtype=np.int32) + word_of + 1  # a gap before the first word and after each
        n = len(data) + len(words) + 1
        symbols = np.full(n, -1, dtype=np.int32)
        symbols[place] = self.byte_symbols[data]
        word_at = np.zeros(n, dtype=np.int32)
        word_at[place] = word_of
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        ranks = np.full(n, -1, dtype=np.int32)  # of the pair that begins at a position
        if len(data) > 1:
            ranks[place[:-1]] = np.where(word_of[:-1] == word_of[1:], self.byte_pairs[data[:-1], data[1:]], -1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                groups = zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)) if len(cuts) else ((int(rank[0]), at),)
            else:
                groups = ((int(rank[0]), at),)
            for r, own in groups:
                known = index.get(r)
                if known is None:
                    index[r] = [own]
                    heappush(heap, r)
                else:
                    known.append(own)

        live = np.flatnonzero(ranks >= 0).astype(np.int32)
        if len(live):
            enter(live, ranks[live])
        look = np.full(self.size + 2, -1, dtype=np.int32)  # by symbol; gaps (-1) read the last place
        odd = np.zeros(len(words), dtype=bool)
        while heap:
            rank = heappop(heap)
            at = index.pop(rank)
            at = np.concatenate(at) if len(at) > 1 else at[0]
            at = at[ranks[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                chained = np.concatenate(([False], before[at[1:]] == at[:-1]))
                if chained.any():
                    turn = np.arange(len(at))
                    at = at[(turn - np.maximum.accumulate(np.where(chained, 0, turn))) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            symbols[at], symbols[gone], ranks[gone] = rank, -2, -1
            after[at], before[follow] = follow, at
            prior = before[at]
            for (starts, partners, made), where, other in ((self.behind, at, follow), (self.ahead, prior, prior)):
                low, high = starts[rank], starts[rank + 1]
                if low == high:
                    ranks[where] = -1
                    continue
                look[partners[low:high]] = made[low:high]
                new = look[symbols[other]]
                look[partners[low:high]] = -1
                early = (new >= 0) & (new <= rank)
                if early.any():
                    odd[word_at[where[early]]] = True
                    new[early] = -1
                ranks[where] = new
                some = new >= 0
                if some.any():
                    enter(where[some], new[some])
        alive = symbols >= 0
        ids, owner = symbols[alive], word_at[alive]
        counts = np.bincount(owner, minlength=len(words))
        if odd.any():
            own = [self.one(words[i]) for i in np.flatnonzero(odd)]
            ids = ids[~odd[owner]]
            counts[odd] = [len(x) for x in own]
            mine = np.repeat(odd, counts)
            whole = np.empty(len(mine), dtype=np.int32)
            whole[~mine], whole[mine] = ids, list(chain.from_iterable(own))
            ids = whole
        return ids, counts

    def one(self, word: bytes) -> list[int]:
        """The ids of a single word: the leftmost pair of the lowest rank, again and again."""
        ids, get = [self.byte_ids[b] for b in word], self.pairs.get
        while len(ids) > 1:
            rank, at = min((get(pair, self.size), i) for i, pair in enumerate(zip(ids, ids[1:])))
            if rank == self.size:
                break
            ids[at : at + 2] = [rank]
        return ids

    def replay(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and the number of each word's ids; a word that is a token is that token."""
        raw = [word.encode() for word in words]
        token = np.array([self.ranks.get(x, -1) for x in raw], dtype=np.int32)
        ids, counts = self.block([x for x, t in zip(raw, token.tolist()) if t < 0])
        sizes = np.ones(len(raw), dtype=np.int64)
        sizes[token < 0] = counts
        merged = np.repeat(token < 0, sizes)
        out = np.empty(len(merged), dtype=np.int32)
        out[merged], out[~merged] = ids, token[token >= 0]
        return out, sizes


class Memo:
    """The ids of all words that a task has met: ``flat[starts[w] : starts[w] + sizes[w]]`` for word w."""

    def __init__(self, replayer: MergeReplay):
        self.replayer = replayer
        self.clear()

    def clear(self) -> None:
        self.known, self.merged = WordIds(), 0
        self.flat, self.starts, self.sizes, self.used = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def merge_new(self) -> None:
        """Merge the words that were numbered since the last time."""
        new = list(islice(self.known, self.merged, None))
        if not new:
            return
        ids, sizes = self.replayer.replay(new)
        words, n = slice(self.merged, len(self.known)), self.used + len(ids)
        self.flat, self.starts, self.sizes = (_room(x, size) for x, size in ((self.flat, n), (self.starts, words.stop), (self.sizes, words.stop)))
        self.flat[self.used : n] = ids
        self.sizes[words] = sizes
        self.starts[words] = self.used + np.cumsum(sizes) - sizes
        self.merged, self.used = words.stop, n


def _room(x: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` values."""
    if len(x) >= size:
        return x
    out = np.empty(max(size, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


@lru_cache(maxsize=4)
def load(path: str) -> MergeReplay:
    with open(path, "rb") as lines:
        return MergeReplay({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def _join_bytes(look, flat: np.ndarray, ends: list[int]) -> pa.Array:
    return pa.array([b"".join(map(look, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])], type=pa.binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (array<int>): each match of ``pattern`` encoded separately, no special tokens.

    With ``decoded`` the ids are also decoded, in the same pass, to a column of that name.
    """
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])

    def make():
        replayer = load(ranks_path)
        find = regex.compile(pattern).findall
        memo = Memo(replayer)

        def work(column: pa.Array) -> list[pa.Array]:
            if len(memo.known) > MEMO_WORDS:
                memo.clear()
            runs, row_of, number = array("i"), np.zeros(len(column) + 1, dtype=np.int64), memo.known.__getitem__
            for row, x in enumerate(common.texts(column)):
                runs.extend(map(number, find(x)))
                row_of[row + 1] = len(runs)
            memo.merge_new()
            words = np.frombuffer(runs, dtype=np.int32) if runs else np.zeros(0, dtype=np.int32)
            lengths = memo.sizes[words]
            ends = np.concatenate(([0], np.cumsum(lengths)))
            flat = memo.flat[np.repeat(memo.starts[words] - ends[:-1], lengths) + np.arange(ends[-1])]
            cuts = ends[row_of]
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))
            return [lists, _join_bytes(replayer.bytes_of.__getitem__, flat, cuts.tolist())] if decoded else [lists]

        return work

    return common.map_columns(docs, [text], T.StructType(fields), make, limit=BLOCK_BYTES)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of each row's ids, joined."""

    def make():
        look = load(ranks_path).bytes_of.__getitem__

        def work(column: pa.Array) -> list[pa.Array]:
            return [_join_bytes(look, column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist())]

        return work

    return common.map_columns(encoded, [ids], T.StructType([T.StructField(decoded, T.BinaryType())]), make)
