"""Token counts of a SentencePiece model, huge texts by overlap resynchronisation.

A text of up to ``window`` code points is encoded whole.  A longer one is
encoded in overlapping windows with offsets.  Neighbouring windows are spliced
at a boundary inside their overlap that is a token boundary of both and is
*proven* stable: a blank after a non-blank such that no piece of the
vocabulary holds that character followed by a blank.  No merge can cross such
a place, so the tokens before it depend on nothing behind it and the reverse.
From the splice on, both windows must also agree up to the end of the
overlap's last such boundary.  If no boundary qualifies, the overlap is
doubled, in the end to the whole text.

Edge cases: null and empty texts count 0; a text without blanks is widened to
a whole; repeated rows count alike; empty tables give empty tables; input
columns named like an added one are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hopline.llm import common

#: Code points of a window and of the first overlap tried.
WINDOW, OVERLAP = 16_384, 512
#: What a blank is inside the pieces.
MARK = "▁"


class Counter:
    def __init__(self, path: str, window: int = WINDOW, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.window, self.overlap = window, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: characters that some piece holds right before a blank
        self.bound = {a for p in pieces for a, b in zip(p, p[1:]) if b == MARK and a != MARK}
        #: normalisation must not touch what the proof speaks of
        self.plain = self.model.normalize("a  b\n\tc ") == "▁a▁▁b\n\tc▁"
        self.widened = 0

    def stable(self, text: str, at: int) -> bool:
        """Whether no token of ``text`` can cross ``at``."""
        return (
            0 < at < len(text) - 1
            and text[at] == " "
            and not text[at - 1].isspace()
            and text[at - 1] != MARK
            and text[at - 1] not in self.bound
            and text[at + 1].isascii()
            and text[at + 1].isalnum()
        )

    def spans(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """(begin, end) of each token of ``text[start:end]`` in code points of ``text``."""
        part = text[start:end]
        pieces = [(p.begin, p.end) for p in self.model.encode(part, return_type="proto").pieces]
        if not part.isascii():  # offsets are bytes
            place, at = {0: 0}, 0
            for n, c in enumerate(part, 1):
                at += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
                place[at] = n
            pieces = [(place[b], place[e]) for b, e in pieces]
        return [(b + start, e + start) for b, e in pieces]

    def splice(self, text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], low: int, high: int) -> int | None:
        """The first proven boundary in (low, high) at which both windows cut, if they agree from there on."""
        ends = {e for _, e in left}
        cuts = [b for b, e in right if low < b < high and b != e and b in ends and self.stable(text, b)]
        if len(cuts) < 2:
            return None
        first, last = cuts[0], cuts[-1]
        agree = [x for x in left if first <= x[0] and x[1] <= last] == [x for x in right if first <= x[0] and x[1] <= last]
        return first if agree else None

    def huge(self, text: str) -> int:
        """Tokens of a text longer than a window."""
        total, done = 0, 0  # tokens before code point ``done`` are counted
        start, end = 0, self.window
        left = self.spans(text, start, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(start, end - overlap)
                if begin <= start:  # as wide as the window: lengthen the window itself
                    end = min(len(text), end + max(self.window, end - start))
                    self.widened += 1
                    left = self.spans(text, start, end)
                    break
                stop = min(len(text), begin + self.window)
                stop = max(stop, min(len(text), end + self.window // 2))
                right = self.spans(text, begin, stop)
                cut = self.splice(text, left, right, max(begin, done), end)
                if cut is not None:
                    total += sum(1 for b, e in left if b >= done and e <= cut)
                    done, start, end, left = cut, begin, stop, right
                    break
                self.widened += 1
                overlap *= 2
        return total + sum(1 for b, _ in left if b >= done)

    def count(self, texts: list[str]) -> list[int]:
        whole = [x for x in texts if not self.plain or len(x) <= self.window]
        counts = iter(map(len, self.model.encode(whole, num_threads=1)) if whole else ())
        return [next(counts) if not self.plain or len(x) <= self.window else self.huge(x) for x in texts]


@lru_cache(maxsize=4)
def load(path: str, window: int, overlap: int) -> Counter:
    return Counter(path, window, overlap)


def count(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens`` (long) and ``over_limit`` (boolean)."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def make():
        counter = load(model_path, window, overlap)

        def work(column: pa.Array) -> list[pa.Array]:
            own = common.texts(column)
            tokens = counter.count(own)
            sizes = [len(x) for x in common.blobs(column)]
            return [pa.array(sizes, type=pa.int64()), pa.array(tokens, type=pa.int64()), pa.array([n > limit for n in tokens], type=pa.bool_())]

        return work

    return common.map_columns(docs, [text], T.StructType(fields), make)
