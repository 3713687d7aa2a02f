"""Secret scans: fixed patterns, and strings that stay novel to a primed zstandard dictionary.

The patterns give the spans of kinds ``assign``, ``access`` and ``hex``.  The
method adds kind ``novel``: a run of key-like characters with both letters and
digits that stands behind a sensitive word is compressed by zstandard primed
with common identifiers and the code around it.  The marginal bytes are what
the candidate adds to an empty frame; a string that its surroundings and the
identifiers explain costs little, and one whose marginal bytes reach
``NOVELTY`` of its length is reported.  zstandard also codes the characters of
longer strings by how often they occur, so from ``CODED`` characters on one is
reported too whose marginal bytes reach ``NEAR`` of what that alone would cost.

Edge cases: null and empty texts have no spans; offsets are code points, ends
exclusive; a candidate that overlaps a pattern's span is not reported again;
repeated rows give equal spans; empty tables give empty tables; input columns
named like an added one are replaced.  Texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.llm import common

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs that are long enough
#: Words that make what follows sensitive; lower case, sought in any case.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "credential", "bearer", "private_key", "private key", "private-key", "access_key", "access key", "access-key", "authorization")
ASSIGNED = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SENSITIVE_RE = re.compile("|".join(SENSITIVE), re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What a sensitive context is: a candidate begins at most so many code points behind a sensitive word, and has no fewer characters.
REACH, SHORTEST = 80, 16
#: What may stand between the lines of one key, written out or in quotes: a line break, or an escaped one.
NEXT_LINE = re.compile(r"""[\x20\t"',+]*+(?:\\r)?(?:\\n)?[\x20\t"',+\\]*+\r?\n[\x20\t"',+#*>]*+|(?:\\r)?\\n""")
#: The end of a key block, a line too short for a candidate.
LAST_LINE = re.compile(r"""[A-Za-z0-9+/_=-]{1,15}+(?=(?:[\x20\t"',+\r\n]|\\[rn])++-----END)""")
#: Code points on either side of a candidate that prime the dictionary, by default.
AROUND = 512
#: Least marginal bytes per character.
NOVELTY = 0.8
#: Characters from which literals may be entropy-coded; least marginal bytes per byte of the candidate's own entropy; least marginal bytes then.
CODED, NEAR, LEAST = 48, 0.9, 16
IDENTIFIERS = (
    "abstract argument array assert async await base64 boolean break buffer bytes callback catch char class client config "
    "connection const constructor context continue count data database date debug decode default delete describe dict double "
    "element else encode endpoint enum environment error event except export extends false file filter finally float for format "
    "from function get global handler hash header host http https id if implements import index init input int interface "
    "iterator json key lambda length list local localhost log logger long main map message method module name namespace new "
    "none null number object option output override package param parse password path payload port print private property "
    "protected public query raise range read request response result return schema secret select self server session set "
    "settings signature size source sql state static status string struct super switch table test this thread throw timestamp "
    "token true try tuple type undefined update url user username utf8 uuid value var version void while with write yaml yield "
    "0123456789abcdef 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


def marginal_bytes(candidate: bytes, around: bytes) -> int:
    """Compressed bytes that ``candidate`` adds to an empty frame, given identifiers and the code around it."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode() + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=12, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(press.compress(candidate)) - len(press.compress(b""))


def entropy_bytes(candidate: str) -> float:
    """Bytes that the characters cost by their own frequencies alone."""
    n = len(candidate)
    return sum(c * math.log2(n / c) for c in Counter(candidate).values()) / 8


def is_novel(candidate: str, around: str) -> bool:
    marginal = marginal_bytes(candidate.encode(), around.encode())
    if marginal >= NOVELTY * len(candidate):
        return True
    return len(candidate) >= CODED and marginal >= max(LEAST, NEAR * entropy_bytes(candidate))


def base_spans(text: str, raw: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; ``raw`` and ``low`` are the bytes and their lower case, to skip patterns that can't match."""
    found = []
    if any(word in low for word in ASSIGNED):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Taken:
    """Places that spans take, to ask whether a further one would overlap."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for start, _, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def __contains__(self, place: tuple[int, int]) -> bool:
        at = bisect_left(self.starts, place[1]) - 1  # the last that begins before the place ends
        return at >= 0 and self.ends[at] > place[0]


def novel_spans(text: str, known: list[tuple[int, int, int]], reach: int = REACH, around: int = AROUND) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates behind a sensitive word that stay novel, and of the lines that go on after one."""
    ends = [m.end() for m in SENSITIVE_RE.finditer(text)]
    found, done, taken = [], 0, Taken(known)

    def look(start: int, stop: int, goes_on: bool) -> bool:
        """Report the candidate if it is novel; a line of a key that goes on needs no digit."""
        own = text[start:stop]
        mixed = re.search("[0-9]", own) and re.search("[A-Za-z]", own)
        if not (mixed or goes_on) or (start, stop) in taken:
            return False
        if not is_novel(own, text[max(0, start - around) : start] + "\n" + text[stop : stop + around]):
            return False
        found.append((start, 3, stop))
        return True

    for end in ends:
        at = max(end, done)
        # every start up to the reach is seen; what begins there is taken whole
        while at <= end + reach and (m := CANDIDATE.search(text, at, end + reach + SHORTEST)):
            start, done = m.start(), CANDIDATE.match(text, m.start()).end()
            novel = look(start, done, False)
            while gap := NEXT_LINE.match(text, done):
                if line := CANDIDATE.match(text, gap.end()):
                    done = line.end()
                    novel = look(line.start(), done, novel)
                    continue
                if novel and (line := LAST_LINE.match(text, gap.end())) and line.span() not in taken:
                    done = line.end()
                    found.append((line.start(), 3, done))
                break
            at = done
    return found


def spans_of(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    low = raw.lower()
    found = base_spans(text, raw, low)
    if any(word.encode() in low for word in SENSITIVE):
        found += novel_spans(text, found)
    return sorted(found)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add ``spans``: array of (kind, start, end), by start and then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            rows = [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(text, raw)]
                for text, raw in zip(common.texts(column), common.blobs(column))
            ]
            return [pa.array(rows, type=kind)]

        return work

    return common.map_columns(docs, [text], T.StructType([T.StructField(spans, T.ArrayType(SPAN))]), make)


def blank_out(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap give one replacement."""
    parts, at, until, kind = [], 0, -1, 0
    for start, k, end in spans:
        if start < until:
            until = max(until, end)
            continue
        if until >= 0:
            parts.append(f"[{KINDS[kind]}]")
            at = until
        parts.append(text[at:start])
        until, kind = end, k
    if until >= 0:
        parts.append(f"[{KINDS[kind]}]")
        at = until
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with the secrets in their texts blanked out; a column ``n_chars`` follows the text.  Nulls stay null."""

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            raws = common.blobs(column)
            out = []
            for x, raw in zip(column.to_pylist(), raws):
                found = spans_of(x, raw) if x else []
                out.append(blank_out(x, found) if found else x)
            return [pa.array(out, type=pa.string())]

        return work

    done = common.map_columns(docs.withColumn("__text", F.col(f"`{text}`")), ["__text"], T.StructType([T.StructField("__redacted", T.StringType())]), make, docs.columns)
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("__redacted").alias(c))
        elif c == n_chars:
            columns.append(F.coalesce(F.length("__redacted"), F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return done.select(*columns)
