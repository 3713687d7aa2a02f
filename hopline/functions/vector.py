"""Cosine distance as an expression, and the deterministic stand-in for an embedding service."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a (64 bits), and the weights of the stand-in's parts.
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211
MEANING, ROLE, MODALITY = np.float32(0.92), np.float32(0.02), np.float32(0.06)
#: A product of lengths up to this has no direction: the distance is infinite.
NO_LENGTH = 1e-10
MASK = 2**64 - 1


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cos of the angle, in doubles: infinite without a direction, null for a null vector."""
    zero = F.lit(0.0)
    asked = F.array(*[F.lit(float(np.float32(x))) for x in query])
    own = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(own, asked, lambda a, b: a * b), zero, lambda s, x: s + x)
    length = F.sqrt(F.aggregate(own, zero, lambda s, x: s + x * x))
    norm = float(np.sqrt(sum(float(np.float32(x)) ** 2 for x in query)))
    scale = length * F.lit(norm)
    fits = F.size(vector) == len(query)
    distance = F.when(scale > NO_LENGTH, 1 - dot / scale).otherwise(F.lit(float("inf")))
    return F.when(vector.isNull(), F.lit(None).cast("double")).when(fits, distance).otherwise(F.raise_error(F.lit(f"nearest(): a vector has not {len(query)} numbers")).cast("double"))


def _fnv(data: bytes) -> int:
    value = FNV_START
    for b in data:
        value = (value ^ b) * FNV_PRIME & MASK
    return value


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.float32(np.sqrt(sum(float(x) * float(x) for x in v)))
    return v / norm if norm > np.finfo(np.float32).eps else v


def _noise(key: str, dim: int) -> np.ndarray:
    """A unit vector drawn from a text by a xorshift generator (13, 7, 17)."""
    state, out = _fnv(key.encode()), np.empty(dim, np.float32)
    for i in range(dim):
        state ^= state << 13 & MASK
        state ^= state >> 7
        state ^= state << 17 & MASK
        out[i] = np.float32(float(state) / float(MASK)) * np.float32(2.0) - np.float32(1.0)
    return _unit(out)


def embed(text: str, dim: int, role: str = "document", modality: str = "text") -> list[float]:
    """The stand-in's embedding of a text: equal texts (trimmed, A-Z folded) nearly agree over roles."""
    key = text.strip()
    key = "".join(c.lower() if c.isascii() else c for c in key)
    mixed = _noise(f"semantic:{key}", dim) * MEANING + _noise(f"role:{role}", dim) * ROLE + _noise(f"modality:{modality}", dim) * MODALITY
    return [float(x) for x in _unit(mixed.astype(np.float32))]
