"""Sorted hash arrays on their way through a shuffle.

Counting or matching hashes of all words' windows one row each would move far
more than the text. Instead each task gathers the hashes of many documents,
combines equal ones, and sends one row for each shard of the hash space: sorted
arrays as byte planes of their differences, which the shuffle's own compression
shrinks further. A hash that is everywhere costs each task one entry.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

MASK = (1 << 64) - 1
_dice = np.random.default_rng(11)
#: Odd factors of the linear hash over word hashes, two independent rows.
FACTORS = _dice.integers(0, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def xxhash64_of_longs(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for a column of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.uint64((seed + int(p5) + 8) & MASK) ^ (_turned(values.view(np.uint64) * p2, 31) * p1)
    h = _turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def bin_of_longs(values: np.ndarray, bins: int) -> np.ndarray:
    """``pmod(xxhash64(value), bins)``."""
    return xxhash64_of_longs(values).view(np.int64) % bins


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int, row: int = 0) -> np.ndarray:
    """A hash of each ``size`` consecutive words; rows 0 and 1 together are 128 bits."""
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size if n else 0):
        total += words[j : j + n] * FACTORS[row, j]
    return mixed(total)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash space of equal width."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def packed(values: np.ndarray, differences: bool = False) -> bytes:
    """Byte planes, lowest first; of the differences if ``values`` are sorted."""
    v = values.astype("<u8")
    if differences and len(v):
        v = np.concatenate([v[:1], v[1:] - v[:-1]])
    return v.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes, differences: bool = False) -> np.ndarray:
    v = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(v, dtype=np.uint64) if differences else v


def runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin, in arrays sorted together."""
    n = len(sorted_by[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for a in sorted_by:
            new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def shards_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def to_shards(df: DataFrame, shards: int, column: str = "shard") -> DataFrame:
    """One partition for each shard."""
    return df.repartitionById(shards, df[column])
