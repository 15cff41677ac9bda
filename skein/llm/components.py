"""Connected components of a graph of any size, by stars.

Links are first thinned in each partition (disjoint sets in memory bounded by the
partition). While more than ``FEW`` are left, two steps alternate until nothing
changes: each node hands its larger neighbours to the least node that it knows
(large star), then its smaller ones (small star). Every step is an aggregation
and a join by node, so a node with very many links is pre-aggregated and its join
can be split. Partitions are put together as long as none gets more than ``FEW``
links, and thinned again: a large group that many partitions have found is few
links then, and the last ``FEW`` need no more steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Steps after which a graph of n nodes is done for certain are in the order of log(n) squared.
MOST_STEPS = 200
#: Links that are thinned in one task, on average.
FEW = 1 << 16


def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as stars around the least node of each of its components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in root if root[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def gathered(links: DataFrame, n: int) -> DataFrame:
    """``links``, ``n`` of them, thinned in as few partitions as hold ``FEW`` each."""
    return links.coalesce(math.ceil(n / FEW)).mapInArrow(thinned, "a long, b long") if n else links


def components(links: DataFrame) -> DataFrame:
    """``a, b`` -> ``node, component``: for each node of a link the least node that it reaches. Nulls and self-links say nothing."""
    e = cut(links.filter("a <> b").select("a", "b").mapInArrow(thinned, "a long, b long"))
    n = e.count()
    if n > FEW:
        e = cut(gathered(e, n))
        before = state(e)
        for _ in range(MOST_STEPS):
            n = before[0]
            if n <= FEW:
                break
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            e = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            least = e.groupBy("a").agg(F.min("b").alias("b"))
            moved = e.join(least.withColumnRenamed("b", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            e = cut(moved.filter("a <> b").unionByName(least).distinct())
            release(e.sparkSession)
            now = state(e)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("the components did not settle")
    if n <= FEW:
        e = cut(gathered(e, n))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
