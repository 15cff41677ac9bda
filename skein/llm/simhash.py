"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree in at least
``blocks - radius`` of ``blocks`` pieces of their bits. So each distinct
fingerprint goes into one bucket for each choice of that many pieces, by their
exact bits, and only fingerprints of one bucket are compared: every link is
found, nothing is compared across buckets. Buckets above ``block_rows`` are cut
into chunks that meet in pairs, each pair a group of bounded size.

A bucket yields a spanning forest of its links, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitslice import spanning_links
from .common import cut, release
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints that a bucket holds on average, at most, if their bits are even.
CROWD = 4
#: Fingerprints of a bucket, or of a chunk of one, that are compared in one group.
BLOCK_ROWS = 8192
#: Lanes that a worker gathers before it compares.
GATHER = 1 << 17
#: Shingles whose bits are counted in one go.
COUNTED = 1 << 15


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole text's words where they are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    n = len(words) - size + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[: n - 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[s:e], seed) for s, e in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        part = hashes[i : i + COUNTED].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(counts * 2 > len(hashes)).tolist())


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, print``: the fingerprint's bits as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(shingle_hashes(t.as_py(), size)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, print long")


def bucket_keys(value: Column, radius: int, pieces: int) -> Column:
    """An array of keys: the number of the choice, then the bits of the chosen pieces."""
    edges = [64 * i // pieces for i in range(pieces + 1)]
    piece = [F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for k, chosen in enumerate(combinations(range(pieces), pieces - radius)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(piece[i])
        keys.append(key)
    return F.array(*keys)


def pieces_for(n: int, radius: int = RADIUS) -> int:
    """The fewest pieces, and with them the fewest keys of a fingerprint, at which buckets don't grow with ``n``.

    ``radius + 2`` pieces up to 8 million fingerprints (15 keys at radius 4), two
    more up to 17 billion (70 keys of 32 bits), and so on.
    """
    pieces = radius + 2
    while pieces < 64 and n > CROWD << (64 * (pieces - radius) // pieces):
        pieces += 1
    return pieces


def near_links(nodes: DataFrame, radius: int = RADIUS, pieces: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``node, print`` with distinct prints -> ``a, b``: nodes whose prints link, a spanning forest for each bucket."""
    pieces = pieces or pieces_for(nodes.count(), radius)
    rows = nodes.select("node", "print", F.explode(bucket_keys(F.col("print"), radius, pieces)).alias("key"))
    large = rows.groupBy("key").count().filter(F.col("count") > block_rows).select("key", F.ceil(F.col("count") / block_rows).cast("int").alias("chunks"))
    rows = rows.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(o, chunk) * F.col("chunks") + F.greatest(o, chunk))
    rows = rows.select("key", F.explode(pairs).alias("pair"), "print", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(part):
            key, pair, prints, node = part
            new = np.append(False, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))
            i, j = spanning_links(np.cumsum(new), prints.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            n += len(batch)
            if n >= GATHER:
                part = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                key, pair = part[:2]
                last = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
                if len(last):  # the last group may go on in the next batch
                    end = int(last[-1]) + 1
                    yield links(tuple(c[:end] for c in part))
                    part = tuple(c[end:] for c in part)
                held, n = [part], len(part[0])
        if n:
            yield links(tuple(np.concatenate(c) for c in zip(*held, strict=True)))

    return rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "print").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, pieces: int | None = None, block_rows: int = BLOCK_ROWS, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    The component is the least ``doc_id`` that links reach. Texts without words,
    null among them, have fingerprint zero and link like others. A null
    ``doc_id`` starts no component: it takes that of other documents with its
    fingerprint, or null. Repeated rows get equal results; other columns are
    ignored.
    """
    prints = cut(fingerprints(docs, size))
    nodes = cut(prints.filter("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("node")))
    release(docs.sparkSession)
    found = components(near_links(nodes, radius, pieces, block_rows))
    by_print = nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    return prints.join(by_print, "print", "left").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
