"""Substring deduplication with difference-cover anchors.

A window is ``WINDOW`` consecutive words. Anchors are hashes of ``ANCHOR`` words
at the positions that a difference cover holds modulo its period; for any two
positions some shift below the period brings both onto the cover. Two equal
windows, wherever they stand, so share an anchor at one place inside both.

1. Anchors of all documents meet by hash. Those in two documents come back to
   the documents that have them.
2. Each such anchor is extended to the windows around it, and only these windows
   meet, by a 96-bit hash: the least ``doc_id`` that has one keeps it.
3. The windows that a document loses come back to it, and it loses their words.

Both meetings run on sorted arrays that each task has combined beforehand: of
documents that share a hash within a task, one speaks for all. Documents and what
comes back to them meet in bins of documents; each bin is streamed, its answers first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release
from .hashes import bin_of_longs, packed, runs, shard_of, shards_of, to_shards, unpacked, window_hashes, word_hashes

WINDOW = 13
#: A difference cover: each remainder is a difference of two of its numbers.
PERIOD, COVER = 7, (1, 2, 4)
#: A window holds an anchor at each of its first ``PERIOD`` positions.
ANCHOR = WINDOW - PERIOD + 1
#: Hashes that a task gathers before it combines and sends them.
GATHER = 1 << 21
#: ``kind`` 0: hashes that ask for others, for a shard of hashes; 1: settled hashes, for a bin of documents.
SENT = "shard int, kind int, n long, first binary, second binary, docs binary"
NAMES = ["shard", "kind", "n", "first", "second", "docs"]
BACK = "bin int, hashes binary, docs binary"
#: Words are compared by 96 bits of each window. What comes back to a document only tells its own windows
#: apart, so 64 bits do there; and for anchors, which only name windows to try, 32.
SECOND_BITS = np.uint64(32)
BACK_TYPES = {False: np.uint32, True: np.uint64}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cover and the hashes of the words from there."""
    all_of = window_hashes(hashes, ANCHOR)
    at = np.flatnonzero(np.isin(np.arange(len(all_of)) % PERIOD, COVER))
    return at, all_of[at]


class Gathered:
    """Hashes of many documents; ``settle`` says which of them need no answer from others."""

    def __init__(self, shards: int, wide: bool, least_only: bool):
        self.shards, self.wide, self.least_only = shards, wide, least_only
        self.clear()

    def clear(self) -> None:
        self.n, self.parts = 0, []

    def add(self, doc: int, first: np.ndarray, second: np.ndarray | None = None) -> None:
        if len(first):
            self.parts.append((doc, first, second))
            self.n += len(first)

    def rows(self) -> pa.RecordBatch:
        first = np.concatenate([p[1] for p in self.parts])
        second = np.concatenate([p[2] for p in self.parts]) if self.wide else np.zeros(len(first), np.uint64)
        docs = np.repeat(np.array([p[0] for p in self.parts], np.int64), [len(p[1]) for p in self.parts])
        self.clear()
        order = np.lexsort((docs, second, first)) if self.wide else np.lexsort((docs, first))
        first, second, docs = first[order], second[order], docs[order]
        asking, settled = split(first, second, docs, self.wide, self.least_only)
        out: list[tuple] = []
        f, s, d = first[asking], second[asking], docs[asking]
        ends = np.searchsorted(shard_of(f, self.shards), np.arange(self.shards + 1))
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if a < b:
                out.append((k, 0, b - a, packed(f[a:b], True), packed(s[a:b]) if self.wide else None, packed(d[a:b].view(np.uint64))))
        for k, hashes, whose in by_bin(first[settled], docs[settled], self.wide, self.shards):
            out.append((k, 1, 0, hashes, None, whose))
        columns = list(zip(*out, strict=True)) if out else [()] * len(NAMES)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)


def split(first, second, docs, wide: bool, least_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes sorted with their documents: which ask, one of each hash, that of the least document; and which are settled.

    ``least_only``: those that a smaller document has too. Else: all that two documents have.
    """
    start = runs(first, second) if wide else runs(first)
    sizes = np.diff(np.append(start, len(first)))
    least = np.repeat(docs[start], sizes)
    if least_only:
        settled = docs > least
    else:
        settled = np.repeat(docs[start + sizes - 1] != docs[start], sizes) if len(start) else np.zeros(0, bool)
    new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (docs[1:] != docs[:-1]))[: len(first)]
    return start, np.flatnonzero(settled & new)


def shortened(hashes: np.ndarray, wide: bool) -> np.ndarray:
    """Hashes as they come back to a document."""
    return hashes if wide else (hashes >> np.uint64(32)).astype(np.uint32)


def by_bin(first, docs, wide: bool, bins: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Hashes and whose they are, one row for each bin of documents that has any."""
    home = bin_of_longs(docs, bins)
    order = np.lexsort((docs, home))
    first, docs, home = shortened(first[order], wide), docs[order].view(np.uint64), home[order]
    start = runs(home)
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(docs)], strict=False):
        yield int(home[a]), first[a:b].tobytes(), packed(docs[a:b], True)


def meet(sent: DataFrame, shards: int, wide: bool, least_only: bool) -> DataFrame:
    """``bin, hashes, docs``: the settled hashes of documents, those that only the meeting settles included."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = (pa.int32(), pa.binary(), pa.binary()), ["bin", "hashes", "docs"]
        asked: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            settled = batch.filter(pc.equal(batch.column(1), 1))
            yield pa.RecordBatch.from_arrays([settled.column(0), settled.column(3), settled.column(5)], names=names)
            for row in batch.filter(pc.equal(batch.column(1), 0)).to_pylist():
                second = unpacked(row["second"]) if wide else np.zeros(row["n"], np.uint64)
                asked.append((unpacked(row["first"], True), second, unpacked(row["docs"]).view(np.int64)))
        if asked:
            first, second, docs = (np.concatenate(c) for c in zip(*asked, strict=True))
            asked.clear()
            order = np.lexsort((docs, second, first)) if wide else np.lexsort((docs, first))
            first, second, docs = first[order], second[order], docs[order]
            at = split(first, second, docs, wide, least_only)[1]
            for row in by_bin(first[at], docs[at], wide, shards):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return to_shards(sent, shards).mapInArrow(answer, BACK)


def with_hashes(docs: DataFrame, back: DataFrame, bins: int, wide: bool, handle: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Documents meet what came back to them. ``handle`` gets ``doc_id, text, hashes`` by document.

    Each bin holds its documents and what came back to any of them, which comes first.
    """
    # A null doc_id can have no answer; its rows are dealt by their text.
    home = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(bins)).cast("int")
    none = F.lit(None).cast("binary")
    rows = docs.select(home.alias("bin"), F.lit(1).alias("last"), "doc_id", "text", none.alias("hashes"), none.alias("docs")).unionByName(
        back.select("bin", F.lit(0).alias("last"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "hashes", "docs")
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        whose = hashes = None
        for batch in batches:
            for last, doc, text, h, d in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if not last:
                    held.append((unpacked(d, True).view(np.int64), np.frombuffer(h, BACK_TYPES[wide])))
                    continue
                if whose is None:
                    whose, hashes = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.empty(0, np.int64), np.empty(0, BACK_TYPES[wide]))
                    held.clear()
                    order = np.argsort(whose, kind="stable")
                    whose, hashes = whose[order], hashes[order]
                a, b = (0, 0) if doc is None else (np.searchsorted(whose, doc, side) for side in ("left", "right"))
                yield doc, text, hashes[a:b]

    return to_shards(rows, bins, "bin").sortWithinPartitions("last").mapInArrow(lambda batches: handle(stream(batches)), schema)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_text``.

    A word goes if a window of 13 words covers it whose words, in their order,
    also start in a document with a smaller ``doc_id``, on the input as it is.
    Null text has no words; texts of fewer words lose none. A null ``doc_id`` is
    neither smaller nor larger than others: its text stays and takes from none.
    Rows with one ``doc_id`` don't take from each other. Extra columns are ignored.
    """
    spark = docs.sparkSession
    shards = shards_of(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    named = docs.filter("doc_id IS NOT NULL")

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(shards, wide=False, least_only=False)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.add(doc, anchors(word_hashes(words_of(text.as_py())))[1])
                if held.n >= GATHER:
                    yield held.rows()
        if held.n:
            yield held.rows()

    def ask_windows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = Gathered(shards, wide=True, least_only=True)
        for doc, text, shared in rows:
            if not len(shared):
                continue
            words = word_hashes(words_of(text))
            at, found = anchors(words)
            at = at[np.isin(shortened(found, False), shared)]
            n = len(words) - WINDOW + 1
            if n <= 0 or not len(at):
                continue
            near = np.zeros(n + 1, np.int64)
            np.add.at(near, np.clip(at - PERIOD + 1, 0, n), 1)
            np.add.at(near, np.clip(at + 1, 0, n), -1)
            start = np.flatnonzero(np.cumsum(near[:n]) > 0)
            held.add(doc, window_hashes(words, WINDOW, 0)[start], window_hashes(words, WINDOW, 1)[start] >> SECOND_BITS)
            if held.n >= GATHER:
                yield held.rows()
        if held.n:
            yield held.rows()

    def remove(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_text"])
            out.clear()
            return made

        for doc, text, lost in rows:
            words = words_of(text)
            kept = words
            if len(lost):
                gone = np.isin(window_hashes(word_hashes(words), WINDOW), lost)
                cover = np.zeros(len(words) + 1, np.int64)
                cover[: len(gone)] += gone
                cover[WINDOW : WINDOW + len(gone)] -= gone
                stays = np.cumsum(cover[:-1]) == 0
                kept = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
            out.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
            size += len(text or "")
            if size > 1 << 23 or len(out) >= 10_000:
                size = 0
                yield batch()
        if out:
            yield batch()

    shared = settled(lambda: named.mapInArrow(ask_anchors, SENT), shards, wide=False, least_only=False)
    lost = settled(lambda: with_hashes(named, shared, shards, False, ask_windows, SENT), shards, wide=True, least_only=True)
    return with_hashes(docs, lost, shards, True, remove, "doc_id long, n_words long, n_removed long, kept_text string")


def settled(sent: Callable[[], DataFrame], shards: int, wide: bool, least_only: bool) -> DataFrame:
    """What comes back, written to the shared folder. The step's frames end here, so its shuffles can be dropped."""
    out = cut(meet(sent(), shards, wide, least_only))
    release(out.sparkSession)
    return out


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def sha_of(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN m USING (k) WHERE doc_id > least),
a AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
r AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) AS kept, count(*) AS n FROM a ANTI JOIN g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(r.n, 0))::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
