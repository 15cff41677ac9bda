"""Benchmark decontamination by winnowing.

Words are hashed in k-grams, and of each sliding window of consecutive k-grams
the least hash is kept. A span of ``WINDOW`` words that a document shares with an
item holds one whole window of k-grams, so both sides keep the same hash in it:
no shared span of that length is missed. A document's kept hashes are joined with
the benchmark's, and each hit is extended to the benchmark's windows around it,
word by word. Items that are shorter than a window are one window each; of those
lengths every hash is kept.

A benchmark of up to ``INDEX_WORDS`` words is an index that is broadcast: documents
pass it and nothing is shuffled. A larger one stays a table. A filter of bounded
size, broadcast, lets the kept hashes of documents through that the benchmark may
have; these are joined with the benchmark's, documents with one in common meet
their hashes again, and their windows around them are joined with the benchmark's
windows, by all their words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, kept_rows, unused
from .hashes import mixed, window_hashes, word_hashes

#: Words of a window; words of a k-gram; k-grams that the least hash is kept of.
WINDOW, GRAM = 10, 5
KEPT_OF = WINDOW - GRAM + 1
#: Words of the benchmark in a broadcast index (some 100 MB in a worker at most).
INDEX_WORDS = 300_000
#: Bits of the filter for larger ones, as a power of two: 16 MB.
FILTER_BITS = 27
#: On text in UTF-8 whose A-Z are lower case, what isn't [\x00-\x2F\x3A-\x60\x7B-\x7F].
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    return TOKEN.findall((text or "").encode("utf-8", "replace").lower())


def gram_hashes(ids: np.ndarray, k: int, values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A hash of each k consecutive ids; ``NEVER`` where one of them, id 0, isn't in the benchmark."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    own = values[ids]
    total = np.zeros(n, np.uint64)
    missing = np.zeros(n, bool)
    for j in range(k):
        total += own[j : j + n] * factors[j]
        missing |= ids[j : j + n] == 0
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    total[missing] = NEVER
    return total


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash of each ``width`` consecutive ones, ties all kept."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = hashes[:n].copy()
    for j in range(1, width):
        np.minimum(least, hashes[j : j + n], out=least)
    kept = np.zeros(len(hashes), bool)
    for j in range(width):
        kept[j : j + n] |= hashes[j : j + n] == least
    return np.flatnonzero(kept)


def merged(covers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Covers that touch or overlap as one span."""
    spans: list[tuple[int, int]] = []
    for s, e in sorted(covers):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    return spans


class BenchmarkIndex:
    """Fingerprints and windows of some items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids: dict[bytes, int] = {}
        #: By length of window: its word ids as bytes -> the items that have it.
        self.windows: dict[int, dict[bytes, set]] = {}
        coded = []
        for item, text in items:
            words = words_of(text)
            coded.append((item, np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int32)))
        dice = np.random.default_rng(2)
        self.values = dice.integers(1, 1 << 63, len(self.ids) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.factors = dice.integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        marks: dict[int, set[int]] = {}
        for item, ids in coded:
            m = min(WINDOW, len(ids))
            if not m:
                continue
            known = self.windows.setdefault(m, {})
            for i in range(len(ids) - m + 1):
                known.setdefault(ids[i : i + m].tobytes(), set()).update(() if item is None else (item,))
            marks.setdefault(m, set()).update(self.kept(ids, m)[0].tolist())
        self.marks = {m: np.array(sorted(v - {int(NEVER)}), np.uint64) for m, v in marks.items()}

    def kept(self, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The kept hashes for windows of m words, and where they stand."""
        hashes = gram_hashes(ids, GRAM if m == WINDOW else m, self.values, self.factors)
        at = winnowed(hashes, KEPT_OF if m == WINDOW else 1)
        return hashes[at], at

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words that windows cover, apart and in order, and the items that have these windows."""
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))
        starts, items = [], set()
        for m, known in self.windows.items():
            hashes, at = self.kept(ids, m)
            marks = self.marks[m]
            if not len(at) or not len(marks):
                continue
            near = np.minimum(np.searchsorted(marks, hashes), len(marks) - 1)
            back = WINDOW - GRAM if m == WINDOW else 0
            tried = -1
            for p in at[marks[near] == hashes].tolist():
                for i in range(max(p - back, tried + 1), min(p, len(ids) - m) + 1):
                    found = known.get(ids[i : i + m].tobytes())
                    if found is not None:
                        starts.append((i, i + m))
                        items |= found
                tried = max(tried, p)
        return merged(starts), items


def words_in(items: DataFrame) -> int:
    return items.agg(F.sum(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").alias("text")).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, spans, items``.

    ``spans`` are the spans of words (end exclusive, flat: start, end, start, ...)
    that occurrences of the benchmark's windows cover; ``items`` the ids of the
    items that have such a window. Null text has no words and no hits; an item
    without words has no windows. An item without id covers words but isn't
    listed. Repeated items count once; repeated documents are judged one by one.
    """
    items = items_of(benchmark)
    if words_in(items) > index_words:
        hits = joined_hits(docs, items)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("x_key"), native_count().alias("n_words"))
        none = F.array().cast("array<int>"), F.array().cast("array<long>")
        return rows.join(hits, "x_key", "left").select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    shared = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex(sorted(map(tuple, items.collect()), key=repr)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, found = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                hits, those = shared.value.search(words)
                counts.append(len(words))
                spans.append([x for s in hits for x in s])
                found.append(sorted(those))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "spans", "items"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, "doc_id long, n_words long, spans array<int>, items array<long>")


def row_key() -> Column:
    """Rows with equal ids and texts share it, and their result."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))))


def native_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")


def marks_of(words: list[bytes], m: int) -> np.ndarray:
    """A hash for each window of m words: the least of the k-grams in one of full length, that of all its words in a shorter one."""
    hashes = window_hashes(word_hashes(words), GRAM if m == WINDOW else m)
    if m < WINDOW:
        return mixed(hashes + np.uint64(m))
    n = max(0, len(hashes) - KEPT_OF + 1)
    return np.min([hashes[j : j + n] for j in range(KEPT_OF)], axis=0) if n else np.empty(0, np.uint64)


def joined_hits(docs: DataFrame, items: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``x_key, spans, items`` of the documents that have a window, by joins with a benchmark of any size."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                m = min(WINDOW, len(words))
                for i, mark in enumerate(marks_of(words, m).view(np.int64).tolist() if m else ()):
                    rows.append((item, m, mark, b" ".join(words[i : i + m])))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["item", "m", "mark", "window"])

    known = cut(items.mapInArrow(windows, "item long, m int, mark long, window binary"))
    lengths = sorted(r[0] for r in known.select("m").distinct().collect())
    # As many rows as the filter has words of 64 bits, at most.
    place = F.col("mark").bitwiseAND(F.lit((1 << bits) - 1))
    filled = known.select(F.shiftright(place, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(mark & 63 AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    got = filled.toArrow()
    table[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << bits) - 1)
        for batch in batches:
            keys, marks = [], []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                own = np.unique(np.concatenate([np.empty(0, np.uint64), *(marks_of(words, m) for m in lengths)]))
                at = own & low
                own = own[(shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                if len(own):
                    keys.append(key.as_py())
                    marks.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["x_key", "marks"])

    texts = docs.select(row_key().alias("x_key"), "text")
    near = texts.mapInArrow(passing, "x_key binary, marks array<long>").select("x_key", F.explode("marks").alias("mark"))
    met = near.join(known.select("mark").distinct(), "mark", "left_semi").groupBy("x_key").agg(F.collect_set("mark").alias("marks"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, wanted = words_of(text), np.array(marks, np.int64)
                for m in lengths:
                    at = np.flatnonzero(np.isin(marks_of(words, m).view(np.int64), wanted)).tolist()
                    columns = [pa.array([key] * len(at), pa.binary()), pa.array(at, pa.int32()), pa.array([m] * len(at), pa.int32()), pa.array([b" ".join(words[i : i + m]) for i in at], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["x_key", "i", "m", "window"])

    tried = texts.join(met, "x_key").dropDuplicates(["x_key"]).mapInArrow(around, "x_key binary, i int, m int, window binary")
    # An item's id stands once for each of its windows, and items without id count as a window all the same.
    by_window = known.groupBy("m", "window").agg(F.collect_set("item").alias("items"))
    hits = tried.join(by_window, ["m", "window"]).groupBy("x_key").agg(
        F.array_sort(F.collect_list(F.struct("i", (F.col("i") + F.col("m")).alias("e")))).alias("covers"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[x for s in merged([(c["i"], c["e"]) for c in covers.as_py()]) for x in s] for covers in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int32())), batch.column(2)], names=["x_key", "spans", "items"])

    return hits.mapInArrow(united, "x_key binary, spans array<int>, items array<long>")


def digest_contamination(found: DataFrame) -> DataFrame:
    """Counts and digests of what :func:`find_contamination` gives, row by row: without spans zeros, the digest of the empty string and false."""
    hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), F.lit(0).cast("long"), lambda n, i: n + F.get("spans", i + 1) - F.get("spans", i))
    hit = F.when(F.size("spans") > 0, hit).otherwise(F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """``docs`` without the rows that have a window of the benchmark; all columns stay.

    Null texts stay, repeated rows stay or go together, and a benchmark without
    words drops nothing. Nothing is shuffled while the benchmark fits an index.
    """
    items = items_of(benchmark)
    if words_in(items) > index_words:
        (name,) = unused(docs, "key")
        hits = joined_hits(docs, items).select(F.col("x_key").alias(name))
        (own,) = unused(docs.withColumn(name, F.lit(0)), "row")
        return docs.withColumn(own, row_key()).join(hits, F.col(own) == F.col(name), "left_anti").drop(own)
    shared = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex(sorted(map(tuple, items.collect()), key=repr)))

    return kept_rows(docs, lambda texts: [not shared.value.search(words_of(t))[0] for t in texts])


def sha_of(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw USING (m, k)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
