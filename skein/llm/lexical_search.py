"""Ranked lexical search over dual-sorted wavelet trees.

Documents are indexed in shards of bounded size. A shard's postings stand term by
term, each list by falling impact, as a sequence of document numbers that a
wavelet matrix stores: a bit plane for each bit of the number, each level a stable
partition of the one above. So a list is navigable both ways: its first posting
is its heaviest, and a range of documents is a node whose part of the list is
again an interval that begins with the heaviest posting in the range.

A search keeps nodes with an interval for each term of the query. The first
postings bound what a document below a node can score; the nodes with the best
bounds are split first, and nodes that can't reach the k-th best score found so
far, nor win a tie with it, are dropped. At a leaf the bound is the exact score.
Scores found in one shard bound the search of the task's next ones.

Document frequencies and lengths are those of the whole collection. An index holds
the terms that a block of queries asks for, of every document; queries beyond a
block take further passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, release
from .hashes import packed, unpacked, word_hashes

#: Letters, digits and all beyond ASCII are kept, A to Z in lower case; the rest separates terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Results for each query.
TOP = 10
#: Postings of a shard, about: one document more fits in.
SHARD = 1 << 19
#: Terms of the queries that are broadcast and searched together.
QUERY_TERMS = 1 << 17
#: Nodes that are split in one go.
SPLIT = 64
#: Stands for a document without id; it comes last among equals.
NO_ID = (1 << 63) - 1


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LETTERS).split()


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text as sorted 64-bit hashes, and how often each occurs."""
    return np.unique(word_hashes(terms_of(text)), return_counts=True)


def counted(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, tfs``: a document's number of terms, and those in the sorted ``vocabulary`` by their place there."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                own, tf = counts_of(text.as_py())
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                asked = known[at] == own if len(known) else np.zeros(len(own), bool)
                n.append(int(tf.sum()))
                terms.append(packed(at[asked].astype(np.uint64), differences=True))
                tfs.append(packed(tf[asked].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n long, terms binary, tfs binary")


def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a batch hold each term."""
    for batch in batches:
        terms, n = np.unique(np.concatenate([unpacked(t.as_py(), differences=True) for t in batch.column(0)] or [np.empty(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])


def impacts(tfs: np.ndarray, n: int, all_docs: int, all_terms: int) -> np.ndarray:
    """What occurrences of a term weigh in a document of ``n`` terms, in whole numbers."""
    m = 100 - 75 + (75 * n * all_docs) // all_terms
    tf = tfs.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


SHARD_SCHEMA = "docs binary, terms binary, starts binary, planes binary, impacts binary"


def shard_of(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[bytes, ...]:
    """Documents with terms and impacts -> a shard: its ids in order, its lists' terms and first places, bit planes, impacts."""
    docs.sort(key=lambda d: d[0])
    number = np.repeat(np.arange(len(docs)), [len(d[1]) for d in docs])
    term, impact = np.concatenate([d[1] for d in docs]), np.concatenate([d[2] for d in docs])
    order = np.lexsort((number, -impact, term))
    terms, starts = np.unique(term[order], return_index=True)
    now, planes = number[order], []
    for level in reversed(range(max(1, (len(docs) - 1).bit_length()))):
        one = (now >> level) & 1 == 1
        planes.append(np.packbits(one).tobytes())
        now = np.concatenate([now[~one], now[one]])
    return np.array([d[0] for d in docs], "<i8").tobytes(), terms.astype("<u8").tobytes(), starts.astype("<i8").tobytes(), b"".join(planes), impact[order].astype("<u4").tobytes()


def indexed(rows: DataFrame, all_docs: int, all_terms: int, shard: int = SHARD) -> DataFrame:
    """What :func:`counted` gives -> shards. A table of them can be written and searched again."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, n, terms, tfs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not terms:
                    continue
                own = unpacked(terms, differences=True)
                held.append((NO_ID if doc_id is None else doc_id, own, impacts(unpacked(tfs), n, all_docs, all_terms)))
                size += len(own)
                if size >= shard:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    def row(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in shard_of(held)], names=[c.split()[0] for c in SHARD_SCHEMA.split(", ")])

    return rows.mapInArrow(build, SHARD_SCHEMA)


@dataclass
class Tree:
    """A shard unpacked: for each level the number of ones before each place, and the impacts in the level's order."""

    docs: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    ones: np.ndarray
    zeros: np.ndarray
    impacts: np.ndarray
    levels: int

    @staticmethod
    def of(docs: bytes, terms: bytes, starts: bytes, planes: bytes, impact: bytes) -> Tree:
        ids, now = np.frombuffer(docs, "<i8"), np.frombuffer(impact, "<u4").astype(np.int64)
        size, levels = len(now), max(1, (len(ids) - 1).bit_length())
        bits = np.unpackbits(np.frombuffer(planes, np.uint8).reshape(levels, -1), axis=1, count=size).astype(bool)
        ones = np.zeros((levels, size + 1), np.int32)
        np.cumsum(bits, axis=1, out=ones[:, 1:])
        ordered = np.empty((levels + 1, size), np.int32)
        for level in range(levels):
            ordered[level] = now
            now = np.concatenate([now[~bits[level]], now[bits[level]]])
        ordered[levels] = now
        return Tree(ids, np.frombuffer(terms, "<u8"), np.append(np.frombuffer(starts, "<i8"), size), ones.ravel(), size - ones[:, -1].astype(np.int64), ordered.ravel(), levels)


class Best:
    """The best documents of a query so far."""

    def __init__(self, top: int) -> None:
        self.top, self.scores, self.docs = top, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        s, d = np.append(self.scores, scores), np.append(self.docs, docs)
        order = np.lexsort((d, -s))[: self.top]
        self.scores, self.docs = s[order], d[order]

    def beatable(self, bounds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which nodes may hold a better document, by what they can score and their least id."""
        if len(self.scores) < self.top:
            return bounds > 0
        return (bounds > self.scores[-1]) | ((bounds == self.scores[-1]) & (first <= self.docs[-1]))


def search(tree: Tree, terms: np.ndarray, weights: np.ndarray, best: Best, split: int = SPLIT) -> int:
    """Puts the shard's documents that are among the best into ``best``; how many nodes were split."""
    at = np.minimum(np.searchsorted(tree.terms, terms), len(tree.terms) - 1)
    there = tree.terms[at] == terms
    begin, end, weight = tree.starts[at[there]], tree.starts[at[there] + 1], weights[there]
    if not len(begin):
        return 0
    size, done = tree.starts[-1], 0
    node_level, node_prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = np.array([(tree.impacts[begin] * weight).sum()])
    first, count = np.zeros(1, np.int64), np.array([len(begin)])
    while True:
        least = tree.docs[np.minimum(node_prefix << (tree.levels - node_level), len(tree.docs) - 1)]
        live = np.flatnonzero(best.beatable(bound, least))
        if not len(live):
            return done
        picked = live[np.argpartition(-bound[live], split - 1)[:split]] if len(live) > split else live
        done += len(picked)
        n = count[picked]
        edges = np.cumsum(n) - n
        of = np.repeat(np.arange(len(picked)), n)
        cell = np.arange(len(of)) - np.repeat(edges - first[picked], n)
        s, e, w, level = begin[cell], end[cell], weight[cell], np.repeat(node_level[picked], n)
        ones_s, ones_e = tree.ones[level * (size + 1) + s].astype(np.int64), tree.ones[level * (size + 1) + e].astype(np.int64)
        zeros = tree.zeros[level]
        s, e = np.concatenate([s - ones_s, zeros + ones_s]), np.concatenate([e - ones_e, zeros + ones_e])
        of, w, level = np.concatenate([2 * of, 2 * of + 1]), np.append(w, w), np.append(level, level) + 1
        some = np.flatnonzero(e > s)
        some = some[np.argsort(of[some], kind="stable")]
        s, e, w, level, of = s[some], e[some], w[some], level[some], of[some]
        n = np.bincount(of, minlength=2 * len(picked))
        child = np.flatnonzero(n)
        n = n[child]
        starts = np.cumsum(n) - n
        bounds = np.add.reduceat(tree.impacts[level * size + s] * w, starts)
        prefix, level = 2 * node_prefix[picked][child >> 1] + (child & 1), node_level[picked][child >> 1] + 1
        leaf = level == tree.levels
        if leaf.any():
            best.add(bounds[leaf], tree.docs[prefix[leaf]])
        # Nodes that were split are gone; their entries stay until the buffer is mostly theirs.
        keep = np.setdiff1d(live, picked, assume_unique=True)
        inner = ~leaf
        first = np.concatenate([first[keep], starts[inner] + len(begin)])
        begin, end, weight = np.append(begin, s), np.append(end, e), np.append(weight, w)
        node_level, node_prefix = np.append(node_level[keep], level[inner]), np.append(node_prefix[keep], prefix[inner])
        bound, count = np.append(bound[keep], bounds[inner]), np.append(count[keep], n[inner])
        if len(begin) > 4 * count.sum() + 4096:
            cell = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)
            begin, end, weight, first = begin[cell], end[cell], weight[cell], np.cumsum(count) - count


def searched(shards: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], top: int = TOP) -> DataFrame:
    """``q, doc_id, score``: the best ``top`` of each task's shards for each query, given as sorted terms and weights."""
    shared = shards.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in shared.value]
        for batch in batches:
            for k in range(len(batch)):
                tree = Tree.of(*(c[k].as_py() for c in batch.columns))
                for (terms, weights), b in zip(shared.value, best, strict=True):
                    search(tree, terms, weights, b)
        for q, b in enumerate(best):
            docs = pa.array([None if d == NO_ID else d for d in b.docs.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), q)), docs, pa.array(b.scores)], names=["q", "doc_id", "score"])

    return shards.mapInArrow(run, "q long, doc_id long, score long")


def query_terms(queries: DataFrame) -> DataFrame:
    """``item_id, term, n``: how often each query's terms occur in it, as 64-bit hashes."""
    schema = StructType([StructField("item_id", queries.schema["item_id"].dataType), StructField("term", LongType()), StructField("n", LongType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                terms, n = counts_of(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(terms), batch.schema.field(0).type), pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=schema.names)

    return queries.select("item_id", "text").mapInArrow(split, schema).groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = TOP, shard: int = SHARD, block_terms: int = QUERY_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each query's ``top`` documents with a score above 0, equal scores by ``doc_id``.

    ``queries`` has ``item_id, text``; rows with one ``item_id``, null too, are one
    query, their terms added up. Null texts have no terms; queries without terms
    or hits have no rows. Every row of ``docs`` is a document of its own, also if
    its id repeats; one without id comes last among equals. A term is known by 64
    bits of a hash. Empty tables give no rows; other columns are ignored. A very
    long text is one set of its terms in memory.
    """
    spark = docs.sparkSession
    asked = cut(query_terms(queries))
    blocks = max(1, math.ceil(asked.count() / block_terms))
    key = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    item = queries.schema["item_id"]
    found = None
    for block in range(blocks):
        rows = asked.filter(key == block).collect()  # about block_terms of them
        vocabulary = np.unique(np.array([r["term"] for r in rows], np.int64).view(np.uint64))
        counts = cut(counted(docs, vocabulary))
        all_docs, all_terms = counts.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(counts.select("terms").mapInArrow(holders, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
        weight = {t: math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df[t] + 1))) for t in df}
        of: dict[object, list[tuple[int, int]]] = {}
        for r, place in zip(rows, np.searchsorted(vocabulary, np.array([r["term"] for r in rows], np.int64).view(np.uint64)).tolist(), strict=True):
            if weight.get(place, 0) > 0:
                of.setdefault(r["item_id"], []).append((place, weight[place] * r["n"]))
        asks = [(np.array([p for p, _ in sorted(v)], np.uint64), np.array([w for _, w in sorted(v)], np.int64)) for v in of.values()]
        items = spark.createDataFrame(list(enumerate(of)), StructType([StructField("q", LongType()), StructField("item_id", item.dataType)]))
        hits = searched(indexed(counts, all_docs, all_terms, shard), asks, top).join(F.broadcast(items), "q").select("item_id", "doc_id", "score")
        found = hits if found is None else found.unionByName(hits)
        release(spark)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
q AS (
  SELECT item_id, t, count(*) AS n
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY ALL),
p AS (
  SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY t, n_docs),
s AS (
  SELECT item_id, doc_id, sum(q.n * f.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * p.n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN f USING (t), g GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
