"""Interpolated modified Kneser-Ney scoring of texts, with pairs of tokens.

The corpus is counted in Spark: tasks send sorted arrays of hashes with counts by
shard of the hash space (see ``hashes``), and each shard writes its totals as
sorted arrays into the shared folder. Workers map these files into memory and
look up the hashes of their texts; nothing of the model is on the driver but a
few totals, and no worker loads more than the pages that it touches.

Files by shard: ``count`` (word hash, count), ``word`` (of the same words: how
many words stand before it, and how many follow it once, twice, more often) and
``pair`` (hash of both words, count). Pairs are sharded by their first word, so
a shard sees all that follows a word. The commonest words are the exception:
their pairs are sharded by both words, and what follows them is added up.

A model needs a shared folder that is mounted as a path; others can't be mapped.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, cut, shared_folder, release
from .hashes import mixed, packed, runs, shard_of, shards_of, to_shards, unpacked, word_hashes

BASE_ADD = 0.1
#: Tokens hold no white space, so no token has these hashes by name.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(name)) for name in (b"\nstart", b"\nend"))
#: Tokens that a task gathers before it combines and sends them, and that it scores in one go.
GATHER, SCORED = 1 << 21, 1 << 19
#: The commonest words of each shard that may count as common to all.
COMMON_OF_SHARD = 256
#: A word is common if it is this many times rarer than what a shard holds on average, or less.
COMMON_SHARE = 4
SENT = "shard int, n long, first binary, second binary, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + mixed(second))


def save(folder: str, name: str, *columns: np.ndarray) -> None:
    """Arrays of one length one after another; a task that runs again writes the same file again."""
    own = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        for c in columns:
            out.write(c.astype("<u8").tobytes())
    os.replace(own, f"{folder}/{name}")


def mapped(folder: str, name: str, columns: int) -> np.ndarray:
    path = f"{folder}/{name}"
    if not os.path.getsize(path):
        return np.zeros((columns, 0), np.uint64)
    return np.memmap(path, "<u8", "r").reshape(columns, -1)


class Counts:
    """Counts below 2 ** 40 in 5 bytes each: most are 1, and pairs are by far the most of a model's entries."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.low[at].astype(np.uint64) | (self.high[at].astype(np.uint64) << np.uint64(32))


def save_pairs(folder: str, name: str, keys: np.ndarray, counts: np.ndarray) -> None:
    if len(counts) and int(counts.max()) >> 40:
        raise OverflowError("a pair of words is more frequent than the files can say")
    own = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        out.write(keys.astype("<u8").tobytes())
        out.write(counts.astype("<u4").tobytes())
        out.write((counts >> np.uint64(32)).astype(np.uint8).tobytes())
    os.replace(own, f"{folder}/{name}")


def mapped_pairs(folder: str, name: str) -> tuple[np.ndarray, Counts]:
    path = f"{folder}/{name}"
    n = os.path.getsize(path) // 13
    raw = np.memmap(path, np.uint8, "r") if n else np.zeros(0, np.uint8)
    return raw[: 8 * n].view("<u8"), Counts(raw[8 * n : 12 * n].view("<u4"), raw[12 * n :])


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted ``keys`` hold each one wanted, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def pair_shards(first: np.ndarray, second: np.ndarray, common: np.ndarray, shards: int) -> np.ndarray:
    return np.where(find(common, first)[1], shard_of(pair_hash(first, second), shards), shard_of(first, shards))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """From how many have a count of 1, 2, 3 and 4; where the estimate fails, half of the count or the usual 0.75 at most."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0
        out.append(d if 0.0 < d < k else min(0.75, k / 2))
    return tuple(out)


def discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array((0.0, *d))[np.minimum(counts, 3).astype(np.int64)]


def sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = runs(keys)
    return (keys[start], *(np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values))


def count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class KneserNey:
    folder: str
    shards: int
    train_tokens: int = 0
    train_docs: int = 0
    types: int = 0
    pairs: int = 0
    common: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    #: What follows the start of a text: once, twice, more often.
    start_follows: tuple = (0, 0, 0)
    pair_discounts: tuple = (0.75, 0.75, 0.75)
    word_discounts: tuple = (0.75, 0.75, 0.75)
    #: Words that this many others stand before: one, two, more.
    preceded: tuple = (0, 0, 0)
    _files: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_files": {}}

    def file(self, name: str, columns: int) -> np.ndarray | tuple:
        if name not in self._files:
            self._files[name] = mapped_pairs(self.folder, name) if name.startswith("pair-") else mapped(self.folder, name, columns)
        return self._files[name]

    def look_up(self, kind: str, columns: int, keys: np.ndarray, shard: np.ndarray, others: tuple[str, int] | None = None) -> list[np.ndarray]:
        """All columns but the key of what the files have of ``keys``, 0 where they have none. ``others``: a file aligned with the first."""
        width = columns - 1 + (others[1] if others else 0)
        out = [np.zeros(len(keys), np.uint64) for _ in range(width)]
        order = np.lexsort((keys, shard))
        ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            mine = order[ends[k] : ends[k + 1]]
            table = self.file(f"{kind}-{k}", columns)
            at, there = find(table[0], keys[mine])
            got = [*table[1:], *(self.file(f"{others[0]}-{k}", others[1]) if others else ())]
            for column, values in zip(out, got, strict=True):
                if there.any():
                    column[mine[there]] = values[at[there]]
        return out

    def score(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """``n_tokens, n_known, base_score, score`` of each text."""
        words = [np.append(word_hashes(tokens_of(t)), END) for t in texts]
        sizes = [len(w) for w in words]
        second = np.concatenate(words)
        begins = np.cumsum([0, *sizes[:-1]])
        first = np.roll(second, 1)
        first[begins] = START
        known, back = np.unique(second, return_inverse=True)
        counts, before, once, twice, more = (c.astype(np.float64) for c in self.look_up("count", 2, known, shard_of(known, self.shards), ("word", 4)))
        vocabulary = self.types + 1
        base = np.log10((counts + BASE_ADD) / (self.train_tokens + BASE_ADD * vocabulary))
        if self.pairs:
            spare = sum(d * n for d, n in zip(self.word_discounts, self.preceded, strict=True)) / self.pairs
            lower = (before - discount(before, self.word_discounts)) / self.pairs + spare / vocabulary
        else:
            lower = np.full(len(known), 1.0 / vocabulary)
        # The context of each place is the word before it.
        d1, d2, d3 = self.pair_discounts
        spared, seen = d1 * once + d2 * twice + d3 * more, counts
        begin = sum(d * n for d, n in zip(self.pair_discounts, self.start_follows, strict=True)), float(self.train_docs)
        at = np.roll(back, 1)
        rest, total = spared[at], seen[at]
        rest[begins], total[begins] = begin
        key, inverse = np.unique(pair_hash(first, second), return_index=True, return_inverse=True)[1:]
        pairs = self.look_up("pair", 2, pair_hash(first[key], second[key]), pair_shards(first[key], second[key], self.common, self.shards))[0]
        pairs = pairs[inverse].astype(np.float64)
        low = lower[back]
        with np.errstate(divide="ignore", invalid="ignore"):
            chance = np.where(total > 0, (pairs - discount(pairs, self.pair_discounts) + rest * low) / total, low)
        logs = np.log10(chance)
        return list(
            zip(
                sizes,
                np.add.reduceat((counts[back] > 0).astype(np.int64), begins).tolist(),
                np.add.reduceat(base[back], begins).tolist(),
                np.add.reduceat(logs, begins).tolist(),
                strict=True,
            )
        )

    def delete(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def model_folder(spark) -> str:
    where = shared_folder(spark)
    path = where.removeprefix("file://") if where.startswith("file://") else where.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"a model is mapped into memory and needs a mounted folder; spark.checkpoint.dir is {where}")
    folder = f"{path}/language-model-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def rows_by_shard(shards: int, shard: np.ndarray, first: np.ndarray, second: np.ndarray | None, counts: list[np.ndarray]) -> pa.RecordBatch:
    """``first`` sorted within each shard; the columns of counts one after another."""
    ends = np.searchsorted(shard, np.arange(shards + 1))
    out = []
    for k in np.flatnonzero(np.diff(ends)).tolist():
        a, b = int(ends[k]), int(ends[k + 1])
        out.append((k, b - a, packed(first[a:b], True), packed(second[a:b]) if second is not None else None, b"".join(packed(c[a:b]) for c in counts)))
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "n", "first", "second", "counts"])


def received(batches: Iterator[pa.RecordBatch], columns: int, pairs: bool = False) -> tuple[np.ndarray, ...]:
    """The arrays of all rows of a shard: first, second if ``pairs``, columns of counts."""
    parts = [[np.empty(0, np.uint64)] * (1 + pairs + columns)]
    for batch in batches:
        for row in batch.to_pylist():
            size = 8 * row["n"]
            parts.append(
                [unpacked(row["first"], True), *([unpacked(row["second"])] if pairs else []), *(unpacked(row["counts"][i * size : (i + 1) * size]) for i in range(columns))]
            )
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The texts' hashes, each text's END with them, about ``GATHER`` at a time."""
    held, n = [], 0
    for batch in batches:
        for text in batch.column(0):
            words = np.append(word_hashes(tokens_of(text.as_py())), END)
            held.append(words)
            n += len(words)
            if n >= GATHER:
                yield held
                held, n = [], 0
    if held:
        yield held


def train(docs: DataFrame) -> KneserNey:
    """A model of all rows of ``docs`` (null text: empty), whatever else they hold. Its files go if training fails."""
    model = KneserNey(model_folder(docs.sparkSession), shards_of(docs.sparkSession))
    try:
        return trained(model, docs)
    except BaseException:
        model.delete()
        raise


def trained(model: KneserNey, docs: DataFrame) -> KneserNey:
    spark, shards, folder = docs.sparkSession, model.shards, model.folder
    texts = docs.select("text")
    every = spark.range(0, shards, 1, shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("first"), F.lit(b"").alias("second"), F.lit(b"").alias("counts"))

    def by_shard(sent: DataFrame) -> DataFrame:
        """Each shard gets a row at least, so that each writes its files."""
        return to_shards(sent.unionByName(every), shards)

    def send_words(batches):
        for held in gathered(batches):
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            yield rows_by_shard(shards, shard_of(words, shards), words, None, [counts])

    def write_words(batches):
        # A partition holds one shard; its number comes with its rows.
        first = next(batches, None)
        if first is None:
            return
        k = first.column(0)[0].as_py()
        words, counts = sum_by(*received(chained(first, batches), 1))
        save(folder, f"count-{k}", words, counts)
        top = np.argsort(-counts.astype(np.int64), kind="stable")[:COMMON_OF_SHARD]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(counts.sum())]), pa.array([len(words)]), pa.array([words[top].tobytes()]), pa.array([counts[top].tobytes()])], names=["tokens", "types", "words", "counts"]
        )

    rows = by_shard(texts.mapInArrow(send_words, SENT)).mapInArrow(write_words, "tokens long, types long, words binary, counts binary").collect()
    model.train_tokens, model.types = sum(r[0] for r in rows), sum(r[1] for r in rows)
    words, counts = (np.concatenate([np.frombuffer(r[i], np.uint64) for r in rows]) for i in (2, 3))
    often = counts.astype(np.float64) * COMMON_SHARE * shards >= max(1, model.train_tokens)
    model.common = common = np.sort(np.append(words[often], START))
    ends = counts[words == END]
    model.train_docs = int(ends[0]) if len(ends) else docs.count()
    release(spark)

    def send_pairs(batches):
        for held in gathered(batches):
            second = np.concatenate(held)
            first = np.roll(second, 1)
            first[np.cumsum([0, *map(len, held[:-1])])] = START
            known, back = np.unique(np.concatenate([first, second]), return_inverse=True)
            key, counts = np.unique(back[: len(first)] * len(known) + back[len(first) :], return_counts=True)
            first, second = known[key // len(known)], known[key % len(known)]
            shard = pair_shards(first, second, common, shards)
            order = np.argsort(shard, kind="stable")
            yield rows_by_shard(shards, shard[order], first[order], second[order], [counts[order]])

    def write_pairs(batches):
        head = next(batches, None)
        if head is None:
            return
        k = head.column(0)[0].as_py()
        first, second, counts = received(chained(head, batches), 1, pairs=True)
        order = np.lexsort((second, first))
        first, second, counts = first[order], second[order], counts[order]
        start = runs(first, second)
        first, second, counts = first[start], second[start], (np.add.reduceat(counts, start) if len(start) else counts)
        key = pair_hash(first, second)
        order = np.argsort(key)
        save_pairs(folder, f"pair-{k}", key[order], counts[order])
        follows = [(counts == 1).astype(np.uint64), (counts == 2).astype(np.uint64), (counts > 2).astype(np.uint64)]
        none = np.zeros(len(first), np.uint64)
        at_start = first == START
        one = np.ones(len(second), np.uint64)
        words = np.concatenate([second, first[~at_start]])
        columns = [np.concatenate([one, none[~at_start]]), *(np.concatenate([none, f[~at_start]]) for f in follows)]
        words, *columns = sum_by(words, *columns)
        sent = rows_by_shard(shards, shard_of(words, shards), words, None, columns)
        facts = np.array([*count_of_counts(counts), *(int(f[at_start].sum()) for f in follows), len(counts)], np.uint64)
        yield sent
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([b""]), pa.array([facts.tobytes()]), pa.array([b""])], names=["shard", "n", "first", "second", "counts"]
        )

    stats = cut(by_shard(texts.mapInArrow(send_pairs, SENT)).mapInArrow(write_pairs, SENT))
    release(spark)
    facts = sum((np.frombuffer(r[0], np.uint64).astype(np.int64) for r in stats.filter("shard = -1").select("second").collect()), np.zeros(8, np.int64)).tolist()
    model.pair_discounts, model.start_follows, model.pairs = discounts(facts[:4]), tuple(facts[4:7]), facts[7]

    def write_stats(batches):
        head = next(batches, None)
        if head is None:
            return
        k = head.column(0)[0].as_py()
        words, *columns = sum_by(*received(chained(head, batches), 4))
        there = mapped(folder, f"count-{k}", 2)[0]
        full = [np.zeros(len(there), np.uint64) for _ in columns]
        at, known = find(there, words)
        for f, c in zip(full, columns, strict=True):
            f[at[known]] = c[known]
        save(folder, f"word-{k}", *full)
        before = full[0]
        facts = [*count_of_counts(before), int((before > 2).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()) for f in facts], names=["n1", "n2", "n3", "n4", "more"])

    rows = by_shard(stats.filter("shard >= 0")).mapInArrow(write_stats, "n1 long, n2 long, n3 long, n4 long, more long").collect()
    total = [sum(r[i] for r in rows) for i in range(5)]
    model.word_discounts, model.preceded = discounts(total[:4]), (total[0], total[1], total[4])
    release(spark)
    return model


def chained(first, rest):
    yield first
    yield from rest


def score_texts(docs: DataFrame, model: KneserNey) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    Tokens are the words of the text in lower case (A-Z) and one end. ``score``
    is the model's log10 probability of all of them, ``base_score`` that of the
    tokens by themselves with additive smoothing; ``perplexity`` is of ``score``.
    Words and pairs are equal if their 64-bit hashes are.
    Null text is empty: its only token is the end. Without any training text
    all tokens are equally likely. A null ``doc_id`` is not held out; repeated
    rows get equal scores; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            first, size, texts = 0, 0, []
            for i, text in enumerate(batch.column(2).to_pylist()):
                texts.append(text)
                size += len(text or "") // 5 + 1
                if size >= SCORED or i == len(batch) - 1:
                    n, there, base, score = zip(*known.score(texts), strict=True)
                    part = batch.slice(first, len(texts))
                    perplexity = [10.0 ** min(-s / k, 300.0) for s, k in zip(score, n, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(n), pa.array(there), pa.array([known.train_tokens] * len(n)), pa.array(base), pa.array(score), pa.array(perplexity)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                    )
                    first, size, texts = i + 1, 0, []

    held_out = F.coalesce(crc_fold(F.col("doc_id"), 10) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(judge, SCORES)


def score_corpus(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out; its files go when the scores are there."""
    model = train(docs.filter(crc_fold(F.col("doc_id"), 10) != 0))
    try:
        return cut(score_texts(docs, model))
    finally:
        model.delete()
