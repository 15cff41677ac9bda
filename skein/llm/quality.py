"""Quality classifier on supervised subword embeddings.

A document is the average of the vectors of its features: hashed words, hashed
character n-grams of each word, and hashed pairs of adjacent words. A pair of
equal words is hashed without the word besides, as a word that is repeated over
and over says the same whatever the word is. A softmax over two classes stands on
the average. Vectors and output are learned together by stochastic gradient
descent in numpy on a bounded sample of labelled documents, each of them whole.

The output is linear in the average, so scoring needs one number per feature:
the difference that its vector makes to the two classes. Features are hashed for
many texts at once from their code points; nothing is remembered between texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, kept_rows

BUCKETS, DIM, NGRAMS = 1 << 15, 16, (3, 4)
EPOCHS, RATE, SEED = 5, 1.0, 7
#: The sample that is learned from: labelled documents, the first in the order of a hash of their ids.
SAMPLE_DOCS = 2000
#: Code points that are hashed at once: some hundred bytes of arrays each.
AT_ONCE = 1 << 18
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_WORD, _GRAM, _PAIR, _MIX = (np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9))
_SPACE = re.compile(r"\s")
#: Beyond U+3000, the last white space, all is as the last entry.
_IS_SPACE = np.array([chr(i).isspace() for i in range(0x3002)])


def bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _MIX
    return ((mixed >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


#: The bucket of a pair of equal words.
EQUAL = int(bucket(np.array([_PAIR]))[0])


def pieces(texts: Sequence[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts, longer ones cut at white space, about ``AT_ONCE`` code points at a time, and which text each is of."""
    held, of, size = [], [], 0
    for i, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            end = at + AT_ONCE - size
            if end < len(text):
                space = _SPACE.search(text, end)
                end = space.start() if space else len(text)
            held.append(text[at:end])
            of.append(i)
            size += end - at
            at = end
            if size >= AT_ONCE:
                yield held, of
                held, of, size = [], [], 0
    if held:
        yield held, of


def hashed_features(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of features, repeats included, and the number of the text that each is of, in parts."""
    last_text, last_word = -1, np.uint64(0)
    for held, of in pieces(texts):
        points = np.frombuffer("\n".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        text_of = np.repeat(np.array(of), np.array([len(t) + 1 for t in held]))[: len(points)]
        seen = ~_IS_SPACE[np.minimum(points, len(_IS_SPACE) - 1)]
        begins = seen & ~np.append(False, seen[:-1])
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        word_text = text_of[starts]
        word_of = (np.cumsum(begins) - 1)[seen]
        # Each word between marks: two more code points.
        sizes = np.bincount(word_of, minlength=len(starts)) + 2
        edges = np.append(0, np.cumsum(sizes))
        marked = np.full(edges[-1], ord(">"), np.uint64)
        marked[edges[:-1]] = ord("<")
        marked[np.arange(len(word_of)) + 2 * word_of + 1] = points[seen]
        place = np.repeat(np.arange(len(sizes)), sizes)
        powers = np.cumprod(np.append(np.uint64(1), np.full(int(sizes.max()) - 1, _WORD)))
        words = np.add.reduceat(marked * powers[np.arange(len(marked)) - edges[place]], edges[:-1])
        yield bucket(words), word_text
        for n in NGRAMS:
            ends = len(marked) - n + 1
            if ends > 0:
                gram = np.full(ends, np.uint64(n))
                for j in range(n):
                    gram = gram * _GRAM + marked[j : j + ends]
                inside = place[:ends] == place[n - 1 :]
                yield bucket(gram[inside]), word_text[place[:ends][inside]]
        first, before = np.append(last_word, words[:-1]), np.append(last_text, word_text[:-1])
        beside = before == word_text
        first, second = first[beside], words[beside]
        yield bucket(first * _PAIR + second), word_text[beside]
        same = word_text[beside][first == second]
        yield np.full(len(same), EQUAL), same
        last_text, last_word = word_text[-1], words[-1]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's buckets and how often it has each."""
    total = np.zeros(BUCKETS, np.int64)
    for buckets, _ in hashed_features([text]):
        total += np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class QualityModel:
    """``gain``: by bucket, what it adds to the log odds of class 1 before averaging; ``bias`` is added once."""

    gain: np.ndarray
    bias: float

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, of in hashed_features(texts):
            total += np.bincount(of, self.gain[buckets], len(texts))
            n += np.bincount(of, minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -500, 500)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """From the :func:`features` of texts: gradient descent, one document a step, at a rate that falls to nothing."""
    if not bags or len(set(labels)) < 2:
        sure = 0.0 if not labels else (4.0 if labels[0] else -4.0)
        return QualityModel(np.zeros(BUCKETS), sure)
    dice = np.random.default_rng(seed)
    vectors = dice.uniform(-1.0 / DIM, 1.0 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((2, DIM)), np.zeros(2)
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in dice.permutation(len(bags)):
            now = rate * (1.0 - step / steps)
            step += 1
            at, back, d_out, d_bias = gradient(vectors, out, bias, *bags[i], labels[i])
            out -= now * d_out
            bias -= now * d_bias
            # A step of an average over many features moves each of them little; by the root of their number more evens that out.
            vectors[at] -= now * len(at) ** 0.5 * back
    return QualityModel(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def gradient(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, at: np.ndarray, counts: np.ndarray, label: int) -> tuple:
    """Of the negative log likelihood of one document: the buckets, and the derivatives by their vectors, by ``out`` and by ``bias``."""
    share = (counts / counts.sum())[:, None] if len(at) else np.zeros((0, 1))
    hidden = (vectors[at] * share).sum(axis=0)
    odds = out @ hidden + bias
    odds = np.exp(odds - odds.max())
    miss = odds / odds.sum()
    miss[label] -= 1.0
    return at, share * (miss @ out), np.outer(miss, hidden), miss


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """Learns from labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    The sample is the first ``sample_docs`` labels in the order of a hash of
    ``doc_id``: a bound that also lets it be broadcast to the documents, and the
    rows that meet it are held to it once more, as ids may repeat. Labels other
    than 0 and 1, and labels of documents that have no text, teach nothing. Whole
    texts become features where they are; the driver gets these only, a bucket
    at most once for a document.
    """
    drawn = (
        labels.filter((crc_fold(F.col("doc_id"), 3) != 1) & F.col("quality").isin(0, 1))
        .select(F.col("doc_id").alias("x_id"), F.col("quality").cast("int").alias("x_label"), F.xxhash64(F.col("doc_id"), F.lit("quality")).alias("x_at"))
        .orderBy("x_at", "x_id", "x_label")
        .limit(sample_docs)
    )
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("x_id"), F.col("text").alias("x_text"))
    rows = texts.join(F.broadcast(drawn), "x_id").select("x_at", "x_id", "x_label", "x_text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                at, counts = features(batch.column(3)[i].as_py())
                own = [pa.array([at.astype("<u2").tobytes()]), pa.array([counts.astype("<u4").tobytes()])]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:3]), *own], names=["x_at", "x_id", "x_label", "at", "counts"])

    bags = rows.mapInArrow(hashed, "x_at long, x_id long, x_label int, at binary, counts binary").orderBy("x_at", "x_id", "x_label", "at").limit(sample_docs).collect()
    return fit([(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64)) for r in bags], [r["x_label"] for r in bags])


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    The whole text is scored and nothing else of the row. Null and empty texts
    have no features: they get the score of the output's bias. Without labels, or
    with labels of one class only, all texts get one score. A null ``doc_id`` is
    never held out. Repeated rows and other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    held_out = F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` without the rows that the model takes for class 0; all columns stay, and nothing is shuffled.

    A text without features, null among them, stays if the output's bias is for
    class 1; rows are judged one by one, so repeated ones stay or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: shared.value.scores(texts) >= 0.5)
