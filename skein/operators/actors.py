"""Actors: who is named in a text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.keys import event_key
from ..functions.text import fold, squeeze, tokenize, words, worked_out

# Letters that a name may begin with, what may follow, small words inside names, and those of them that join two names.
CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÑ")
INSIDE = CAPITALS | frozenset("abcdefghijklmnopqrstuvwxyzáéíóúñ0123456789&-")
LINKS = frozenset("de del la las los y e and of the for to in".split())
JOINERS = frozenset(("and", "y", "e"))
#: Words of a name at most, and its characters.
MOST_WORDS, CHARACTERS = 6, (4, 90)
FOUND = "array<struct<name: string, weight: int>>"


def acronyms(text: str) -> Iterator[str]:
    """Words of capitals, and such a word with a hyphen and a second one of capitals and digits."""
    last = None
    for m in re.finditer(r"\w+", text):
        if last and last.end() + 1 == m.start() and text[last.end()] == "-" and all(c in CAPITALS or c in "0123456789" for c in m[0]):
            yield f"{last[0]}-{m[0]}"
            last = None
            continue
        if last:
            yield last[0]
        last = m if len(m[0]) > 1 and CAPITALS.issuperset(m[0]) else None
    if last:
        yield last[0]


def leading(chunk: str) -> str:
    """The start of a chunk that can be part of a name; nothing if a letter of another alphabet follows it."""
    n = next((i for i, c in enumerate(chunk) if c not in INSIDE), len(chunk))
    return "" if n < len(chunk) and (chunk[n].isalnum() or chunk[n] == "_") else chunk[:n]


def opening(chunk: str) -> str:
    """The end of a chunk that can be the first word of a name: it begins with a capital, and at a boundary."""
    at = len(chunk)
    while at and chunk[at - 1] in INSIDE:
        at -= 1
    whole = not (at and (chunk[at - 1].isalnum() or chunk[at - 1] == "_"))
    for i in range(at, len(chunk) - 1):
        if chunk[i] in CAPITALS and (whole if i == at else chunk[i - 1] in "-&"):
            return chunk[i:]
    return ""


def finished(run: list[tuple[str, str]]) -> Iterator[str]:
    """The names in a run of ``small word before, word``: those that a joiner stands between are apart."""
    while run and len(run[-1][1].rstrip("-&")) < 2:
        run = run[:-1]
    if len(run) < 2:
        return
    run = [*run[:-1], (run[-1][0], run[-1][1].rstrip("-&"))]
    parts: list[list[str]] = [[]]
    for link, word in run:
        if link in JOINERS:
            parts.append([])
        elif link:
            parts[-1].append(link)
        parts[-1].append(word)
    yield from map(" ".join, parts)


def capitalised(text: str) -> Iterator[str]:
    """Names of two capitalised words and more, small words between them, nothing but white space else."""
    run: list[tuple[str, str]] = []
    link = ""
    for chunk in text.split():
        if run and not link and chunk in LINKS:
            link = chunk
            continue
        head = leading(chunk) if run else ""
        if len(head) > 1 and head[0] in CAPITALS:
            run.append((link, head))
            link, chunk = "", chunk[len(head) :]
            if not chunk and len(run) < MOST_WORDS:
                continue
        yield from finished(run)
        first = opening(chunk)
        run, link = [("", first)] if first else [], ""
    yield from finished(run)


def candidates(text: str) -> list[tuple[str, int]]:
    """Names and how much each counts, in the order in which they are first met: acronyms, twice as much, before others."""
    weights: Counter[str] = Counter()
    for name in acronyms(text):
        weights[name] += 2
    for name in capitalised(text):
        if name.split(" ", 1)[0] not in lexicon.GENERIC_ACTORS and CHARACTERS[0] <= len(name) <= CHARACTERS[1]:
            weights[name] += 1
    return list(weights.items())


def no_actor(name: Column, noise: Sequence[str] = lexicon.ACTOR_NOISE, phrases: Sequence[str] = lexicon.ACTOR_NOISE_PHRASES, stopwords: Sequence[str] = lexicon.STOPWORDS) -> Column:
    """Whether a capitalised phrase names nobody: by its folded form, by the words in it that mean something, by its shape."""
    folded = squeeze(F.regexp_replace(fold(name), r"[^a-z0-9\s:_-]", " "))
    meaning = tokenize(squeeze(name), stopwords)
    known_short = folded.isin(*lexicon.SHORT_ACTORS)
    by_form = [folded == "", folded.rlike("^source[: ]"), folded.isin(*noise), *[F.contains(folded, F.lit(p)) for p in phrases], name.isin(*lexicon.GENERIC_ACTORS)]
    only = F.get(meaning, F.lit(0))
    by_words = [(F.size(meaning) == 0) & ~known_short, F.arrays_overlap(meaning, words(noise)), (F.size(meaning) == 1) & ~only.isin(*lexicon.SHORT_ACTORS)]
    by_shape = [(F.upper(name) == name) & (F.lower(name) != name) & (F.length(name) <= 8) & ~known_short]
    out = F.lit(False)
    for rule in (*by_form, *by_words, *by_shape):
        out = out | rule
    return out


def actors(records: DataFrame, most: int = 10, noise: Sequence[str] = lexicon.ACTOR_NOISE, phrases: Sequence[str] = lexicon.ACTOR_NOISE_PHRASES) -> DataFrame:
    """``ord, doc_key, actors``: up to ``most`` names of each record, by weight, of equal ones the first met. Null texts have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("weight", pa.int32())]))
        for batch in batches:
            found = [[{"name": n, "weight": w} for n, w in candidates(t.as_py() or "")] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["ord", "doc_key", "x_found"])

    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text_clean", F.lit("")))
    rows = records.select(F.col("ord").cast("long"), event_key().alias("doc_key"), text.alias("t")).mapInArrow(find, f"ord long, doc_key string, x_found {FOUND}")
    placed = F.transform("x_found", lambda x, i: F.struct((-x["weight"]).alias("w"), i.alias("i"), x["name"].alias("name")))
    rows = worked_out(rows, x_kept=F.filter(placed, lambda x: ~no_actor(x["name"], noise, phrases)))
    return rows.select("ord", "doc_key", F.transform(F.slice(F.array_sort("x_kept"), 1, most), lambda x: x["name"]).alias("actors"))


def actor_counts(found: DataFrame, limit: int = 50) -> DataFrame:
    """Documents that name each actor, the first met of equals first."""
    rows = found.select("ord", F.posexplode("actors").alias("p", "actor"))
    return rows.groupBy("actor").agg(F.count(F.lit(1)).alias("documents"), F.min(F.struct("ord", "p")).alias("f")).orderBy(F.desc("documents"), "f").limit(limit).select("actor", "documents")


def apply_validations(events: DataFrame, validations: DataFrame) -> DataFrame:
    """Actors as people have corrected them, by ``doc_key``; others stay as found. Of several validations the last by time counts."""
    last = validations.groupBy("doc_key").agg(F.max_by(F.struct("validated_actors", "status", "validator"), "validated_at").alias("v"))
    known = F.col("v").isNotNull() & (F.size(F.coalesce("v.validated_actors", F.array().cast("array<string>"))) > 0)
    corrected = {"actors": F.when(known, F.col("v.validated_actors")).otherwise(F.col("actors")), "actor_status": F.coalesce("v.status", F.lit("automatic"))}
    return events.join(last, "doc_key", "left").withColumns(corrected).drop("v")
