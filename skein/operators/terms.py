"""Terms, n-grams, dictionaries and matrices."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import record_text
from ..functions.text import count_words, ngrams, tokenize, worked_out
from ..storage import cut


#: Buckets that n-grams are counted by before any is told from others of its bucket. A task sends a number for each at most.
BUCKETS = 1 << 20
#: Buckets for each place that first give a bound.
FIRST = 8


def gram_rows(records: DataFrame, n: int = 1, stopwords: Sequence[str] = ()) -> DataFrame:
    """``ord, pos, term`` of n-grams."""
    return records.select("ord", F.posexplode(ngrams(tokenize(record_text(), stopwords), n)).alias("pos", "term"))


def tokens_kept(records: DataFrame, stopwords: Sequence[str] = ()) -> DataFrame:
    """``ord`` and the tokens as one text, kept: several counts need them, and making them costs more than reading them."""
    return cut(records.select("ord", F.array_join(tokenize(record_text(), stopwords), " ").alias("x_kept")))


def kept_grams(kept: DataFrame, n: int) -> DataFrame:
    """:func:`gram_rows` of :func:`tokens_kept`."""
    return kept.select("ord", F.posexplode(ngrams(F.filter(F.split("x_kept", " "), lambda t: t != ""), n)).alias("pos", "term"))


def counted(grams: DataFrame) -> DataFrame:
    """``term, count`` and where each stood first. The place is a number, so the aggregation stays in hashed memory."""
    place = F.col("ord").cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col("pos")
    return grams.groupBy("term").agg(F.count(F.lit(1)).alias("count"), F.min(place.cast("decimal(31,0)")).alias("x_first"))


def repeated_grams(kept: DataFrame, n: int, least: int = 2) -> DataFrame:
    """``term, count`` of all n-grams of :func:`tokens_kept` that stand ``least`` times."""
    return kept_grams(kept, n).groupBy("term").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)


def term_counts(records: DataFrame, n: int = 1, stopwords: Sequence[str] = ()) -> DataFrame:
    """:func:`counted` n-grams, all of them."""
    return counted(gram_rows(records, n, stopwords))


def commonest(records: DataFrame, n: int, limit: int, stopwords: Sequence[str] = (), kept: DataFrame | None = None) -> DataFrame:
    """``term, count, x_first`` of the ``limit`` commonest n-grams, of equal ones the one that stood first; kept.

    Most n-grams stand once or twice, so they aren't shuffled. They are counted by
    buckets of a hash. The n-grams of the heaviest buckets are counted in full: the
    count of the last of their ``limit`` commonest bounds that of all from below. No
    n-gram of a bucket with a lesser total can be among the commonest; all others
    are counted in full. Words are few, and are counted at once.
    """
    order = F.desc("count"), F.col("x_first")
    if n == 1:
        return cut(counted(kept_grams(kept, n) if kept is not None else gram_rows(records, n, stopwords)).orderBy(*order).limit(limit))
    keyed = kept_grams(tokens_kept(records, stopwords) if kept is None else kept, n).withColumn("x_bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    totals = cut(keyed.groupBy("x_bucket").agg(F.count(F.lit(1)).alias("x_total")))

    def within(buckets: DataFrame) -> DataFrame:
        return counted(keyed.join(F.broadcast(buckets.select("x_bucket")), "x_bucket", "left_semi"))

    first = within(totals.orderBy(F.desc("x_total"), "x_bucket").limit(FIRST * limit)).orderBy(*order).limit(limit).select("count").collect()
    least = min(r["count"] for r in first) if len(first) == limit else 1
    return cut(within(totals.filter(F.col("x_total") >= least)).orderBy(*order).limit(limit))


def top_terms(records: DataFrame, n: int = 1, limit: int = 30, least: int = 1, stopwords: Sequence[str] = ()) -> DataFrame:
    """The ``limit`` commonest n-grams, of equal ones the one that stood first; only then those below ``least`` go."""
    return commonest(records, n, limit, stopwords).orderBy(F.desc("count"), "x_first").filter(F.col("count") >= least).select("term", "count")


def term_shares(records: DataFrame, limit: int = 30, stopwords: Sequence[str] = ()) -> DataFrame:
    """The top terms with their share of all that are listed, and the running share."""
    from .aggregate import ranked_shares

    top = top_terms(records, 1, limit, 1, stopwords)
    return ranked_shares(top, "count", [F.desc("count"), F.col("term")], 0.8).select("term", "count", "rank", "weight_share", "cumulative_weight_share", "core")


def stopword_candidates(records: DataFrame, limit: int = 50, stopwords: Sequence[str] = ()) -> DataFrame:
    """Common tokens that no list has yet."""
    top = commonest(records, 1, 3 * limit)
    fresh = top.filter(~F.col("term").isin(*stopwords) & (F.col("count") >= 3)) if stopwords else top.filter("count >= 3")
    return fresh.orderBy(F.desc("count"), "x_first").limit(limit).select("term", F.col("count").alias("raw_count"))


def mentions(records: DataFrame, groups: Mapping[str, Sequence[str]], *keep: str) -> DataFrame:
    """``keep`` and ``hits``: an array of the word-bounded mentions of each term of each group, in their order."""
    rows = worked_out(records.select(*keep, record_text().alias("x_text")), x_low=F.lower("x_text"))
    terms = [t for ts in groups.values() for t in ts]
    return worked_out(rows, hits=count_words(F.col("x_low"), terms)).select(*keep, "hits")


def group_counts(records: DataFrame, groups: Mapping[str, Sequence[str]], by: Sequence[str] = (), top: int = 5) -> DataFrame:
    """Mentions of each group, documents that have one, their share, and the commonest terms.

    One aggregation over one scan: each record gives a row for each group and one
    for each of its terms that it has. What is left is as small as the dictionary.
    """
    each, at = [], 0
    for g, terms in groups.items():
        own = [F.struct(F.lit(g).alias("group"), F.lit(i).alias("place"), F.lit(t).alias("term"), F.get("hits", F.lit(at + i)).alias("n")) for i, t in enumerate(terms)]
        total = sum((x["n"] for x in own), F.lit(0))
        each += [F.struct(F.lit(g).alias("group"), F.lit(-1).alias("place"), F.lit("").alias("term"), total.alias("n")), *own]
        at += len(terms)
    rows = mentions(records, groups, *by).select(*by, F.explode(F.filter(F.array(*each), lambda x: (x["n"] > 0) | (x["place"] < 0))).alias("x"))
    sums = rows.groupBy(*by, "x.group", "x.place", "x.term").agg(F.sum("x.n").alias("n"), F.count_if(F.col("x.n") > 0).alias("with"), F.count(F.lit(1)).alias("documents"))
    whole = F.col("place") < 0
    best = F.slice(F.array_sort(F.collect_list(F.when(~whole, F.struct((-F.col("n")).alias("n"), "place", "term")))), 1, top)
    return sums.groupBy(*by, "group").agg(
        F.max(F.when(whole, F.col("n"))).alias("keyword_hits"),
        F.max(F.when(whole, F.col("with"))).alias("documents_with_group"),
        F.round(F.max(F.when(whole, F.col("with"))) / F.greatest(F.lit(1), F.max(F.when(whole, F.col("documents")))), 4).alias("document_share"),
        F.array_join(F.transform(best, lambda x: x["term"]), ", ").alias("top_terms"),
    )


def group_matrix(records: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """A column of mentions for each group and record."""
    ends = [0]
    for terms in groups.values():
        ends.append(ends[-1] + len(terms))
    found = mentions(records, groups, "ord")
    return found.select("ord", *[sum((F.get("hits", F.lit(i)) for i in range(a, b)), F.lit(0)).cast("int").alias(g) for g, a, b in zip(groups, ends, ends[1:], strict=False)])


def dimension_matrix(records: DataFrame, dimension: str, limit: int = 20, n: int = 1, stopwords: Sequence[str] = ()) -> DataFrame:
    """Counts of the commonest n-grams by value of a dimension, with their share of the largest count and of the value's total."""
    vocabulary = top_terms(records, n, limit, 1, stopwords).select("term")
    grams = records.select(F.col(dimension).alias("dimension"), F.explode(ngrams(tokenize(record_text(), stopwords), n)).alias("term"))
    counts = grams.groupBy("dimension", "term").agg(F.count(F.lit(1)).alias("count")).join(vocabulary, "term")
    all_rows, own = Window.partitionBy(F.lit(0)), Window.partitionBy("dimension")
    return counts.select(
        "dimension", "term", "count",
        F.round(F.col("count") / F.max("count").over(all_rows), 6).alias("global_share"),
        F.round(F.col("count") / F.sum("count").over(own), 6).alias("dimension_share"),
    )


def repeated_phrases(records: DataFrame, limit: int = 30, least: int = 2, stopwords: Sequence[str] = (), absorb: float = 0.8) -> DataFrame:
    """Phrases of the corpus, and the smaller n-grams that they explain.

    The commonest trigrams and bigrams are the phrases. A bigram or a word is
    absorbed by the first phrase, longest and commonest first, that holds it and
    has at least ``absorb`` of its count. An absorbed bigram that is a phrase
    itself is listed both ways.
    """
    kept = tokens_kept(records, stopwords)
    top = {n: commonest(records, n, limit, stopwords, kept).filter(F.col("count") >= least) for n in (1, 2, 3)}
    names = {1: "monogram", 2: "bigram", 3: "trigram"}
    phrases = top[3].select(F.col("term").alias("phrase"), F.col("count").alias("m"), F.lit(3).alias("size"), "x_first").unionByName(
        top[2].select(F.col("term").alias("phrase"), F.col("count").alias("m"), F.lit(2).alias("size"), "x_first")
    )
    # 2 * limit phrases at most: every part of a phrase is a key, so small n-grams meet them by equality.
    size, tokens = F.col("size"), F.split("phrase", " ")
    parts = phrases.select("*", F.explode(F.array_distinct(F.concat(tokens, F.when(size == 3, ngrams(tokens, 2)).otherwise(F.array().cast("array<string>"))))).alias("term"))
    wanted = F.broadcast(parts.select("term").distinct())
    small = [kept_grams(kept, n).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("count")) for n in (1, 2)]
    small = small[0].unionByName(small[1]).filter(F.col("count") >= least)
    order = F.struct(-F.col("size"), -F.col("m"), "x_phrase_first")
    absorbed = (
        small.join(parts.withColumnRenamed("x_first", "x_phrase_first"), "term")
        .filter(F.col("m") / F.col("count") >= absorb)
        .groupBy("term", "count").agg(F.min_by("phrase", order).alias("absorbed_by"))
    )
    listed = None
    for n in (3, 2, 1):
        own = top[n].select(F.col("term").alias("node"), F.lit(names[n]).alias("node_type"), "count", F.lit("").alias("absorbed_by"))
        if n == 1:
            own = own.join(absorbed.select(F.col("term").alias("node")), "node", "left_anti")
        listed = own if listed is None else listed.unionByName(own)
    return listed.unionByName(absorbed.select(F.col("term").alias("node"), F.lit("absorbed_ngram").alias("node_type"), "count", "absorbed_by"))


def canonical_run(tokens: Sequence[str], terms: frozenset[str], longest: int = 3) -> list[str]:
    """Tokens as canonical terms, from left to right, the longest that fits first; what fits none is left out."""
    out, i = [], 0
    while i < len(tokens):
        fits = (n for n in range(min(longest, len(tokens) - i), 0, -1) if " ".join(tokens[i : i + n]) in terms)
        n = next(fits, 0)
        if n:
            out.append(" ".join(tokens[i : i + n]))
        i += n or 1
    return out


def canonical_terms(records: DataFrame, terms: Sequence[str], stopwords: Sequence[str] = (), longest: int = 3) -> DataFrame:
    """Adds ``terms``, the record in canonical terms. A fold in column functions would copy its output at every token."""
    chosen = frozenset(terms)
    rows = records.withColumn("terms", tokenize(record_text(), stopwords))
    names = rows.columns
    at = names.index("terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = pa.array([canonical_run(t.as_py() or (), chosen, longest) for t in batch.column(at)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], done, *batch.columns[at + 1 :]], names=names)

    return rows.mapInArrow(run, rows.schema)
