"""What must not be done twice: texts read again for each measure, keys worked out again for each mark."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from skein.functions.text import tokenize
from skein.operators import articles, folds, graph, terms


def test_a_network_is_counted_in_one_pass_over_the_texts(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([("one two three one",), ("two three four two",), ("five",)], "text string").mapInArrow(counted, "text string")
    net = graph.cooccurrence(texts.select(tokenize(F.col("text")).alias("terms")), ["one", "two", "three"], 4, 1)
    best = graph.visible(graph.normalize(net), 3)
    assert {r["id"] for r in best.nodes.collect()} == {"one", "two", "three"}
    assert {(r["source"], r["target"]): r["raw_weight"] for r in best.edges.collect()} == {("one", "two"): 2.0, ("one", "three"): 2.0, ("three", "two"): 3.0}
    assert seen.value == 3


def test_keys_of_blocks_are_worked_out_once_for_all_marks(spark):
    rows = spark.createDataFrame([(["A block", "About the author"],)], "a array<string>")
    for made in (articles.tail_place(F.col("a"), F.array().cast("array<string>")), articles.bio_place(F.col("a"))):
        plan = rows.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        asked = re.findall(r"(?<![_a-z])(?:[Cc]ontains|position|locate)\((.{12})", plan)
        assert asked and all("lambda" in a or a.startswith("x_") for a in asked), asked


def test_pages_are_not_cleaned_where_only_their_text_is_asked_for(spark, sf):
    from skein.plans import QUERIES

    plan = QUERIES["html_visible_text"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp_replace" not in plan


def test_rare_ngrams_are_not_shuffled_and_none_of_the_commonest_is_lost(spark, monkeypatch):
    """Against a count of all, at few buckets, so that many n-grams share one; ties go to the one that stood first."""
    dice = random.Random(5)
    texts = [(i, " ".join(dice.choice(["aaa", "bbb", "ccc"]) if dice.random() < 0.4 else f"w{dice.randrange(10**6)}" for _ in range(40))) for i in range(200)]
    rows = spark.createDataFrame([(i, t, t, "") for i, t in texts], "ord long, text_normalized string, text_clean string, title string")
    full = [(r["term"], r["count"]) for r in terms.term_counts(rows, 2).orderBy(F.desc("count"), "x_first").limit(9).collect()]
    asked = []
    count = terms.counted
    monkeypatch.setattr(terms, "counted", lambda grams: asked.append(grams) or count(grams))
    for buckets in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(terms, "BUCKETS", buckets)
        assert [(r["term"], r["count"]) for r in terms.top_terms(rows, 2, 9).collect()] == full
    assert asked[-1].count() < terms.gram_rows(rows, 2).count() / 4


def test_closest_set_is_counted_in_bytes():
    """A search among a block's sets works on a byte for each, not eight, and is that of all pairs; sets of more than a byte's tokens take two."""
    for top, width in ((80, 1), (300, 2)):
        rng = np.random.default_rng(top)
        sets = [np.unique(rng.zipf(1.3, int(n)) % 900) for n in rng.integers(1, top, 300)] + [np.arange(top)]
        sizes, ids = np.array([len(s) for s in sets]), np.arange(5, 5 + len(sets))
        held = folds.Held(ids, sizes, np.concatenate(sets))
        assert held.counts(np.arange(3)).dtype.itemsize == width
        for k in range(0, len(sets), 7):
            share = [len(np.intersect1d(sets[k], s)) / len(np.union1d(sets[k], s)) for s in sets[:k]]
            for least in (0.0, 0.2, 0.9):
                known = np.flatnonzero(np.isin(held.tokens, sets[k]))
                assert held.best(int(ids[k]), len(sets[k]), known, least) == max([least, *share])
