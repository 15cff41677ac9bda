"""Choosing key nodes of a graph: three objectives, several searches, and their statistics.

Problems are graphs that a display bounds (some hundred nodes). A problem is
collected once; searches run side by side, one task for each method and seed.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("removal_impact", "incident", "induced")
MOST_NODES = 20_000
METHODS = ("greedy_sweep", "moea", "mosa", "society", "greedy", "genetic", "annealing", "composition")


@dataclass
class Problem:
    """``scores`` of candidates, ``edges`` as (source, target, weight)."""

    scores: dict[str, float]
    edges: list[tuple[str, str, float]]
    mode: str = "removal_impact"
    most: int | None = None
    least: int = 1
    least_node_share: float = 0.0
    most_removed_share: float = 1.0
    incident: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self):
        self.incident = {n: [] for n in self.scores}
        for i, (a, b, _) in enumerate(self.edges):
            for n in {a, b} & self.scores.keys():
                self.incident[n].append(i)
        self.ids = sorted(self.scores)
        self.node_total = sum(self.scores.values()) or 1.0
        self.edge_total = sum(w for _, _, w in self.edges) or 1.0
        self.most = self.most or max(1, len(self.ids))


def problem_of(nodes: DataFrame, edges: DataFrame, node_types: Sequence[str] = (), edge_types: Sequence[str] = (), **limits) -> Problem:
    """Collects a graph whose size is checked: searches are for graphs of a bounded size."""
    chosen = nodes.filter(F.col("node_type").isin(*node_types)) if node_types else nodes
    links = edges.filter(F.col("edge_type").isin(*edge_types)) if edge_types else edges
    rows, pairs = chosen.select("id", "score").limit(MOST_NODES + 1).collect(), links.select("source", "target", "weight").limit(50 * MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES or len(pairs) > 50 * MOST_NODES:
        raise ValueError("the graph is too large to search; choose its visible part first")
    return Problem({r[0]: float(r[1] or 0) for r in rows}, sorted((r[0], r[1], float(r[2] or 1)) for r in pairs), **limits)


@dataclass(frozen=True)
class Solution:
    ids: tuple[str, ...]
    size_share: float
    node_share: float
    removed_share: float
    removed_edges: int
    violation: float
    value: float

    @property
    def feasible(self) -> bool:
        return self.violation == 0

    @property
    def vector(self) -> tuple[float, float, float]:
        return tuple(min(1.0, max(0.0, v)) for v in (1 - self.size_share, self.node_share, 1 - self.removed_share))


# How the scalar value weighs node weight, removed edge weight, edges left and each node.
NODE_WEIGHT, EDGE_WEIGHT, COVERAGE_WEIGHT, SIZE_PENALTY = 1.0, 1.0, 0.2, 0.05


def evaluate(p: Problem, chosen: Iterable[str], node_weight=NODE_WEIGHT, edge_weight=EDGE_WEIGHT, coverage_weight=COVERAGE_WEIGHT, size_penalty=SIZE_PENALTY) -> Solution:
    """Shares of nodes, of node weight and of removed edge weight, what limits are broken by, and one scalar value."""
    asked = [c for c in chosen if c]
    ids = tuple(dict.fromkeys(asked))
    valid = tuple(i for i in ids if i in p.scores)
    picked = set(valid)
    touched = {e for i in valid for e in p.incident[i]}
    if p.mode == "removal_impact":
        removed = touched
    elif p.mode == "incident":
        removed = set(range(len(p.edges))) - touched
    else:
        removed = {k for k, (a, b, _) in enumerate(p.edges) if not (a in picked and b in picked)}
    node_share = sum(p.scores[i] for i in valid) / p.node_total
    removed_share = sum(p.edges[k][2] for k in removed) / p.edge_total
    n = len(valid)
    broken = (len(ids) - n) + (len(asked) - len(ids)) + max(0, p.least - n) + max(0, n - p.most)
    broken += max(0.0, p.least_node_share - node_share) + max(0.0, removed_share - p.most_removed_share)
    value = node_weight * node_share + coverage_weight * (1 - len(removed) / max(1, len(p.edges))) - edge_weight * removed_share - size_penalty * n
    return Solution(valid, n / max(1, len(p.ids)), node_share, removed_share, len(removed), round(float(broken), 6), value)


def dominates(a: Solution, b: Solution) -> bool:
    """Feasible before infeasible, less broken before more; else no worse in all and better in one objective."""
    if a.feasible != b.feasible:
        return a.feasible
    if not a.feasible:
        return a.violation < b.violation
    return a.vector != b.vector and all(x >= y for x, y in zip(a.vector, b.vector, strict=True))


def front(found: Iterable[Solution], most: int = 100) -> list[Solution]:
    unique = {tuple(sorted(s.ids)): s for s in found}.values()
    kept = [s for s in unique if not any(dominates(o, s) for o in unique)]
    return sorted(kept, key=lambda s: (-sum(s.vector), s.ids))[:most]


class Search:
    """What the searches share: a budget of evaluations, an archive and random moves that keep to the limits."""

    def __init__(self, p: Problem, budget: int, seed: int):
        self.p, self.left, self.dice, self.archive = p, budget, random.Random(seed), []

    def judge(self, ids: Iterable[str], **weights) -> Solution:
        self.left -= 1
        s = evaluate(self.p, ids, **weights)
        if not any(dominates(o, s) or set(o.ids) == set(s.ids) for o in self.archive):
            self.archive = [o for o in self.archive if not dominates(s, o)] + [s]
        return s

    def fitting(self, ids: Iterable[str]) -> tuple[str, ...]:
        own = list(dict.fromkeys(i for i in ids if i in self.p.scores))[: self.p.most]
        rest = [i for i in self.p.ids if i not in own]
        while len(own) < min(self.p.least, len(self.p.ids)):
            own.append(rest.pop(self.dice.randrange(len(rest))))
        return tuple(own)

    def sample(self) -> tuple[str, ...]:
        n = len(self.p.ids)
        return self.fitting(self.dice.sample(self.p.ids, self.dice.randint(min(self.p.least, n), max(min(self.p.least, n), min(self.p.most, n))))) if n else ()

    def moved(self, ids: Sequence[str]) -> tuple[str, ...]:
        own, others = list(ids), [i for i in self.p.ids if i not in set(ids)]
        kind = self.dice.random()
        if others and (kind < 0.4 or not own):
            own.append(self.dice.choice(others))
        elif own and kind < 0.7:
            own.pop(self.dice.randrange(len(own)))
        elif own and others:
            own[self.dice.randrange(len(own))] = self.dice.choice(others)
        return self.fitting(own)

    def crossed(self, a: Sequence[str], b: Sequence[str]) -> tuple[str, ...]:
        return self.fitting(i for i in dict.fromkeys([*a, *b]) if (i in a and i in b) or self.dice.random() < 0.5)

    def climb(self, **weights) -> Solution:
        """Adds the node that helps most while any helps; the first is added anyway. Ties go to the least id."""
        best = None
        while self.left > 0 and (best is None or len(best.ids) < self.p.most):
            own = best.ids if best else ()
            tries = []
            for i in self.p.ids:
                if i not in own and self.left > 0:
                    tries.append(self.judge((*own, i), **weights))
            step = max(tries, key=lambda s: s.value, default=None)
            if step is None or (best is not None and step.value <= best.value + 1e-12 and len(best.ids) >= self.p.least):
                break
            best = step
        return best or self.judge(())


def run_greedy(s: Search) -> None:
    s.climb()


def run_greedy_sweep(s: Search) -> None:
    grid = [i / 4 for i in range(5)]
    each = max(1, s.left // 124)
    for a in grid:
        for b in grid:
            for c in grid:
                if a or b or c:
                    budget, s.left = s.left, min(s.left, each * max(1, len(s.p.ids)))
                    used = s.left
                    if used > 0:
                        s.climb(node_weight=a, edge_weight=b, coverage_weight=c, size_penalty=0.0)
                    s.left = budget - (used - s.left)


def run_moea(s: Search) -> None:
    for _ in range(min(20, s.left)):
        s.judge(s.sample())
    while s.left > 0:
        a, b = (s.dice.choice(s.archive).ids for _ in range(2))
        s.judge(s.moved(s.crossed(a, b)))


def run_mosa(s: Search) -> None:
    now = s.judge(s.sample())
    while s.left > 0:
        new = s.judge(s.moved(now.ids))
        if dominates(new, now) or (not dominates(now, new) and s.dice.random() < 0.55):
            now = new


def run_society(s: Search, people: int = 8) -> None:
    """Some searchers with a memory each; they learn from their own and from a guide of the archive."""
    best = sorted(s.p.ids, key=lambda i: (-s.p.scores[i], i))
    minds = [[s.judge(s.fitting(best[: k + 1])) if k % 2 else s.judge(s.sample())] for k in range(min(people, s.left))]
    while s.left > 0:
        for mind in minds:
            if s.left <= 0:
                break
            guide = s.dice.choice(s.archive).ids
            new = s.judge(s.moved(s.crossed(s.dice.choice(mind).ids, guide)))
            worst = max(range(len(mind)), key=lambda k: sum(dominates(o, mind[k]) for o in mind))
            if len(mind) < 5:
                mind.append(new)
            elif not dominates(mind[worst], new):
                mind[worst] = new


def run_genetic(s: Search, size: int = 40) -> None:
    people = [s.judge(s.sample()) for _ in range(min(size, s.left))]
    while s.left > 0 and people:
        a, b = (max(s.dice.sample(people, min(3, len(people))), key=lambda x: x.value) for _ in range(2))
        people.append(s.judge(s.moved(s.crossed(a.ids, b.ids))))
        people = sorted(people, key=lambda x: (-x.value, x.ids))[:size]


def run_annealing(s: Search) -> None:
    now, start = s.judge(s.sample()), max(1, s.left)
    while s.left > 0:
        new = s.judge(s.moved(now.ids))
        heat = max(1e-6, 0.1 * s.left / start)
        if new.value >= now.value or s.dice.random() < math.exp((new.value - now.value) / heat):
            now = new


def run_composition(s: Search, works: int = 12) -> None:
    score = sorted((s.judge(s.sample()) for _ in range(min(works, s.left))), key=lambda x: -x.value)
    while s.left > 0 and score:
        new = s.judge(s.moved(s.crossed(s.dice.choice(score).ids, score[0].ids)))
        if new.value > score[-1].value:
            score = sorted([*score[:-1], new], key=lambda x: -x.value)


RUNS: dict[str, Callable[[Search], None]] = {m: globals()[f"run_{m}"] for m in METHODS}


def search(p: Problem, method: str, budget: int = 1000, seed: int = 1) -> list[Solution]:
    """The front that a method finds within a budget of evaluations."""
    if not p.ids:
        return []
    s = Search(p, budget, seed)
    RUNS[method](s)
    return front(s.archive)


FOUND = "method string, seed int, pareto_rank int, solution_size int, selected_ids string, u1 double, u2 double, u3 double, normalized_sum double, objective_value double, feasible boolean, constraint_violation double"


def solve(spark: SparkSession, p: Problem, methods: Sequence[str] = METHODS[:4], seeds: Sequence[int] = (1,), budget: int = 1000) -> DataFrame:
    """A row for each solution of each method's and seed's front; each runs in a task of its own."""
    grid = spark.createDataFrame([(m, s) for m in methods for s in seeds], "method string, seed int")

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (key[0], key[1], k + 1, len(s.ids), ", ".join(s.ids), *(round(v, 6) for v in s.vector), round(sum(s.vector), 6), round(s.value, 6), s.feasible, s.violation)
            for k, s in enumerate(search(p, key[0], budget, int(key[1])))
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return grid.repartition(len(methods) * len(seeds), "method", "seed").groupBy("method", "seed").applyInPandas(run, FOUND)


# With these, and draws by CPython's generator, an interval is the same everywhere.
CONFIDENCE, RESAMPLES, LEAST_RESAMPLES, BOOTSTRAP_SEED, DECIMALS = 0.95, 1000, 100, 20260725, 6
#: Differences up to this count as none, and so do differences of differences.
SAME = 1e-12
#: Pairs up to which the distribution of signed ranks is worked out exactly, where no ranks are shared.
EXACT_PAIRS = 50


def draws(n: int, resamples: int, seed: int) -> Iterator[np.ndarray]:
    """``resamples`` times n indices below n, with replacement, n at a time: what ``random.Random(seed).randrange(n)`` draws one by one, from the same generator."""
    *key, at = random.Random(seed).getstate()[1]
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": at}}
    held = np.empty(0, np.int64)
    for _ in range(resamples):
        while len(held) < n:
            new = (bits.random_raw(max(n, 1024)) >> np.uint64(32 - n.bit_length())).astype(np.int64)
            held = np.concatenate([held, new[new < n]])
        yield held[:n]
        held = held[n:]


def bootstrap_mean(values: Sequence[float | None], confidence: float = CONFIDENCE, resamples: int = RESAMPLES, seed: int = BOOTSTRAP_SEED) -> tuple[float, float]:
    """Interval of the mean by percentiles of resampled means; that of one value is the value, of none zero."""
    known = np.array([v for v in values if v is not None], float)
    known = known[~np.isnan(known)]
    if len(known) < 2:
        return (round(float(known.sum()), DECIMALS),) * 2
    means = np.sort([known[drawn].mean() for drawn in draws(len(known), max(LEAST_RESAMPLES, resamples), seed)])
    outside = float(np.clip(1.0 - confidence, 0.0, 1.0))
    ranks = (np.array([outside / 2, 1 - outside / 2]) * (len(means) - 1)).astype(int)
    return tuple(round(float(m), DECIMALS) for m in means[ranks])


def bootstrap(rows: DataFrame, value: str, by: str, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Interval of the mean of each group, whose values are held in one task, 8 bytes each, with one resample at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_mean(pdf["v"].sort_values().tolist(), seed=seed + len(str(pdf["k"].iloc[0])))
        return pd.DataFrame({by: [pdf["k"].iloc[0]], "n": [len(pdf)], "ci_low": [low], "ci_high": [high]})

    return rows.select(F.col(by).cast("string").alias("k"), F.col(value).cast("double").alias("v")).groupBy("k").applyInPandas(run, f"{by} string, n long, ci_low double, ci_high double")


def rank_sums_at_most(n: Column, most: Column) -> Column:
    """The share of the 2 ** n signs of ranks 1 to n whose positive ranks add up to ``most`` at most: sums are counted rank by rank."""
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    ways = F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(1.0)), lambda acc, k: F.zip_with(F.concat(acc, zeros(k)), F.concat(zeros(k), acc), lambda x, y: x + y))
    return F.aggregate(F.slice(ways, 1, (F.floor(most) + 1).cast("int")), F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), n)


def wilcoxon(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Signed ranks of the pairs of each group of ``by``: ``n_pairs, median_difference, wilcoxon_statistic, p_value, status``.

    Pairs with a null or a NaN are none; pairs without difference count only for
    the median. Equal sizes share their mean rank, by windows over size. Up to 50
    pairs without shared ranks or zeros the p-value is exact, else by the normal
    approximation. Without any difference it is 1.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    pairs = rows.filter(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(F.col(by), (x - y).alias("d"))
    sized = pairs.withColumn("s", F.round(F.abs("d") / SAME).cast("decimal(38,0)"))
    moved = sized.filter(F.abs("d") > SAME)
    own, peers = Window.partitionBy(by).orderBy("s"), Window.partitionBy(by, "s")
    ranked = moved.withColumns({"r": F.rank().over(own) + (F.count(F.lit(1)).over(peers) - 1) / 2, "peers": F.count(F.lit(1)).over(peers)})
    sums = ranked.groupBy(by).agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("plus"), F.count(F.lit(1)).alias("n"), F.max("peers").alias("peers"))
    whole = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.median("d"), DECIMALS).alias("median_difference"))
    n, total = F.col("n"), F.col("n") * (F.col("n") + 1)
    least = F.least(F.col("plus"), total / 2 - F.col("plus"))
    out = whole.join(sums, by, "left").withColumns({"statistic": least, "exact": (n <= EXACT_PAIRS) & (F.col("peers") == 1) & (n == F.col("n_pairs"))})
    z = F.abs(F.col("statistic") - total / 4) / F.sqrt(total * (2 * n + 1) / 24)
    p = F.when(n.isNull(), 1.0).when(F.col("exact"), F.least(F.lit(1.0), 2 * rank_sums_at_most(n.cast("int"), F.col("statistic")))).otherwise(two_sided(z))
    return out.select(
        by, "n_pairs", "median_difference", F.round(F.coalesce("statistic", F.lit(0.0)), DECIMALS).alias("wilcoxon_statistic"), F.round(p, DECIMALS).alias("p_value"),
        F.when(n.isNull(), "no differences").when(F.col("exact"), "exact").otherwise("normal approximation").alias("status"),
    )


def two_sided(z: Column) -> Column:
    """``erfc(z / sqrt 2)`` for a few groups; Spark has no error function."""
    return F.pandas_udf(lambda v: v.map(lambda x: math.erfc(x / math.sqrt(2))), T.DoubleType())(z)


def experiment(spark: SparkSession, p: Problem, methods: Sequence[str] = METHODS[:4], repetitions: int = 10, budget: int = 200) -> DataFrame:
    """Quality of each run against the front of all runs: ten paired seeds at least."""
    from .geometry import quality, skyline

    found = solve(spark, p, methods, range(1, max(10, repetitions) + 1), budget)
    best = skyline(found.filter("feasible").select("u1", "u2", "u3").distinct())
    runs = found.withColumn("method", F.concat_ws("#", "method", "seed"))
    out = quality(runs.select("method", "u1", "u2", "u3"), best)
    return out.select(F.split("method", "#")[0].alias("method"), F.split("method", "#")[1].cast("int").alias("seed"), "igd", "spacing_std", "dispersion_extent")
