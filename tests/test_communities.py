"""Distributed communities against a sequential search, and modularity against its definition."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.operators import communities as c


def one_by_one(nodes, edges, passes=20):
    """Nodes move one by one to the community that gains most, until none gains; with the modularity."""
    weight = {n: defaultdict(float) for n in nodes}
    for a, b, w in edges:
        if a != b:
            weight[a][b] += w
            weight[b][a] += w
    degree = {n: sum(weight[n].values()) for n in nodes}
    double = sum(degree.values())
    home = {n: i for i, n in enumerate(nodes)}
    if double <= 0:
        return home, 0.0
    total = {home[n]: degree[n] for n in nodes}
    for _ in range(passes):
        moved = False
        for n in nodes:
            to = defaultdict(float)
            for o, w in weight[n].items():
                to[home[o]] += w
            total[home[n]] -= degree[n]
            best, gain = home[n], to[home[n]] - total[home[n]] * degree[n] / double
            for c in sorted(to):
                g = to[c] - total[c] * degree[n] / double
                if g > gain + 1e-10:
                    best, gain = c, g
            moved |= best != home[n]
            home[n] = best
            total[best] = total.get(best, 0.0) + degree[n]
        if not moved:
            break
    inside = sum(w for n in nodes for o, w in weight[n].items() if home[o] == home[n])
    return home, round(inside / double - sum((t / double) ** 2 for t in total.values()), 5)


def planted(k, size, within, across, seed, prefix):
    dice, out = random.Random(seed), []
    for i in range(k * size):
        for j in range(i):
            if dice.random() < (within if i // size == j // size else across):
                out.append((f"{prefix}{i:04d}", f"{prefix}{j:04d}", float(dice.randint(1, 4))))
    return out


EDGES = "source string, target string, weight double"


def plain_modularity(edges, home):
    degree, inside = defaultdict(float), 0.0
    for a, b, w in edges:
        if a != b:
            degree[home[a]] += w
            degree[home[b]] += w
            inside += 2 * w * (home[a] == home[b])
    double = sum(degree.values())
    return inside / double - sum((d / double) ** 2 for d in degree.values())


def test_planted_communities(spark):
    """Three graphs side by side: moves do at least as well as the sequential ones on all and on each, merges nearly."""
    parts = [planted(4, 10, 0.7, 0.05, 1, "a"), planted(5, 9, 0.7, 0.04, 2, "b"), planted(3, 16, 0.5, 0.05, 3, "c")]
    edges = [e for p in parts for e in p]
    df = spark.createDataFrame(edges, EDGES)
    lone = spark.createDataFrame([("alone",), ("a0001",)], "id string")
    home = {r.id: r.community for r in c.communities(df, lone).collect()}
    assert home["alone"] == "alone" and len(home) == 1 + len({x for e in edges for x in e[:2]})
    for part in (*parts, edges):
        want = one_by_one(sorted({x for e in part for x in e[:2]}), part)[1]
        assert plain_modularity(part, home) >= want - 1e-3
    table = spark.createDataFrame(list(home.items()), "id string, community string")
    assert c.modularity(df, table).first()[0] == pytest.approx(plain_modularity(edges, home), abs=1e-5)
    merged = {r.id: r.community for r in c.communities(df, None, "greedy_modularity").collect()}
    assert plain_modularity(edges, merged) >= 0.9 * plain_modularity(edges, home)
    rows = c.community_rows(table).orderBy("community").collect()
    assert [r.community for r in rows] == list(range(1, len(rows) + 1)) and sum(r["size"] for r in rows) == len(home)
    assert all(len(r.terms.split(", ")) == min(40, r["size"]) for r in rows)


def test_many_edges(spark, monkeypatch):
    """10^5 edges, a hub that touches every node among them, and no edge on the driver. Few rounds are enough here."""
    monkeypatch.setattr(c, "MOVES", 5)
    monkeypatch.setattr(c, "LEVELS", 3)
    drawn = spark.range(100_000).select(F.pmod(F.xxhash64("id"), F.lit(5000)).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)).alias("b"), (F.col("id") % 20 == 0).alias("far"))
    b = F.when(F.col("far"), F.pmod(F.col("a") * 31 + F.col("b") * 977, F.lit(5000))).otherwise(F.floor(F.col("a") / 50) * 50 + F.col("b"))
    edges = drawn.select(F.col("a").cast("string").alias("source"), b.cast("string").alias("target"), F.lit(1.0).alias("weight"))
    edges = edges.unionByName(spark.range(5000).select(F.lit("hub").alias("source"), F.col("id").cast("string").alias("target"), F.lit(1.0).alias("weight")))
    home = c.louvain(edges)
    true = home.select("id", F.when(F.col("id") == "hub", "0").otherwise(F.floor(F.col("id").cast("int") / 50).cast("string")).alias("community"))
    assert c.modularity(edges, home).first()[0] >= 0.97 * c.modularity(edges, true).first()[0]


def test_communities_of_little(spark):
    nothing = spark.createDataFrame([], EDGES)
    for name in c.ALGORITHMS:
        assert c.communities(nothing, None, name).count() == 0
    assert c.modularity(nothing, spark.createDataFrame([("a", "a")], "id string, community string")).first()[0] == 0.0
    selves = spark.createDataFrame([("a", "a", 3.0), ("a", "b", 1.0), ("b", "a", 1.0)], EDGES)
    assert len({r.community for r in c.louvain(selves).collect()}) == 1
    with pytest.raises(ValueError):
        c.communities(nothing, None, "girvan")
