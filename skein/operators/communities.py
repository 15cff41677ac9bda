"""Communities of a weighted graph by modularity, as joins and aggregations.

A graph is a table of undirected edges. Nothing of it comes to the driver but
counts and sums. Every step is an aggregation that combines before its shuffle
and joins that adaptive execution can split, so a hub that a third of all edges
touch is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .graph import connected_components, endpoints

#: Rounds of moves on one level, levels, and rounds of merges, at most.
MOVES, LEVELS, MERGES = 16, 20, 200
#: Two rounds in turn that gain less modularity than this end a level.
WORTH = 1e-4
#: What a move must gain, as a share of all weight.
LEAST_GAIN = 1e-10
ALGORITHMS = ("louvain", "greedy_modularity", "connected_components")


def arcs_of(edges: DataFrame) -> DataFrame:
    """``id, other, weight``: each pair of different nodes both ways, parallel edges as one."""
    return endpoints(edges.filter("source <> target AND weight > 0")).groupBy("id", "other").agg(F.sum(F.col("weight").cast("double")).alias("weight"))


def sums(arcs: DataFrame, home: DataFrame) -> tuple[DataFrame, float]:
    """``id, degree`` of the nodes of a partition's graph with what lies inside each, and the sum of all degrees."""
    degree = arcs.groupBy("id").agg(F.sum("weight").alias("degree"))
    nodes = cut(home.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0))))
    return nodes, nodes.agg(F.coalesce(F.sum("degree"), F.lit(0.0))).first()[0]


def modularity(edges: DataFrame, home: DataFrame) -> DataFrame:
    """One row ``modularity`` for the partition ``id, community``: the share of weight inside communities less what chance puts there.

    Self-links count for nothing; nodes without edges are communities that weigh
    nothing. Without weight it is 0.
    """
    arcs = arcs_of(edges)
    a, b = home.select("id", F.col("community").alias("x_a")), home.select(F.col("id").alias("other"), F.col("community").alias("x_b"))
    inside = arcs.join(a, "id").join(b, "other").filter("x_a = x_b").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("x_in"))
    totals = arcs.groupBy("id").agg(F.sum("weight").alias("weight")).join(a, "id").groupBy("x_a").agg(F.sum("weight").alias("t"))
    squares = totals.agg(F.coalesce(F.sum(F.col("t") * F.col("t")), F.lit(0.0)).alias("x_sq"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("x_m"))
    m = F.col("x_m")
    return inside.crossJoin(squares).select(F.when(m > 0, F.round(F.col("x_in") / m - F.col("x_sq") / (m * m), 5)).otherwise(0.0).alias("modularity"))  # one row each


def quality(near: DataFrame, nodes: DataFrame, double: float) -> float:
    """Modularity from the weight of each node to each community."""
    inside = near.filter("c = own").agg(F.coalesce(F.sum("to"), F.lit(0.0)).alias("a"))
    squares = nodes.groupBy("community").agg(F.sum("degree").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t")), F.lit(0.0)).alias("b"))
    a, b = inside.crossJoin(squares).first()  # one row each
    return a / double - b / double / double


def weights_to(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, own, degree, c, to``: the weight from each node to each community that it touches; to its own also where that is nothing."""
    to = arcs.filter("id <> other").join(nodes.select(F.col("id").alias("other"), F.col("community").alias("c")), "other").groupBy("id", "c").agg(F.sum("weight").alias("to"))
    loops = arcs.filter("id = other").select("id", F.col("weight").alias("loop"))
    own = nodes.select("id", F.col("community").alias("c"), F.lit(0.0).alias("to")).unionByName(to).groupBy("id", "c").agg(F.sum("to").alias("to"))
    return own.join(nodes.select("id", F.col("community").alias("own"), "degree"), "id").join(loops, "id", "left").select("id", "own", "degree", "c", (F.col("to") + F.when(F.col("c") == F.col("own"), F.coalesce("loop", F.lit(0.0))).otherwise(0.0)).alias("to"))


def moved(near: DataFrame, nodes: DataFrame, double: float, colour: Column) -> DataFrame:
    """Nodes of the chosen colour go to the community that gains most, of equals the least; the others stay."""
    totals = nodes.groupBy("community").agg(F.sum("degree").alias("t"))
    here = F.col("c") == F.col("own")
    gain = F.col("to") - (F.col("t") - F.when(here, F.col("degree")).otherwise(0.0)) * F.col("degree") / double
    judged = near.join(totals.withColumnRenamed("community", "c"), "c").withColumn("gain", gain)
    # A loop comes along wherever the node goes.
    best = judged.groupBy("id", "own", "degree").agg(F.min_by("c", F.struct(F.round(-F.col("gain"), 9), F.col("c"))).alias("best"), F.max("gain").alias("most"), F.max(F.when(here, F.col("gain"))).alias("stay"))
    goes = colour & (F.col("most") > F.col("stay") + LEAST_GAIN * double)
    return best.select("id", "degree", F.when(goes, F.col("best")).otherwise(F.col("own")).alias("community"))


def settled(arcs: DataFrame, nodes: DataFrame, double: float) -> DataFrame:
    """Moves node by node until no round gains. Alternate halves of the nodes move, drawn anew each round, so that neighbours don't swap for ever.

    A round that loses, as moves side by side may, is taken back, and the next
    ones move a smaller share of the nodes.
    """
    near = cut(weights_to(arcs, nodes))
    best, share, idle = quality(near, nodes, double), 2, 0
    for number in range(MOVES):
        colour = F.pmod(F.xxhash64("id", F.lit(number // 2)), F.lit(share)) == number % share
        new = cut(moved(near, nodes, double, colour))
        after = cut(weights_to(arcs, new))
        now = quality(after, new, double)
        idle = 0 if now > best + WORTH else idle + 1
        if now > best:
            nodes, near, best = new, after, now
        elif now < best:
            share *= 2
        if idle >= 2:
            break
    return nodes


def contracted(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph of communities: one aggregation. What lies inside one becomes its loop."""
    home = nodes.select("id", "community")
    ends = arcs.join(home, "id").join(home.select(F.col("id").alias("other"), F.col("community").alias("x_other")), "other")
    return ends.groupBy(F.col("community").alias("id"), F.col("x_other").alias("other")).agg(F.sum("weight").alias("weight"))


def louvain(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``id, community``: moves, then the graph of communities, until its nodes stay; then the nodes of the first graph move once more.

    A community is named by one of its members. Nodes without edges, given by
    ``nodes`` (``id``), are communities of their own.
    """
    first = cut(arcs_of(edges))
    ids = first.select("id").distinct() if nodes is None else nodes.select("id").unionByName(first.select("id")).distinct()
    start, double = sums(first, ids.withColumn("community", F.col("id")))
    if not double:
        return start.select("id", "community")
    arcs, level, home = first, start, start.select("id", "community")
    before = start.count()
    for _ in range(LEVELS):
        level = settled(arcs, level, double)
        home = cut(home.withColumnRenamed("community", "x").join(level.select(F.col("id").alias("x"), "community"), "x").select("id", "community"))
        groups = level.select("community").distinct().count()
        if groups == before:
            break
        before = groups
        arcs = cut(contracted(arcs, level))
        level = cut(level.groupBy(F.col("community").alias("id")).agg(F.sum("degree").alias("degree")).withColumn("community", F.col("id")))
    return settled(first, cut(start.select("id", "degree").join(home, "id")), double).select("id", "community")


def greedy(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``id, community`` by merging, as greedy modularity does: every community points at the neighbour with which it gains most.

    Of two that point at each other the heavier one is a head, and takes those
    that point at it, best first, as long as each adds to the gain even if no
    edge joins it to those before. So every merge gains, however many are made
    side by side, and a hub's neighbours don't wait for each other.
    """
    first = cut(arcs_of(edges))
    ids = first.select("id").distinct() if nodes is None else nodes.select("id").unionByName(first.select("id")).distinct()
    level, double = sums(first, ids.withColumn("community", F.col("id")))
    arcs, home = first, level.select("id", "community")
    for number in range(MERGES if double else 0):
        degree = level.select("id", "degree")
        gain = F.col("weight") - F.col("degree") * F.col("x_degree") / double
        pairs = arcs.filter("id <> other").join(degree, "id").join(degree.select(F.col("id").alias("other"), F.col("degree").alias("x_degree")), "other").select("id", "degree", "other", gain.alias("gain")).filter(F.col("gain") > LEAST_GAIN * double)
        points = cut(pairs.groupBy("id", "degree").agg(F.min_by("other", F.struct(F.round(-F.col("gain"), 9), F.col("other"))).alias("other"), F.max("gain").alias("gain")))
        if points.isEmpty():
            break
        back = points.select(F.col("id").alias("other"), F.col("other").alias("id"), F.col("degree").alias("x_degree"))
        heavier = (F.col("degree") > F.col("x_degree")) | ((F.col("degree") == F.col("x_degree")) & (F.col("id") < F.col("other")))
        heads = points.join(back, ["id", "other"]).filter(heavier).select(F.col("id").alias("other"))
        before = Window.partitionBy("other").orderBy(F.desc("gain"), "id").rowsBetween(Window.unboundedPreceding, -1)
        taken = points.join(heads, "other").withColumn("x_before", F.coalesce(F.sum("degree").over(before), F.lit(0.0)))
        taken = taken.filter(F.col("gain") - F.col("degree") * F.col("x_before") / double > 0).select("id", "other")
        merged = cut(degree.join(taken, "id", "left").select("id", "degree", F.coalesce("other", "id").alias("community")))
        home = home.withColumnRenamed("community", "x").join(merged.select(F.col("id").alias("x"), "community"), "x").select("id", "community")
        home = cut(home) if number % 4 == 3 else home
        arcs = cut(contracted(arcs, merged))
        level = merged.groupBy(F.col("community").alias("id")).agg(F.sum("degree").alias("degree"))
    return cut(home)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    found = connected_components(edges).select("id", F.col("component").alias("community"))
    return found if nodes is None else nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def communities(edges: DataFrame, nodes: DataFrame | None = None, algorithm: str = "louvain") -> DataFrame:
    """``id, community`` by one of :data:`ALGORITHMS`."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no such algorithm: {algorithm}")
    return {"louvain": louvain, "greedy_modularity": greedy, "connected_components": components}[algorithm](edges, nodes)


def community_rows(home: DataFrame, terms: int | None = 40) -> DataFrame:
    """``community, size, terms``: numbered by falling size, of equals by their least member; the first ``terms`` members in order.

    The names of a large community are thinned before they are gathered: only
    its first ones meet in one row.
    """
    sizes = home.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("x_least"))
    numbered = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.desc("size"), "x_least")).cast("long"))
    own = Window.partitionBy("community").orderBy("id")
    few = home if terms is None else home.withColumn("x_k", F.row_number().over(own)).filter(F.col("x_k") <= terms)
    names = few.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("terms"))
    return numbered.join(names, "community").select(F.col("number").alias("community"), "size", "terms")
