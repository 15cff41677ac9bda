"""Fronts and their quality, for objectives to be maximised in [0, 1]."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

AXES = ("u1", "u2", "u3")


def undominated(points: np.ndarray) -> np.ndarray:
    """Which of distinct points no other dominates. In falling order only earlier ones can, and only those on the front so far need to be asked."""
    order = np.lexsort(tuple(-points[:, k] for k in reversed(range(points.shape[1]))))
    front = np.empty_like(points)
    kept, n = np.zeros(len(points), bool), 0
    for i in order:
        if not n or not (front[:n] >= points[i]).all(axis=1).any():
            front[n] = points[i]
            n += 1
            kept[i] = True
    return kept


def thinned(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """The front of each partition: what is dominated there is dominated at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, len(axes)))
        for batch in batches:
            held = np.unique(np.concatenate([held, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])]), axis=0)
            held = held[undominated(held)]
        yield pa.RecordBatch.from_arrays([pa.array(held[:, k], pa.float64()) for k in range(len(axes))], names=list(axes))

    return points.mapInArrow(run, ", ".join(f"`{x}` double" for x in axes))


def skyline(points: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """Points that no other dominates; repeated ones all stay, ones with a null coordinate go.

    Each partition keeps its own front, then a few partitions those of several,
    then one task that of all: it reads fronts, not points. What meets the points
    again is one row per place on the front.
    """
    known = points.select(*[F.col(x).cast("double").alias(x) for x in axes]).dropna()
    some = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    front = thinned(thinned(thinned(known, axes).repartition(some, *axes), axes).repartition(1), axes)
    return points.join(front, [points[x].cast("double") == front[x] for x in axes], "left_semi")


def hypervolume(points: DataFrame) -> DataFrame:
    """One row: the volume that points span with the origin. Cells between neighbouring coordinates count if a point is beyond them."""
    def steps(axis: str, name: str) -> DataFrame:
        values = points.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(axis))).alias("v")).unionByName(points.sparkSession.range(1).select(F.lit(0.0).alias("v"))).distinct()
        return values.select(F.col("v").alias(f"{name}0"), F.lead("v").over(Window.partitionBy(F.lit(0)).orderBy("v")).alias(f"{name}1")).filter(f"{name}1 IS NOT NULL")

    # For each cell of the first two axes the highest point beyond it: the third axis needs no cells.
    beyond = points.select(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(a))).alias(a) for a in AXES])
    cells = steps("u1", "x").join(beyond, F.col("u1") >= F.col("x1")).groupBy("x0", "x1", "u2").agg(F.max("u3").alias("u3"))
    cells = cells.join(steps("u2", "y"), F.col("u2") >= F.col("y1")).groupBy("x0", "x1", "y0", "y1").agg(F.max("u3").alias("h"))
    return cells.agg(F.round(F.coalesce(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * F.col("h")), F.lit(0.0)), 6).alias("hypervolume"))


def distance(a: str, b: str):
    return F.sqrt(sum(F.pow(F.col(f"{a}.{x}") - F.col(f"{b}.{x}"), 2) for x in AXES))


#: Pairs that are compared without a grid, points that a cell of the first grid holds at most, and the finest grid's halvings of the whole extent.
DIRECT, CROWD, FINEST = 20_000_000, 16, 48


def nearest(places: DataFrame, points: DataFrame, by: str, other: bool = False) -> DataFrame:
    """``by, u1, u2, u3, d``: for each place the distance to the nearest of the points of its group; with ``other``, of those that lie elsewhere.

    Both have distinct rows without nulls. Places look into the cells around their
    own, first of a grid in which no cell holds many points. What lies no farther
    than a cell is wide can't be missed; places that find nothing as near look
    again in cells of twice the width. The few that are left in the end meet all
    points. A place that has no other point is left out.
    """
    def found(asked: DataFrame, offered: DataFrame, on: list[str]) -> DataFrame:
        a, b = asked.alias("a"), offered.alias("b")
        match = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
        if other:
            match.append(~F.expr(" AND ".join(f"a.{x} = b.{x}" for x in AXES)))
        pairs = a.join(b, match).select(*[F.col(f"a.{c}").alias(c) for c in (by, *AXES)], distance("a", "b").alias("d"))
        return pairs.groupBy(by, *AXES).agg(F.min("d").alias("d"))

    def pairs(asked: DataFrame) -> int:
        n, m = asked.groupBy(by).agg(F.count(F.lit(1)).alias("n")).alias("n"), points.groupBy(by).agg(F.count(F.lit(1)).alias("m")).alias("m")
        return n.join(m, F.col(f"n.{by}").eqNullSafe(F.col(f"m.{by}"))).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0

    if pairs(places) <= DIRECT:
        return found(places, points, [by])
    ends = places.select(*AXES).unionByName(points.select(*AXES)).agg(*[f(x).alias(f"{x}{k}") for x in AXES for k, f in enumerate((F.min, F.max))]).first()
    whole = max(ends[f"{x}1"] - ends[f"{x}0"] for x in AXES)
    if not 0 < whole < math.inf:
        return found(places, points, [by])
    names = [f"c{x}" for x in AXES]

    def cells(halvings: int) -> list[Column]:
        return [F.floor((F.col(x) - F.lit(ends[f"{x}0"])) / F.lit(whole / 2.0**halvings)).alias(c) for x, c in zip(AXES, names, strict=True)]

    halvings = max(1, math.ceil(math.log2(max(1, points.count()) / CROWD) / len(AXES)))
    while halvings < FINEST and points.groupBy(by, *cells(halvings)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] > CROWD:
        halvings += 1
    left, done = places, []
    while True:
        asked = left.select(by, *AXES, *cells(halvings))
        for c in names:
            asked = asked.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        near = cut(found(asked, points.select(by, *AXES, *cells(halvings)), [by, *names]))
        near = near.filter(F.col("d") <= whole / 2.0**halvings * (1 - 1e-9))
        done.append(near)
        key = [left[c].eqNullSafe(near[c]) for c in (by, *AXES)]
        left = cut(left.join(near, key, "left_anti"))
        halvings -= 1
        if not halvings or pairs(left) <= DIRECT:
            break
    done.append(found(left, points, [by]))
    return reduce(DataFrame.unionByName, done)


def quality(points: DataFrame, reference: DataFrame, by: str = "method") -> DataFrame:
    """Mean distance from the reference to each method's points, spread of nearest distances, mean extent.

    Every point counts, however many lie at one place. Points with a null
    coordinate are near to none; among the nearest distances of their own they
    count as 0, and so does a lone point.
    """
    points, reference = cut(points.select(by, *AXES)), cut(reference.select(*AXES))
    places = cut(points.dropna(subset=list(AXES)).groupBy(by, *AXES).agg(F.count(F.lit(1)).alias("x_n")))
    methods = points.select(by).distinct()
    spots, lone = places.select(by, *AXES), places.filter("x_n = 1").select(by, *AXES)
    away = nearest(cut(reference.dropna().distinct().crossJoin(methods).select(by, *AXES)), spots, by)
    igd = reference.crossJoin(methods).join(away, [by, *AXES], "left").groupBy(by).agg(F.round(F.avg("d"), 5).alias("igd"))
    apart = points.join(nearest(lone, spots, by, other=True), [by, *AXES], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    spread = apart.groupBy(by).agg(F.round(F.stddev_pop("d"), 5).alias("spacing_std"))
    extent = points.groupBy(by).agg(F.round(sum((F.max(x) - F.min(x) for x in AXES)) / 3, 5).alias("dispersion_extent"))
    return igd.join(spread, by).join(extent, by)


def surface(points: DataFrame, bins: int = 10) -> DataFrame:
    """The best third objective in each cell of the first two."""
    cell = {f"{n}_bin": F.least(F.floor(F.col(x) * bins), F.lit(bins - 1)).cast("int") for n, x in (("x", "u1"), ("y", "u2"))}
    return points.select(*AXES, *[c.alias(n) for n, c in cell.items()]).groupBy("x_bin", "y_bin").agg(F.round(F.max("u3"), 6).alias("best_u3"), F.count(F.lit(1)).alias("points"))


def numeric_summary(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, median, commonest value (the smallest of equals), least, most, sample variance."""
    modes = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("x_n")).groupBy(*by).agg(F.max_by(value, F.struct("x_n", -F.col(value))).alias("mode"))
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.round(F.var_samp(value), 6).alias("variance"),
    ).join(modes, list(by))


def accepted(points: DataFrame, least_size: int, least_weight: float, most_removed: float) -> DataFrame:
    """Solutions with nodes enough, weight enough and not too much removed; missing figures count as the worst."""
    size, weight, removed = F.coalesce("solution_size", F.lit(0)), F.coalesce("node_weight_ratio", F.lit(0.0)), F.coalesce("removed_weight_ratio", F.lit(1.0))
    return points.filter((size >= least_size) & (weight >= least_weight) & (removed <= most_removed))


def union_of_fronts(points: DataFrame) -> DataFrame:
    """Fronts of several methods as one list: a set of nodes once for each method, the one of least ``pareto_rank``; with the three utilities and a score of compromise.

    ``method, pareto_rank, ids`` (an array) and the ratios ``nodes_ratio, node_weight_ratio, removed_weight_ratio``. Empty sets go.
    """
    keyed = points.filter(F.size("ids") > 0).withColumn("x_ids", F.array_sort("ids"))
    others = [c for c in points.columns if c != "method"]
    one = keyed.groupBy("method", "x_ids").agg(F.min_by(F.struct(*others), "pareto_rank").alias("x")).select("method", "x.*")

    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    compact, kept, weight = unit(1.0 - F.col("nodes_ratio")), unit(1.0 - F.col("removed_weight_ratio")), F.col("node_weight_ratio")
    return one.withColumns(
        {
            "u1": F.round(compact, 5), "u2": F.round(weight, 5), "u3": F.round(kept, 5), "normalized_sum": F.round(compact + weight + kept, 5),
            "compromise_score": F.round(weight / (F.col("nodes_ratio") + F.col("removed_weight_ratio") + 1e-9), 6),
        }
    )


def front_summary(points: DataFrame) -> DataFrame:
    """One row per method: points, points on its own front and on that of all, the best of each axis and the mean sum."""
    whole = skyline(points.select(*AXES).distinct())
    own = thinned_by(points.select("method", *AXES), "method")
    best = own.join(whole.withColumn("x_global", F.lit(True)), list(AXES), "left").groupBy("method").agg(F.count(F.lit(1)).alias("front_points"), F.count_if(F.coalesce("x_global", F.lit(False))).alias("global_nondominated_points"))
    sums = points.groupBy("method").agg(
        F.count(F.lit(1)).alias("generated_points"), *[F.round(F.max(x), 5).alias(f"max_{x}") for x in AXES], F.round(F.avg(sum((F.col(x) for x in AXES), F.lit(0.0))), 5).alias("mean_normalized_sum")
    )
    return sums.join(best, "method")


def thinned_by(points: DataFrame, by: str) -> DataFrame:
    """The front of each group, repeated points once each place. A group is thinned in each partition before it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), object)
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            for k in set(keys.tolist()):
                both = np.unique(np.concatenate([held.get(k, values[:0]), values[keys == k]]), axis=0)
                held[k] = both[undominated(both)]
        names = [k for k, v in held.items() for _ in v]
        rest = np.concatenate([*held.values(), np.empty((0, len(AXES)))])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(rest[:, i], pa.float64()) for i in range(len(AXES))]], names=[by, *AXES])

    schema = f"`{by}` string, " + ", ".join(f"{x} double" for x in AXES)
    rows = points.select(F.col(by).cast("string").alias(by), *[F.col(x).cast("double").alias(x) for x in AXES]).dropna()
    return rows.mapInArrow(run, schema).repartition(by).mapInArrow(run, schema)
