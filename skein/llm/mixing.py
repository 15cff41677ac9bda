"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. Since keys are uniform, equal slices of
their range are range partitions of about equal size: each source has as many
slices as its count of documents asks for, so a hot source is spread like the
rest. Prefix sums are distributed: sums by slice, a running sum over a source's
slices (one row for some thousand documents), and a running sum within each slice.
A source's budget is then cut exactly: whole epochs first, the rest in key order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"
#: Documents that a slice holds on average.
SLICE_ROWS = 4096
#: Keys have 60 bits: what 15 hexadecimal digits hold.
KEY_SPAN = float(1 << 60)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``x_source, x_size, x_rows`` -> the same with ``x_target``. One row per source.

    Weights are dealt to the sources by code point, null last, in turn. The
    level is the words that a weight of 1 gets once all sources that it would
    take beyond their bound have stopped there: in order of bound by weight, the
    first level that the source at hand does not stop.

    Dealing in turn needs a rank over all sources, and the level running sums
    over them: both are done in one task, which spills. It holds a row of some
    100 bytes per source and nothing that grows with the documents.
    """
    everything = Window.partitionBy(F.lit(0))
    in_turn = everything.orderBy(F.col("x_source").asc_nulls_last())
    at = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("x_weight", F.get(at, ((F.row_number().over(in_turn) - 1) % len(weights)).cast("int"))).withColumn("x_most", F.col("x_size") * F.lit(most))
    by_bound = everything.orderBy(F.col("x_most") / F.col("x_weight"), F.col("x_source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = out.withColumn(
        "x_level", (F.sum("x_size").over(everything) * F.lit(share) - F.coalesce(F.sum("x_most").over(before), F.lit(0.0))) / F.sum("x_weight").over(rest)
    )
    fits = F.when(F.col("x_level") * F.col("x_weight") <= F.col("x_most"), F.col("x_level"))
    first = F.first(fits, ignorenulls=True).over(by_bound.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("x_target", F.least("x_most", F.coalesce(first * F.col("x_weight"), F.col("x_most")))).select("x_source", "x_size", "x_rows", "x_target")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, slice_rows: int = SLICE_ROWS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken, epochs``, then the columns in ``keep``.

    ``size`` counts the words of the text, ``taken`` the words that the mix
    takes of them, repeats counted; ``epochs`` is how many times the document
    begins. A source takes floor(target) words in all: whole epochs, then its
    documents in the order of their keys, the last one in part.

    Null text has no words. A null source is a source of its own, the last. A
    null ``doc_id`` takes the key of the empty string. Repeated rows are taken
    one by one. Other columns are ignored; an empty table gives no rows. With
    ``keep``, say the text, these columns go through the one shuffle by slice,
    and words are counted anew in each pass instead of being checkpointed.
    """
    clash = {"doc_id", "size", "source_size", "target", "taken", "epochs"} & set(keep)
    if clash:
        raise ValueError(f"columns of the result can't be kept: {sorted(clash)}")
    random = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")
    carried = F.struct(*keep).alias("x_kept")
    sized = docs.select(
        F.col("doc_id").alias("x_id"),
        F.col("source").alias("x_source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("x_words"),
        random.alias("x_key"),
        *([carried] if keep else []),
    )
    sized = sized if keep else cut(sized)
    by_source = sized.groupBy("x_source").agg(F.sum("x_words").alias("x_size"), F.count(F.lit(1)).alias("x_rows"))
    goals = cut(targets(by_source, weights, share, most))
    # One row per source: Spark broadcasts it below its own size threshold, and joins by key beyond.
    here = goals.withColumnRenamed("x_source", "y_source")
    placed = sized.join(here, sized["x_source"].eqNullSafe(here["y_source"])).drop("y_source")
    slices = F.ceil(F.col("x_rows") / F.lit(float(slice_rows)))
    placed = placed.withColumn("x_slice", F.least(F.floor(F.col("x_key") / F.lit(KEY_SPAN) * slices), slices - 1))
    sums = placed.groupBy("x_source", "x_slice").agg(F.sum("x_words").alias("y_sum"))
    running = Window.partitionBy("x_source").orderBy("x_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("x_source").alias("y_source"), F.col("x_slice").alias("y_slice"), F.coalesce(F.sum("y_sum").over(running), F.lit(0)).alias("y_start")
    )
    within = Window.partitionBy("x_source", "x_slice").orderBy("x_key", "x_id", "x_words").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("x_before", F.coalesce(F.sum("x_words").over(within), F.lit(0)))
    budget = F.floor("x_target")
    whole = F.when(F.col("x_size") > 0, F.floor(budget / F.col("x_size"))).otherwise(F.lit(0))
    left = budget - whole * F.col("x_size") - F.col("x_before") - F.col("y_start")
    part = F.greatest(F.lit(0), F.least(F.col("x_words"), left))
    return ranked.join(starts, ranked["x_source"].eqNullSafe(starts["y_source"]) & (ranked["x_slice"] == starts["y_slice"])).select(
        F.col("x_id").alias("doc_id"),
        F.col("x_words").alias("size"),
        F.col("x_size").alias("source_size"),
        F.col("x_target").alias("target"),
        (whole * F.col("x_words") + part).cast("long").alias("taken"),
        (whole + F.when(part > 0, 1).otherwise(0)).cast("long").alias("epochs"),
        *(F.col("x_kept")[c].alias(c) for c in keep),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS most,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size,
         least(most, (SELECT min_by(level, most / weight) FROM l WHERE level * weight <= most) * weight) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p),
f AS (SELECT *, greatest(0, least(size, budget - whole * source_size - before)) AS part FROM e)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken,
       (whole + CASE WHEN part > 0 THEN 1 ELSE 0 END)::BIGINT AS epochs
FROM f
"""
