"""Deduplication, merging and quotas: windows over keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import document_key, url_key, url_path_key
from ..functions.text import compare_key, first_set
from .records import genre, usable

#: Who wins and what tells documents apart: the callers of a merge differ.
POLICIES = ("document", "document_or_title", "url_first", "url_or_title", "url_last")


def dedup_key(policy: str) -> Column:
    """The key of a record; records without any are told apart by all that they say, with ``document_or_title`` by their titles, empty and null ones too."""
    whole = F.concat(F.lit("hash:"), F.sha2(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("text_clean", F.lit("")), F.coalesce("medium", F.lit(""))), 256))
    if policy in ("document", "document_or_title"):
        key = document_key(F.col("url"), F.col("title"), F.col("year"), F.col("medium"))
        if policy == "document_or_title":
            return F.coalesce(F.nullif(key, F.lit("")), F.nullif("url", F.lit("")), "title")
        return first_set(key, F.col("url"), F.col("title"), whole)
    if policy == "url_first":
        title = compare_key(F.coalesce("title", F.lit("")))
        by_title = F.when(title != "", F.concat_ws(":", F.lit("title"), F.coalesce(F.nullif(F.col("year").cast("string"), F.lit("0")), F.lit("")), compare_key(F.coalesce("medium", F.lit(""))), title))
        return first_set(url_path_key(F.col("url")), by_title, whole)
    if policy == "url_or_title":
        return first_set(F.col("url"), F.col("title"), whole)
    if policy == "url_last":
        return first_set(url_key(F.col("url")), whole)
    raise ValueError(f"no such policy: {policy}")


def with_duplicates(records: DataFrame, policy: str = "document") -> DataFrame:
    """All rows with ``dedup_key``, ``copy`` (1 for the row that stays) and ``duplicate_of``, by ``ord``: the first of a key stays, or the last."""
    keyed = records.withColumn("dedup_key", dedup_key(policy))
    own = Window.partitionBy("dedup_key").orderBy(F.desc("ord") if policy == "url_last" else F.asc("ord"))
    name = F.coalesce(F.nullif("url", F.lit("")), "title") if policy == "document_or_title" else first_set(F.col("url"), F.col("title"))
    return keyed.withColumns({"copy": F.row_number().over(own), "duplicate_of": F.first(name).over(own)})


def dedup(records: DataFrame, policy: str = "document") -> DataFrame:
    """The rows that stay, one of each key. The winner is found by aggregation, which combines before the shuffle; only then does it meet its row.

    A key and its ``ord`` meet as one value, in which nulls are equal.
    """
    at = F.struct("dedup_key", "ord").alias("x_at")
    keyed = records.withColumn("dedup_key", dedup_key(policy))
    best = keyed.groupBy("dedup_key").agg((F.max if policy == "url_last" else F.min)("ord").alias("ord")).select(at)
    return keyed.select("*", at).join(best, "x_at", "left_semi").dropDuplicates(["x_at"]).drop("x_at")


def _together(sources: dict[str, DataFrame], policy: str) -> DataFrame:
    """All rows with their key and ``x_place``: by source in the given order, then ``ord``."""
    rows = None
    for k, (name, df) in enumerate(sources.items()):
        own = F.lit(name)
        if "source_collection" in df.columns:
            listed = F.filter(F.transform(F.split(F.coalesce("source_collection", F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")
            own = F.array_join(F.array_distinct(F.concat(listed, F.array(F.lit(name)))), ", ")
        part = df.withColumns({"source_collection": own, "x_name": F.lit(name), "x_source": F.lit(k)})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.withColumns({"dedup_key": dedup_key(policy), "x_place": F.struct("x_source", "ord")})


def merge_sources(sources: dict[str, DataFrame], policy: str = "url_first") -> DataFrame:
    """Several corpora as one: of each key one row stays and lists all sources that had it.

    The row is the first, by source in the given order and ``ord``; with
    ``url_last``, as an index is rebuilt, the last. ``source_collections`` are
    the sources and what rows bring along as ``source_collection``: in the order
    in which they are met with the document policy, else sorted. ``copies``
    counts the key's rows.
    """
    keyed = _together(sources, policy)
    seen = keyed.select("dedup_key", "x_place", F.posexplode(F.split("source_collection", ", ")).alias("x_p", "x_c"))
    first = seen.groupBy("dedup_key", "x_c").agg(F.min(F.struct("x_place", "x_p")).alias("x_at"))
    order = F.struct("x_at", "x_c") if policy == "document" else F.struct("x_c")
    names = first.groupBy("dedup_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["x_c"]), ", ").alias("source_collections"))
    place = F.max("x_place") if policy == "url_last" else F.min("x_place")
    found = keyed.groupBy("dedup_key").agg(place.alias("x_place"), F.count(F.lit(1)).alias("copies")).join(names, "dedup_key")
    return keyed.join(found, ["dedup_key", "x_place"]).drop("x_place", "x_source", "x_name", "source_collection")


def merge_report(sources: dict[str, DataFrame], policy: str = "url_first") -> DataFrame:
    """One row per source of a merge: its rows, those that stay, and those that give way to a row of another source or of its own."""
    by_source = _together(sources, policy).groupBy("dedup_key", F.col("x_name").alias("source_collection"), "x_source").agg(F.count(F.lit(1)).alias("n"))
    winner = (F.max_by if policy == "url_last" else F.min_by)("source_collection", "x_source")
    keys = by_source.groupBy("dedup_key").agg(winner.alias("x_winner"))
    own = F.col("x_winner") == F.col("source_collection")
    return by_source.join(keys, "dedup_key").groupBy("source_collection").agg(
        F.sum("n").alias("rows"), F.count_if(own).alias("kept"), F.sum(F.when(own, F.col("n") - 1).otherwise(0)).alias("own_copies"), F.sum(F.when(~own, F.col("n")).otherwise(0)).alias("copies_of_others")
    )


def provenance(rows: DataFrame, columns: Sequence[str], order: str = "ord") -> DataFrame:
    """One row per ``dedup_key``: in each of the columns all values of its copies, lists parted at commas, each once, the first seen first."""
    each = []
    for c in columns:
        parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")
        each.append(rows.select("dedup_key", F.lit(c).alias("c"), order, F.posexplode(parts).alias("p", "v")))
    long = each[0]
    for e in each[1:]:
        long = long.unionByName(e)
    first = long.groupBy("dedup_key", "c", "v").agg(F.min(F.struct(order, "p")).alias("f"))
    lists = first.groupBy("dedup_key").pivot("c", list(columns)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda x: x["v"]), ", "))
    return rows.select("dedup_key").distinct().join(lists, "dedup_key", "left").fillna("", list(columns))


def quota(records: DataFrame, cap: int = 100) -> DataFrame:
    """Rows accepted under a cap of usable records for each year and genre, in input order.

    A row is accepted while fewer usable rows than the cap stand before it. What
    is rejected comes only after the cap is reached, so a running sum over all
    rows before it says the same as one over accepted rows. The sum is taken in
    two steps, by stretches of the input and within them, so a year and genre
    that hold most rows are spread.
    """
    stretch = 4096
    rows = records.withColumns({"g": genre(), "u": usable().cast("int"), "x_part": F.floor(F.col("ord") / stretch)})
    sums = rows.groupBy("year", "g", "x_part").agg(F.sum("u").alias("x_sum"))
    before = Window.partitionBy("year", "g").orderBy("x_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("year").alias("y"), F.col("g").alias("h"), F.col("x_part").alias("p"), F.coalesce(F.sum("x_sum").over(before), F.lit(0)).alias("x_start"))
    inside = Window.partitionBy("year", "g", "x_part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("x_before", F.coalesce(F.sum("u").over(inside), F.lit(0)))
    rows = rows.join(starts, rows["year"].eqNullSafe(starts["y"]) & (rows["g"] == starts["h"]) & (rows["x_part"] == starts["p"]))
    return rows.withColumn("accepted_before", F.col("x_before") + F.col("x_start")).filter(F.col("accepted_before") < cap).drop("g", "u", "x_part", "x_before", "x_start", "y", "h", "p")
