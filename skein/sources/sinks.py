"""Writing records, tables of any shape, and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import genre, usable


class EmptyMerge(ValueError):
    """A write that would replace something by nothing."""


def write_records(records: DataFrame, path: str, by_year: bool = True) -> None:
    """Lines of JSON in the order of year, medium and title, a folder for each year. Spark's commit makes it all or nothing."""
    rows = records.sortWithinPartitions("year", "medium", "title")
    (rows.write.partitionBy("year") if by_year else rows.write).mode("overwrite").json(path)


def write_checked(merged: DataFrame, path: str) -> None:
    """Replaces a corpus by a merge, unless the merge is empty."""
    if merged.isEmpty():
        raise EmptyMerge(path)
    merged.write.mode("overwrite").json(path)


def union_of_columns(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under all their columns, in the order in which these first appear."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_csv(path: str, *tables: DataFrame) -> None:
    """One CSV of several tables; what a table lacks is empty, lists are joined by a comma."""
    rows = union_of_columns(*tables)
    flat = [F.array_join(c, ", ").alias(c) if k.startswith("array<string") else F.col(c) for c, k in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def stable_hash(value: object) -> str:
    """SHA-256 of a value as JSON with sorted keys."""
    import hashlib

    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, default=str).encode()).hexdigest()


def manifest(records: DataFrame, config: dict) -> dict:
    """Counts of a corpus by genre and status, and a hash of the configuration that made it. One pass over the records."""
    g, s = genre(), F.coalesce("status", F.lit("unknown"))
    rows = records.groupBy(g.alias("g"), s.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(usable()).alias("u")).collect()
    by_type, by_status = {}, {}
    for r in rows:
        by_type[r.g] = by_type.get(r.g, 0) + r.n
        by_status[r.s] = by_status.get(r.s, 0) + r.n
    return {
        "records_total": sum(r.n for r in rows), "records_usable": sum(r.u for r in rows), "records_by_source_type": dict(sorted(by_type.items())), "records_by_status": dict(sorted(by_status.items())),
        "config": config, "config_sha256": stable_hash(config),
    }


def write_export(path: str, tables: dict[str, DataFrame], facts: dict) -> None:
    """One folder for each table, and a manifest beside them."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(facts | {"tables": sorted(tables)}, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
