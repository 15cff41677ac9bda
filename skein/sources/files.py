"""Folders of record files: which files hold records, and why the others don't.

Files are judged where Spark lists and reads them, on any file system; nothing
opens a path by itself. A file of lines with one broken line is dropped whole, and
of a file of lines and one of an array with the same stem the lines are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RECORD

# Names that hold no records, and the reasons that reports give.
IGNORED = ("query_plan.json", "run_manifest.json", "merge_report.json")
EMPTY, BROKEN = "empty_or_json_empty_array", "parse_error_or_no_dict_rows"
#: Bytes up to which a file is empty.
LEAST_BYTES = 2
LINES, WHOLE = "*.jsonl", "*.json"


def _under(spark: SparkSession, kind: str, pattern: str):
    return spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def listed(spark: SparkSession, folder: str, lines: str = LINES, whole: str = WHOLE) -> DataFrame:
    """``path, length, modified, by_line``: the files that may hold records. Contents aren't read. Spark lists no files of no bytes."""
    found = None
    for pattern, by_line in ((lines, True), (whole, False)):
        part = _under(spark, "binaryFile", pattern).load(folder).select(F.col("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("modified"), F.lit(by_line).alias("by_line"))
        found = part if found is None else found.unionByName(part)
    found = found.filter(~F.element_at(F.split("path", "/"), -1).isin(*IGNORED))
    better = found.filter("by_line").select(_stem(F.col("path")).alias("x_stem"))
    return found.join(better, (_stem(F.col("path")) == F.col("x_stem")) & ~F.col("by_line"), "left_anti")


def _values(spark: SparkSession, folder: str, lines: str, whole: str) -> DataFrame:
    """``path, place, value, broken``: what each line says, or each element of an array; null where that is no object."""
    text = _under(spark, "text", lines).load(folder).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("place"), F.trim("value").alias("value")).filter("value <> ''")
    read = text.withColumn("v", F.try_parse_json("value")).select("path", "place", "v", F.col("v").isNull().alias("broken"))
    one = _under(spark, "text", whole).option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    items = F.when(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    whole_rows = one.select("path", F.col("v").isNull().alias("broken"), F.posexplode_outer(items).alias("place", "v")).select("path", F.col("place").cast("long"), "v", "broken")
    both = read.unionByName(whole_rows)
    return both.select("path", "place", "broken", F.when(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.to_json("v")).alias("value"))


def verdicts(spark: SparkSession, folder: str, lines: str = LINES, whole: str = WHOLE) -> DataFrame:
    """``path, length, modified, by_line, rows, reason``: one row per file; without records the reason isn't empty, and ``rows`` is 0."""
    counts = _values(spark, folder, lines, whole).groupBy("path").agg(F.count("value").alias("n"), F.max("broken").alias("broken"))
    rows = F.when(F.coalesce("broken", F.lit(False)), 0).otherwise(F.coalesce("n", F.lit(0)))
    reason = F.when(F.col("length") <= LEAST_BYTES, EMPTY).when(rows == 0, BROKEN).otherwise("")
    return listed(spark, folder, lines, whole).join(counts, "path", "left").select("path", "length", "modified", "by_line", rows.alias("rows"), reason.alias("reason"))


def records(spark: SparkSession, folder: str, lines: str = LINES, whole: str = WHOLE) -> DataFrame:
    """The records of the files that hold any, with ``path`` and ``place`` in it."""
    good = verdicts(spark, folder, lines, whole).filter("reason = ''").select("path")
    rows = _values(spark, folder, lines, whole).filter("value IS NOT NULL").join(good, "path", "left_semi")
    return rows.select("path", "place", F.from_json("value", RECORD).alias("r")).select("path", "place", "r.*")


def report(spark: SparkSession, folder: str, source: Column | None = None, lines: str = LINES, whole: str = WHOLE) -> DataFrame:
    """One row per source, by default the file's folder: ``files_found, files_with_rows, rows_seen, read_failures_or_empty, unavailable_reasons``."""
    own = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) if source is None else source
    of = verdicts(spark, folder, lines, whole).withColumn("source_key", own)
    each = of.groupBy("source_key", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    bad = F.col("reason") != ""
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(bad, F.struct("reason", "n")))))
    return each.groupBy("source_key").agg(
        F.sum("n").alias("files_found"), F.coalesce(F.sum(F.when(~bad, F.col("n"))), F.lit(0)).alias("files_with_rows"), F.sum("rows").alias("rows_seen"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("read_failures_or_empty"), reasons.alias("unavailable_reasons"),
    )
