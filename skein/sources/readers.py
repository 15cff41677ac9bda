"""Corpora, seed lists and public indexes as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import first_set, squeeze
from ..schema import RECORD

#: Tried in this order where a folder holds several.
CORPUS_FILES = ("news_records.jsonl", "news_records.json", "news_records_recleaned.json")
SEED_ALIASES = {"url": ("url", "link"), "title": ("title", "titulo"), "medium": ("medium", "medio"), "date": ("date", "fecha"), "source_type": ("source_type", "tipo"), "source_type_evidence": ("source_type_evidence",)}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_json(spark: SparkSession, path: str, schema: T.StructType = RECORD, strict: bool = False) -> DataFrame:
    """Records from lines of JSON, or from a file that holds an array.

    Broken lines are left out, and only they; ``strict`` fails on them instead.
    """
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    reader = spark.read.schema(schema).option("mode", mode)
    return reader.json(path) if path.endswith(".jsonl") else reader.option("multiLine", True).json(path)


def read_corpus(spark: SparkSession, path: str, in_order: bool = False) -> DataFrame:
    """A file, or a folder: the first of its usual files, else all its JSON files. ``in_order``: of year, medium and title, which sorts the whole corpus."""
    if path.endswith((".json", ".jsonl")):
        found = read_json(spark, path)
    else:
        name = next((f for f in CORPUS_FILES if _exists(spark, f"{path}/{f}")), None)
        found = read_json(spark, f"{path}/{name}") if name else spark.read.schema(RECORD).option("mode", "DROPMALFORMED").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return found.orderBy("year", "medium", "title") if in_order else found


def broken_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Lines that aren't records, with their file: why a corpus is smaller than its files."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("file"))
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.filter((F.trim("value") != "") & (F.col("r._corrupt_record").isNotNull() | F.col("r").isNull())).select("file", "value")


def read_seeds(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Seed lists with names in two languages; rows without address or date go, a year alone is its first of January."""
    files = [p.strip() for p in paths.split(",")] if isinstance(paths, str) else list(paths)
    names = sorted({a for v in SEED_ALIASES.values() for a in v} | {"year"})
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("multiLine", True).json(files)
    rows = raw.select(*[first_set(*[F.col(a) for a in v]).alias(k) for k, v in SEED_ALIASES.items()], F.col("year").alias("y"))
    when = first_set(F.col("date"), F.col("y"))
    day = F.coalesce(*[F.try_to_timestamp(when, F.lit(f)) for f in ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd", "yyyy")]).cast("date")
    return rows.select("url", "title", "medium", "source_type", "source_type_evidence", day.alias("published"), F.year(day).alias("year")).filter((F.col("url") != "") & F.col("published").isNotNull())


def seeds_from_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """Addresses in any text, each once."""
    return lines.select(F.explode(F.regexp_extract_all(column, F.lit(r"https?://[^\s\"'<>)\]]+"), 0)).alias("url")).select(F.rtrim("url", F.lit(".,;")).alias("url")).distinct()


def openalex_records(items: DataFrame) -> DataFrame:
    """Works of an index with inverted abstracts: the abstract is put together by the places of its words.

    ``items``: ``id, title, publication_year, doi, abstract_inverted_index map<string, array<int>>``.
    """
    placed = F.flatten(F.transform(F.map_entries("abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    abstract = F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")
    return items.select("id", "title", F.col("publication_year").alias("year"), F.lower(F.regexp_extract("doi", r"10\.[0-9]{4,9}/\S+", 0)).alias("doi"), F.coalesce(abstract, F.lit("")).alias("text_clean"), F.lit("scientific_article").alias("source_type"))


def crossref_records(items: DataFrame) -> DataFrame:
    """Works with markup in their abstracts: ``DOI, title, abstract, link array<struct<URL, content-type>>, year``."""
    pdf = F.get(F.filter("link", lambda x: F.contains(F.lower(x["content-type"]), F.lit("pdf"))), F.lit(0))["URL"]
    return items.select(F.lower("DOI").alias("doi"), "title", "year", squeeze(F.regexp_replace(F.coalesce("abstract", F.lit("")), "<[^>]+>", " ")).alias("text_clean"), F.coalesce(pdf, F.lit("")).alias("pdf_url"))


def redalyc_records(items: DataFrame, years: Sequence[int]) -> DataFrame:
    """Works of the given years, their PDF addressed by number: ``cveArticulo, titulo, resumen, anio``."""
    pdf = F.when(F.coalesce("cveArticulo", F.lit("")) != "", F.concat(F.lit("https://www.redalyc.org/pdf/"), "cveArticulo", F.lit(".pdf"))).otherwise("")
    return items.filter(F.col("anio").isin(*years)).select(F.col("titulo").alias("title"), F.col("anio").alias("year"), squeeze(F.col("resumen")).alias("text_clean"), pdf.alias("pdf_url"))


def read_feed(spark: SparkSession, path: str, start: str, end: str, keep_undated: bool = False) -> DataFrame:
    """Items of RSS files from ``start`` to a day after ``end``; forums keep undated items, news don't."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, source string").load(path)
    # Java's E can't be parsed, so the day's name goes first.
    stamp = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    rows = items.withColumn("published", stamp)
    inside = F.col("published").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return rows.filter(F.coalesce(inside, F.lit(keep_undated)))


def month_periods(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Calendar months from ``start`` to ``end``, the first and last cut to them; each ends a second before the next."""
    days = spark.range(1).select(F.explode(F.sequence(F.date_trunc("month", F.lit(start).cast("date")).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    last = F.least(F.last_day("m"), F.lit(end).cast("date"))
    return days.select(F.greatest("m", F.lit(start).cast("date")).cast("timestamp").alias("start"), (last.cast("timestamp") + F.expr("INTERVAL 86399 SECONDS")).alias("end"))


class IndexSource(DataSource):
    """A paged index of articles as a table: a partition for each query and month.

    Options: ``queries`` (one a line), ``months`` (yyyy-MM, comma-joined), and
    ``folder``, where answers have been saved as ``<query>/<month>.jsonl``. A
    live index needs only another :meth:`IndexReader.read`.
    """

    @classmethod
    def name(cls) -> str:
        return "article_index"

    def schema(self) -> str:
        return "query string, month string, url string, title string, domain string"

    def reader(self, schema: T.StructType) -> IndexReader:
        return IndexReader(self.options)


class IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = [q for q in options.get("queries", "").split("\n") if q]
        self.months = [m for m in options.get("months", "").split(",") if m]
        self.folder = options.get("folder", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((q, m)) for q in self.queries for m in self.months]

    def read(self, partition: InputPartition):
        import json
        from pathlib import Path

        query, month = partition.value
        path = Path(self.folder, query, f"{month}.jsonl")
        for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else ():
            row = json.loads(line)
            yield query, month, row.get("url"), row.get("title"), row.get("domain")
