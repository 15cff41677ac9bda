"""The record, and how the driver's tables become records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import canon
from .storage import table as read
from .storage import texts

_LIST = T.ArrayType(T.StringType())
_COUNTS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("count", T.IntegerType())]))
_KINDS = {
    "query_variants": _LIST, "geographic_terms": _LIST, "cleaning_notes": _LIST, "analysis_tokens": _LIST,
    "year": T.IntegerType(), "evidence_weight": T.IntegerType(), "text_length": T.IntegerType(), "word_count": T.IntegerType(), "paragraph_count": T.IntegerType(),
    "source_weight_factor": T.DoubleType(), "pdf_text_length": T.IntegerType(), "pdf_page_count": T.IntegerType(), "analysis_token_count": T.IntegerType(),
    "top_unigrams": _COUNTS, "top_bigrams": _COUNTS, "top_trigrams": _COUNTS,
}
_FIELDS = """query query_variants geographic_scope geographic_terms year source_type source_type_confidence source_type_evidence evidence_level
evidence_weight medium url title published_date language country text_raw_visible text_clean text_normalized text_length word_count paragraph_count
cleaning_notes source_api fetched_at status error pdf_url pdf_file pdf_status source_weight_factor pdf_text_clean pdf_text_length pdf_page_count
analysis_tokens analysis_token_count top_unigrams top_bigrams top_trigrams processing_status""".split()
#: A record as it is read and written.
RECORD = T.StructType([T.StructField(f, _KINDS.get(f, T.StringType())) for f in _FIELDS])

GENRE_OF = ("news", "forum", "institutional_report", "scientific_article", "industry_report", "other")


def records_from_documents(docs: DataFrame) -> DataFrame:
    """Documents as records. Year, genre, title, status and address are derived; they are synthetic."""
    genre = F.array(*[F.lit(g) for g in GENRE_OF])
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.col("text").alias("text_clean"),
        canon(F.col("text")).alias("text_normalized"),
        F.col("source").alias("medium"),
        F.col("lang").alias("language"),
        F.col("n_chars").cast("int").alias("text_length"),
        F.substring("text", 1, 60).alias("title"),
        (F.lit(2018) + F.col("doc_id") % 7).cast("int").alias("year"),
        F.get(genre, (F.col("doc_id") % 6).cast("int")).alias("source_type"),
        F.when(F.col("n_chars") >= 600, "ok").when(F.col("n_chars") >= 30, "ok_partial").otherwise("too_short").alias("status"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("").alias("published_date"),
        F.lit("").alias("fetched_at"),
        F.lit("documents").alias("source_api"),
        F.lit("").alias("country"),
        F.lit("").alias("geographic_scope"),
        F.lit("").alias("error"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_from_documents(texts(spark, sf_dir, "documents"))


#: The same in DuckDB's SQL, as the view ``r``.
RECORDS_SQL = r"""r AS (
  SELECT doc_id AS ord, text AS text_clean,
         regexp_replace(regexp_replace(translate(lower(text), 'áéíóúüñ', 'aeiouun'), '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', 'Z', 'g') AS text_normalized,
         source AS medium, lang AS language, n_chars::INTEGER AS text_length, substring(text, 1, 60) AS title,
         (2018 + doc_id % 7)::INTEGER AS year,
         ['news', 'forum', 'institutional_report', 'scientific_article', 'industry_report', 'other'][(doc_id % 6 + 1)::INTEGER] AS source_type,
         CASE WHEN n_chars >= 600 THEN 'ok' WHEN n_chars >= 30 THEN 'ok_partial' ELSE 'too_short' END AS status,
         'doc://' || doc_id AS url, '' AS published_date, '' AS fetched_at, 'documents' AS source_api
  FROM documents)"""
