"""Aggregations over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.keys import document_key
from ..functions.text import first_set, squeeze
from .records import genre, label, usable


def count_rows(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Records by fields, most first."""
    return records.groupBy(*fields).agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), *fields)


def distribution(records: DataFrame) -> DataFrame:
    """Usable records by year, by year and genre, and by year, genre and medium, in one pass of grouping sets; ``level`` says which."""
    rows = records.filter(usable()).select("year", genre().alias("source_type"), label(F.col("medium")).alias("medium"))
    y, t, m = F.col("year"), F.col("source_type"), F.col("medium")
    return rows.groupingSets([[y], [y, t], [y, t, m]], y, t, m).agg(F.count(F.lit(1)).alias("records"), (3 - F.grouping("source_type") - F.grouping("medium")).cast("int").alias("level"))


def evidence_counts(records: DataFrame) -> DataFrame:
    """Records by medium and rank of evidence."""
    from .records import from_map

    rank = from_map({k: v[1] for k, v in lexicon.EVIDENCE.items()}, genre())
    level = from_map({k: v[0] for k, v in lexicon.EVIDENCE.items()}, genre())
    return records.groupBy(label(F.col("medium")).alias("medium"), level.alias("evidence_level"), rank.alias("evidence_weight")).agg(F.count(F.lit(1)).alias("records"))


def audit(records: DataFrame) -> DataFrame:
    """Counts by one dimension at a time, with the groups of duplicates and the rows that they have too many."""
    dims = ("status", "source_type", "source_api", "year")
    rows = records.select(*[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dims])
    by = rows.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("records"), F.grouping_id().alias("g"))
    name = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(dims) for x in (15 - (8 >> i), d)]), F.col("g").cast("int"))
    counted = by.select(name.alias("dimension"), F.coalesce(*dims).alias("value"), "records")
    keys = records.select(document_key(F.col("url"), F.col("title"), F.col("year"), F.col("medium")).alias("k")).groupBy("k").count().filter("k <> '' AND count > 1")
    extra = keys.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_extra_records"))
    extra = extra.selectExpr("'deduplication' AS dimension", "stack(2, 'duplicate_groups', duplicate_groups, 'duplicate_extra_records', duplicate_extra_records) AS (value, records)")
    total = records.agg(F.count(F.lit(1)).alias("records")).select(F.lit("total_records").alias("dimension"), F.lit("all").alias("value"), "records")
    return total.unionByName(extra).unionByName(counted)


def annual_coverage(records: DataFrame, target: int = 100) -> DataFrame:
    """Usable news of each year against a target."""
    news = usable() & (genre() == "news")
    out = records.filter(F.col("year").isNotNull()).groupBy("year").agg(
        F.count_if(news).alias("usable_news"),
        F.count_if(news & (F.col("status") == "ok")).alias("full_text_news"),
        F.count_if(news & F.col("status").isin("ok_partial", "too_short")).alias("partial_news"),
    )
    return out.withColumns(
        {
            "target_news": F.lit(target),
            "gap_to_target": F.greatest(F.lit(0), F.lit(target) - F.col("usable_news")),
            "coverage_ratio": F.round(F.col("usable_news") / F.lit(max(1, target)), 3),
            "status": F.when(F.col("usable_news") >= target, "ok").otherwise("insufficient_sample"),
        }
    )


def genre_coverage(records: DataFrame, least: int = 1, most: int = 100) -> DataFrame:
    """Usable records of each year by genre, as columns, with gaps and what is missing."""
    kinds = lexicon.GENRES
    out = records.filter(usable() & F.col("year").isNotNull()).withColumn("g", genre()).groupBy("year").pivot("g", list(kinds)).count()
    out = out.na.fill(0, list(kinds)).withColumn("usable_total", sum(F.col(k) for k in kinds))
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(k) < least, F.lit(k)) for k in kinds]), lambda k: k.isNotNull()), ",")
    return out.withColumns(
        {f"{k}_gap_to_min": F.greatest(F.lit(0), F.lit(least) - F.col(k)) for k in kinds}
        | {f"{k}_cap_remaining": F.greatest(F.lit(0), F.lit(most) - F.col(k)) for k in kinds}
        | {
            "organic_conversation_status": F.when(F.col("forum") > 0, "ok").otherwise("missing_forums"),
            "source_balance_status": F.when(missing == "", "ok").otherwise(F.concat(F.lit("missing_or_under_target:"), missing)),
        }
    )


def source_status(records: DataFrame, least: int = 0, most: int = 100) -> DataFrame:
    """State of each year, genre and medium: counts by status, gaps, and the last error by input order."""
    states = ("ok", "ok_partial", "too_short", "fetch_error", "error")
    out = records.filter(F.col("year").isNotNull()).groupBy("year", genre().alias("source_type"), label(F.col("medium")).alias("medium")).agg(
        F.count_if(usable()).alias("usable"),
        *[F.count_if(F.col("status") == s).alias(s) for s in states],
        F.array_join(F.array_sort(F.collect_set(F.nullif("source_api", F.lit("")))), ", ").alias("source_api"),
        F.coalesce(F.max_by("error", F.when(F.col("error") != "", F.col("ord"))), F.lit("")).alias("last_error"),
    )
    return out.withColumns(
        {"target_min": F.lit(least), "gap_to_min": F.greatest(F.lit(0), F.lit(least) - F.col("usable")), "target_max": F.lit(most), "cap_remaining": F.greatest(F.lit(0), F.lit(most) - F.col("usable"))}
    )


def social_balance(records: DataFrame) -> DataFrame:
    """One row: whether news and forums are there beside research."""
    kinds = ("news", "forum", "scientific_article", "industry_report", "other")
    out = records.filter(usable()).agg(F.count(F.lit(1)).alias("usable_total"), *[F.count_if(genre() == k).alias(k) for k in kinds])
    share = F.col("scientific_article") / F.greatest(F.lit(1), F.col("usable_total"))
    lacking = (F.col("news") == 0) | (F.col("forum") == 0)
    status = F.when((share >= 0.8) & lacking, "not_valid_for_social_narrative").when(lacking, "incomplete_social_layers").otherwise("social_layers_present")
    return out.withColumns({"scientific_share": F.round(share, 4), "status": status})


def ranked_shares(rows: DataFrame, value: str, order: Sequence[Column], core: float) -> DataFrame:
    """Adds rank, share, running share and whether a row is of the core: the running share is at most ``core``, or it is the first.

    ``rows`` are aggregates, a row for each source or term: the window over all of them is small beside the records.
    """
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(*order)
    total = F.sum(value).over(everything)
    running = F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns(
        {
            "rank": F.row_number().over(ordered),
            "weight_share": F.round(F.try_divide(F.col(value), total), 5),
            "cumulative_weight_share": F.round(F.try_divide(running, total), 5),
            "core": (F.try_divide(running, total) <= core) | (F.row_number().over(ordered) == 1),
        }
    )


def cartography(records: DataFrame, core: float = 0.80) -> DataFrame:
    """Sources by weight: records, years, addresses, main genre, and the core that carries most of the weight."""
    text = squeeze(first_set(F.col("text_clean"), F.col("title")))
    rows = records.select(label(squeeze(F.col("medium"))).alias("source"), "year", genre().alias("g"), "status", "url", F.length(text).alias("n"), "ord")
    out = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("n").alias("total_text_length"),
        F.round(F.sum(1.0 + F.least(F.lit(2.0), F.col("n") / 2500)), 6).alias("structural_weight"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count_distinct("year").alias("active_years"),
        F.count_if(F.col("status") == "ok").alias("ok_records"),
        F.count_if(F.col("status") == "ok_partial").alias("partial_records"),
        F.count_distinct(F.nullif("url", F.lit(""))).alias("unique_urls"),
    )
    # The commonest genre, the one that was seen first if several are.
    main = rows.groupBy("source", "g").agg(F.count(F.lit(1)).alias("k"), F.min("ord").alias("o")).groupBy("source").agg(F.max_by("g", F.struct("k", -F.col("o"))).alias("source_type_main"))
    ranked = ranked_shares(out.join(main, "source"), "structural_weight", [F.desc("structural_weight"), F.desc("records"), F.col("source")], core)
    return ranked.withColumnRenamed("core", "pareto_core")
