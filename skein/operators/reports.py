"""Reports over records, events and plans: one row per group, ready to be shown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.keys import domain, event_key, record_text
from ..functions.text import first_set, tokenize
from .records import genre, usable
from .terms import repeated_grams, tokens_kept

STAGES = tuple(lexicon.EVENT_STAGES)
#: How often an n-gram has to be there to count as a relation.
RELATIONS_LEAST = 2


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the greatest ``order``; rows without a key go. The winner is found by aggregation, which combines before the shuffle."""
    one = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("x"))
    return one.select(key, "x.*")


def with_events(records: DataFrame, events: DataFrame, order: str = "ord") -> DataFrame:
    """Records with the columns of the event of their address, or of their year, medium and title: of several the last by ``order``. Others get nulls."""
    names = [c for c in events.columns if c not in records.columns and c != "doc_key"]
    return records.withColumn("doc_key", event_key()).join(last_by(events, "doc_key", order).select("doc_key", *names), "doc_key", "left")


def with_sentiment(records: DataFrame, scored: DataFrame, order: str = "ord") -> DataFrame:
    """Records with the columns of sentiment of their address that they don't have themselves; of several scores the last."""
    names = [c for c in scored.columns if c not in records.columns and c != "url"]
    return records.join(last_by(scored.select("url", order, *[n for n in names if n != order]), "url", order).select("url", *names), "url", "left")


def core_metrics(records: DataFrame, events: DataFrame, found_actors: DataFrame, stages: Sequence[str] = STAGES, stopwords: Sequence[str] = ()) -> DataFrame:
    """One row on a corpus: its documents by genre, actors, stages of events, thematic relations, sources and years."""
    kinds = {"news": "news", "forums": "forum", "scientific_articles": "scientific_article", "institutional_reports": "institutional_report"}
    own = records.agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.count_if(genre() == g).alias(n) for n, g in kinds.items()],
        F.count_distinct(first_set(F.col("medium"), F.lit("unknown"))).alias("sources"),
        F.count_distinct("year").alias("temporal_markers"),
    )
    hits = events.agg(F.coalesce(F.sum(sum((F.when(F.coalesce(s, F.lit("")) != "", 1).otherwise(0) for s in stages), F.lit(0))), F.lit(0)).alias("events_or_stages"))
    names = found_actors.select(F.explode("actors").alias("a")).distinct().agg(F.count(F.lit(1)).alias("actors"))
    kept = tokens_kept(records, stopwords)
    grams = [repeated_grams(kept, n, RELATIONS_LEAST).agg(F.count(F.lit(1)).alias(f"r{n}")) for n in (2, 3)]
    out = own  # each side is one row
    for side in (hits, names, *grams):
        out = out.crossJoin(side)
    return out.withColumn("thematic_relations", F.col("r2") + F.col("r3")).drop("r2", "r3")


def timeline(records: DataFrame, events: DataFrame, top: int = 5, stopwords: Sequence[str] = ()) -> DataFrame:
    """One row per year and genre: documents, sources, the commonest terms, documents with conflict, change and consequences, and mean length."""
    by = ["year", "genre"]
    rows = with_events(records.filter("year IS NOT NULL"), events.select("doc_key", F.col("ord").alias("x_order"), "conflict", "turning_point", "consequences"), "x_order").withColumn("genre", genre())

    def has(stage: str) -> Column:
        return F.count_if(F.coalesce(stage, F.lit("")) != "")

    length = F.length(first_set(F.col("text_normalized"), F.col("text_clean")))
    whole = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct(first_set(F.col("medium"), F.lit("unknown"))).alias("sources"),
        has("conflict").alias("conflict_docs"), has("turning_point").alias("change_docs"), has("consequences").alias("consequence_docs"), F.round(F.avg(length), 1).alias("mean_text_length"),
    )
    place = F.col("ord").cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col("pos")
    grams = records.filter("year IS NOT NULL").select("year", genre().alias("genre"), "ord", F.posexplode(tokenize(record_text(), stopwords)).alias("pos", "term"))
    counts = grams.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"), F.min(place.cast("decimal(31,0)")).alias("f"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "f"))).filter(F.col("k") <= top)
    best = ranked.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), ", ").alias("top_terms"))
    return whole.join(best, by, "left").withColumn("top_terms", F.coalesce("top_terms", F.lit(""))).withColumnRenamed("genre", "source_type")


def site_query(topic: Sequence[str], places: Sequence[str]) -> Column:
    """A search within a domain for any of the terms, and any of the places."""

    def either(terms: Sequence[str]) -> str:
        seen: dict[str, str] = {}
        for t in map(str.strip, terms):
            seen.setdefault(t.lower(), t)
        seen.pop("", None)
        return " OR ".join(f'"{t}"' if " " in t else t for t in seen.values())

    parts = [f"({t})" for t in (either(topic), either(places)) if t]
    return F.concat_ws(" ", *map(F.lit, parts), F.concat(F.lit("(domain:"), F.col("domain"), F.lit(")")))


def seed_strategy(seeds: DataFrame, topic: Sequence[str], places: Sequence[str] = (), top: int = 6) -> DataFrame:
    """One row per domain of seed addresses (``ord, url, medium, date``): how many there are, its commonest sections and years, and a query within it.

    Sections are first segments of paths, commonest first, of equals the first
    seen. Addresses without a domain go.
    """
    full = F.when(F.col("url").rlike("^https?://"), F.col("url")).otherwise(F.concat(F.lit("https://"), F.col("url")))
    section = F.get(F.filter(F.split(F.regexp_extract(full, r"^https?://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != ""), F.lit(0))
    date = F.coalesce("date", F.lit(""))
    year = F.when(date.rlike("[0-9]{4}$"), F.right(date, F.lit(4))).when(date.rlike("^[0-9]{4}"), F.substring(date, 1, 4))
    rows = seeds.select("ord", domain(F.col("url")).alias("domain"), first_set(F.col("medium"), domain(F.col("url"))).alias("medium"), section.alias("section"), year.alias("year")).filter("domain <> ''")
    whole = rows.groupBy("domain").agg(F.min_by("medium", "ord").alias("medium"), F.count(F.lit(1)).alias("seed_urls"), F.array_join(F.array_sort(F.collect_set("year")), ", ").alias("years_seen"), F.min_by(F.coalesce("section", F.lit("")), "ord").alias("x_first"))
    counts = rows.filter("section IS NOT NULL").groupBy("domain", "section").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("f"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "f"))).filter(F.col("k") <= top)
    best = ranked.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "section"))), lambda x: x["section"]), ", ").alias("dominant_sections"))
    form = F.concat(F.lit("https://"), F.col("domain"), F.when(F.col("x_first") != "", "/<section>/<slug>").otherwise("/<slug>"))
    return whole.join(best, "domain", "left").select(
        "medium", "domain", "seed_urls", F.coalesce("dominant_sections", F.lit("")).alias("dominant_sections"), "years_seen", form.alias("url_pattern"), site_query(topic, places).alias("recommended_query")
    )


def profiles(catalogue: DataFrame, paywalled: bool = False, **wanted: Sequence[str]) -> DataFrame:
    """``domain`` of the profiles that fit all given facets whatever their case, each once, in the order of ``ord``; paywalled ones only if asked for."""
    rows = catalogue if paywalled else catalogue.filter(F.coalesce("access", F.lit("")) != "paywall")
    for facet, values in wanted.items():
        values = [v.lower() for v in values if v.strip()]
        rows = rows.filter(F.lower(F.coalesce(facet, F.lit(""))).isin(*values)) if values else rows
    return rows.select("ord", domain(F.col("domain")).alias("domain")).filter("domain <> ''").groupBy("domain").agg(F.min("ord").alias("ord"))


def planned_balance(records: DataFrame, targets: Mapping[str, int], years: Sequence[int], cap: int, seen: DataFrame | None = None) -> DataFrame:
    """One row per year and genre of a plan: usable records, or what a log says if that is more, against the least and the most."""
    spark = records.sparkSession
    plan = spark.createDataFrame([(y, g, n) for y in years for g, n in targets.items()], "year int, source_type string, minimum_target int")
    counts = records.filter(usable()).groupBy("year", genre().alias("source_type")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts if seen is None else counts.unionByName(seen.select("year", "source_type", F.col("n").cast("long").alias("n"))).groupBy("year", "source_type").agg(F.max("n").alias("n"))
    have, least = F.col("actual_usable"), F.col("minimum_target")
    rows = plan.join(counts, ["year", "source_type"], "left").withColumn("actual_usable", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    return rows.select(
        "year", "source_type", F.concat_ws("/", have.cast("string"), least.cast("string")).alias("counter"), "actual_usable", "minimum_target",
        F.greatest(F.lit(0), least - have).alias("gap_to_min"), F.lit(cap).alias("maximum_cap"), F.greatest(F.lit(0), F.lit(cap) - have).alias("cap_remaining"),
        F.when(least == 0, 1.0).otherwise(F.round(have / F.greatest(F.lit(1), least), 3)).alias("progress_to_min"), F.when(have >= least, "ok").otherwise("under_target").alias("status"),
    )


# How a run reports what it accepted and where it stands.
ACCEPTED = r"^(ok|ok_partial|too_short):\s*(\d{4})\s*·\s*([a-z_]+)\s+(\d+)/min"
STANDING = r"balance_status:\s*(\d{4})-\d{2}\s*·\s*(.*)"


def log_counts(lines: DataFrame, least_chars: int = 100) -> DataFrame:
    """``year, source_type, n`` of log ``message``s: the most that any says of each. Partial texts count if their length is given and enough."""
    m = F.col("message")
    status, size = F.regexp_extract(m, ACCEPTED, 1), F.regexp_extract(m, r"·\s*len=(\d+)\b", 1)
    counts = (status == "ok") | ((status == "ok_partial") & (size != "") & (F.coalesce(size.try_cast("long"), F.lit(0)) >= least_chars))
    one = F.array(F.struct(F.regexp_extract(m, ACCEPTED, 3).alias("source_type"), F.regexp_extract(m, ACCEPTED, 4).alias("n")))
    parts = F.split(F.regexp_extract(m, STANDING, 2), ",")
    several = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"([a-z_]+)=(\d+)/min", 1).alias("source_type"), F.regexp_extract(p, r"([a-z_]+)=(\d+)/min", 2).alias("n")))
    accepted = status != ""
    found = F.when(accepted & counts, one).when(~accepted, several)
    year = F.when(accepted, F.regexp_extract(m, ACCEPTED, 2)).otherwise(F.regexp_extract(m, STANDING, 1))
    rows = lines.filter(m.isNotNull()).select(year.alias("year"), F.explode(found).alias("x")).filter("year <> '' AND x.n <> ''")
    return rows.groupBy(F.col("year").cast("int").alias("year"), F.col("x.source_type").alias("source_type")).agg(F.max(F.col("x.n").cast("long")).alias("n"))
