"""Row-wise operators on records: usability, enrichment, classification, filters and scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.keys import domain, record_custody_hash, record_text
from ..functions.text import count_substring, count_word, first_set, fold, fold_squeeze, let, markers_in, squeeze, tokenize, words, worked_out

MIN_PARTIAL_CHARS = 100


def usable() -> Column:
    """Full text that isn't empty, or partial text of 100 characters at least."""
    text = first_set(F.col("text_normalized"), F.col("text_clean"))
    long = (F.length(text) >= MIN_PARTIAL_CHARS) | (F.coalesce(F.col("text_length"), F.lit(0)) >= MIN_PARTIAL_CHARS)
    return F.coalesce(F.when(F.col("status") == "ok", text != "").when(F.col("status") == "ok_partial", long), F.lit(False))


def label(column: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("unknown"))


def language_name(code: Column) -> Column:
    name = label(code)
    low = F.lower(name)
    return F.when(low.startswith("spanish") | low.isin("es", "spa"), "Spanish").when(low.startswith("english") | low.isin("en", "eng"), "English").otherwise(name)


def from_map(values: Mapping[str, object], key: Column, default: str = "other") -> Column:
    """A small fixed map as an expression; unknown keys take the default's value."""
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, key), F.lit(values[default]))


def genre() -> Column:
    return first_set(F.col("source_type"), F.lit("other"))


def flow_order(source_type: Column) -> Column:
    return from_map({k: v[0] for k, v in lexicon.FLOW.items()}, F.lower(F.trim(source_type)))


def flow_stage(source_type: Column) -> Column:
    return from_map({k: v[1] for k, v in lexicon.FLOW.items()}, F.lower(F.trim(source_type)))


def _head(text: Column, most: int | None) -> Column:
    return text if most is None else F.substring(text, 1, most)


def localization(mexico: Sequence[str] = lexicon.MEXICO_TERMS, wider: Sequence[str] = lexicon.LATAM_TERMS, most_chars: int | None = 5000, geographic_terms: Column | None = None) -> Column:
    """``localization, mexico_score, localization_evidence`` as a struct: marks of country, domain, scope and text add up.

    ``geographic_terms``: an array of declared places, read like the scope.
    ``most_chars`` of the text are searched, all of it with ``None``.
    """

    def hits(terms):
        return let(F.array(text, plain), lambda x: F.size(F.filter(words(sorted(terms)), lambda t: F.contains(x[0], t) | F.contains(x[1], t))))

    def is_in(c, *names):
        return F.coalesce(F.lower(F.col(c)).isin(*names), F.lit(False))

    medium, scope = F.lower(F.coalesce("medium", F.lit(""))), F.lower(F.coalesce("geographic_scope", F.lit("")))
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), _head(record_text(), most_chars)))
    plain = fold(text)
    country = is_in("country", "mx", "mexico", "méxico")
    host = medium.endswith(".mx") | medium.contains(".com.mx") | medium.contains(".gob.mx") | medium.contains(".edu.mx")
    if geographic_terms is not None:
        scope = F.concat_ws(" ", scope, F.lower(F.array_join(F.coalesce(geographic_terms, F.array().cast("array<string>")), " ")))
    declared = scope.contains("mexico") | scope.contains("méxico")
    near, far = hits(mexico), hits(wider)
    far = F.when(near == 0, far).otherwise(0)
    score = F.when(country, 4).otherwise(0) + F.when(host, 4).otherwise(0) + F.when(declared, 2).otherwise(0) + F.least(F.lit(3), near) + F.least(F.lit(1), far)
    evidence = F.concat_ws(
        ", ",
        F.when(country, "source_country_mx"),
        F.when(host, "mexican_domain"),
        F.when(declared, "declared_mexico_scope"),
        F.when(near > 0, F.concat(F.lit("mexico_text_mentions:"), near.cast("string"))),
        F.when(far > 0, F.concat(F.lit("latam_text_mentions:"), far.cast("string"))),
    )
    name = F.when(score >= 5, "Mexico-focused").when(score >= 2, "Mexico-mentioned").when(hits(wider) > 0, "Latin-America-mentioned").otherwise("Global/unclear")
    return F.struct(name.alias("localization"), score.alias("mexico_score"), evidence.alias("localization_evidence"))


def enrich(records: DataFrame) -> DataFrame:
    """Adds language, flow and localisation."""
    out = records.withColumns({"source_type": genre(), "analysis_language": language_name(F.col("language"))})
    out = out.withColumns({"narrative_flow_order": flow_order(F.col("source_type")), "narrative_flow_stage": flow_stage(F.col("source_type")), "x_where": localization(geographic_terms=F.col("geographic_terms") if "geographic_terms" in records.columns else None)})
    return out.withColumns({c: F.col(f"x_where.{c}") for c in ("localization", "mexico_score", "localization_evidence")}).drop("x_where")


def filter_records(records: DataFrame, **facets: Sequence) -> DataFrame:
    """Usable records, enriched, whose columns are among the given values; an empty choice filters nothing."""
    columns = {"source_types": "source_type", "years": "year", "media": "medium", "languages": "analysis_language", "localizations": "localization"}
    out = enrich(records.filter(usable()))
    for facet, chosen in facets.items():
        if chosen:
            default = F.lit(0) if facet == "years" else F.lit("unknown")
            out = out.filter(F.coalesce(F.col(columns[facet]), default).isin(*chosen))
    return out


def exclude(records: DataFrame, terms: Sequence[str], media: Sequence[str], most_chars: int | None = 8000) -> DataFrame:
    """Adds ``exclusion_reason``, empty for what stays: the medium's name goes before a term found in the first ``most_chars`` of a text, or in all of it with ``None``."""
    short = [_head(F.coalesce(c, F.lit("")), most_chars) for c in ("text_clean", "text_normalized")]
    hay = fold_squeeze(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("medium", "title", "url")], *short))
    keys = [" ".join(_plain(t).split()) for t in terms if t.strip()]
    first = F.coalesce(*[F.when(F.contains(hay, F.lit(k)), F.lit(f"excluded_term:{k}")) for k in keys], F.lit("")) if keys else F.lit("")
    by_name = fold_squeeze(F.col("medium")).isin(*[" ".join(_plain(m).split()) for m in media if m.strip()]) if media else F.lit(False)
    return records.withColumn("exclusion_reason", F.when(by_name, F.concat(F.lit("excluded_medium:"), F.coalesce("medium", F.lit("")))).otherwise(first))


def _plain(text: str) -> str:
    return text.lower().translate(str.maketrans("áéíóúüñ", "aeiouun"))


def topical_score(terms: Sequence[str]) -> Column:
    """3 for each term in the title, and its mentions in the text, 5 at most."""
    title, text = fold_squeeze(F.col("title")), fold_squeeze(first_set(F.col("text_clean"), F.col("text_normalized")))
    total = F.lit(0)
    for term in (" ".join(_plain(t).split()) for t in terms if t.strip()):
        total = total + F.when(F.contains(title, F.lit(term)), 3).otherwise(0) + F.least(F.lit(5), count_substring(text, term))
    return total.cast("int")


def relevance_score(terms: Sequence[str]) -> Column:
    """5 for each term that the title has as a word, and twice its mentions in the text, 6 at most."""
    title, text = fold(F.coalesce("title", F.lit(""))), fold(record_text())
    total = F.lit(0)
    for term in map(_plain, terms):
        total = total + F.when(count_word(title, term) > 0, 5).otherwise(0) + F.least(F.lit(6), 2 * count_word(text, term))
    return total.cast("int")


def by_topic(records: DataFrame, terms: Sequence[str], minimum: int) -> DataFrame:
    """Adds the score, and a reason to go where it is too low; 0 or less asks for nothing."""
    score = topical_score(terms)
    low = F.lit(bool(terms) and minimum > 0) & (score < minimum)
    return records.withColumns({"topical_relevance_score": score, "exclusion_reason": F.when(low, F.concat(F.lit("low_topical_relevance:"), score.cast("string"))).otherwise("")})


def has_excluded_content(terms: Sequence[str], domains: Sequence[str], most_chars: int | None = 6000) -> Column:
    """The address or medium is of an excluded domain, or the start of the text has an excluded term."""
    host = domain(F.col("url"))
    by_host = F.lit(False)
    for d in domains:
        by_host = by_host | host.endswith(d.lower()) | F.contains(F.lower(F.coalesce("medium", F.lit(""))), F.lit(d.lower()))
    hay = fold_squeeze(F.concat_ws(" ", "title", _head(record_text(), most_chars)))
    return by_host | (F.size(markers_in(hay, [_plain(t) for t in terms])) > 0)


def in_region(scope: str, terms: Sequence[str], country_codes: Sequence[str], suffixes: Sequence[str], most_chars: int | None = 4000) -> Column:
    """A record fits a region by its country, the end of its domain, or a term in the start of its text; a global scope takes all."""
    if scope.lower() in {"", "global", "all"}:
        return F.lit(True)
    host = domain(F.col("url"))
    fits = F.coalesce(F.lower(F.col("country")).isin(*[c.lower() for c in country_codes]), F.lit(False))
    for s in suffixes:
        fits = fits | host.endswith(s)
    hay = fold_squeeze(F.concat_ws(" ", "title", _head(record_text(), most_chars)))
    return fits | (F.size(markers_in(hay, [_plain(t) for t in terms])) > 0)


def classify_source(url: Column, medium: Column, title: Column, indexed: Column | None = None) -> Column:
    """``source_type, confidence, evidence``: genres are tried in the order of ``GENRE_MARKERS``; a scholarly path comes after scholarly marks."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(medium, F.lit("")), F.coalesce(title, F.lit(""))))
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))

    def has(name):
        return F.size(markers_in(hay, lexicon.GENRE_MARKERS[name])) > 0

    def found(name, confidence, evidence):
        return F.struct(F.lit(name).alias("source_type"), F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence"))

    return (
        F.when(has("scientific_article"), found("scientific_article", "high", "scientific domain/index marker"))
        .when(path.rlike(r"\bdoi\b|/article/|/abstract|/fulltext|/journal|/paper|/publication/"), found("scientific_article", "medium", "scientific URL path marker"))
        .when(has("industry_report"), found("industry_report", "high", "industry survey/report marker"))
        .when(has("institutional_report"), found("institutional_report", "high", "government/institutional marker"))
        .when(has("forum"), found("forum", "high", "forum/community domain or path marker"))
        .when(has("news"), found("news", "medium", "news domain or section marker"))
        .when(indexed if indexed is not None else F.lit(False), found("news", "low", "indexed source, no stronger genre marker"))
        .when(F.coalesce(medium, F.lit("")) != "", found("other", "low", "domain present but genre unclear"))
        .otherwise(found("other", "low", "insufficient source evidence"))
    )


def access_policy(records: DataFrame, profiles: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``access, profile_domain`` of the first profile (``ord, domain, access``), by ``ord``, that the domain ends with.

    A catalogue of any size meets the domains by equality: each distinct domain
    stands once for each length that a profile has, by its end of that length.
    Of the records only the domain is looked up afterwards. Lengths of names are
    all that comes to the driver.
    """
    known = profiles.select(F.lower("domain").alias("x_end"), F.col("access").alias("x_access"), F.col("ord").alias("x_ord")).filter("x_end <> ''")
    lengths = sorted(r[0] for r in known.select(F.length("x_end")).distinct().collect())
    ends = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("x_host")) if lengths else F.array().cast("array<int>")
    hosts = records.select(domain(F.col(url)).alias("x_host")).distinct().select("x_host", F.explode(F.transform(ends, lambda n: F.right(F.col("x_host"), n))).alias("x_end"))
    fits = hosts.join(known, "x_end").groupBy("x_host").agg(F.min_by(F.struct(F.col("x_access").alias("access"), F.col("x_end").alias("profile_domain")), "x_ord").alias("x_policy"))
    rows = records.withColumn("x_host", domain(F.col(url))).join(fits, "x_host", "left")
    found = {"access": F.coalesce("x_policy.access", F.lit("unknown")), "profile_domain": F.coalesce("x_policy.profile_domain", "x_host")}
    return rows.withColumns(found).drop("x_policy", "x_host")


def rubrics(groups: Mapping[str, Sequence[str]]) -> Column:
    """``rubrics, terms`` of a record: groups of which a term of three characters or more is anywhere in it."""
    hay = fold_squeeze(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "text_clean", "medium", "url")]))

    def found(h: Column) -> Column:
        hits = {}
        for g, terms in groups.items():
            if g not in {"núcleo", "nucleo"}:
                long = [t for t in terms if len(" ".join(_plain(t).split())) >= 3]
                hits[g] = F.filter(words(long), lambda t: F.contains(h, fold_squeeze(t)))
        names = F.filter(F.array(*[F.when(F.size(x) > 0, F.lit(g)) for g, x in hits.items()]), lambda g: g.isNotNull())
        return F.struct(names.alias("rubrics"), F.array_distinct(F.flatten(F.array(*hits.values()))).alias("terms"))

    return let(hay, found)


def traceability(records: DataFrame) -> DataFrame:
    """One row per record with its custody hash and where it came from."""
    return records.select(record_custody_hash().alias("record_hash"), "url", "title", "medium", "year", "status", "source_type", "fetched_at", "source_api")


def situation() -> Column:
    """``key=value`` pairs of a record's context."""
    pairs = [("year", F.col("year").cast("string")), ("source", F.col("medium")), ("type", genre()), ("flow", flow_stage(genre())), ("language", language_name(F.col("language")))]
    return F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), first_set(v, F.lit("unknown"))) for k, v in pairs])


def local_search(records: DataFrame, query: str, stopwords: Sequence[str] = (), limit: int = 30) -> DataFrame:
    """The best ``limit`` records for a query: mentions of its tokens, each as often as the query has it, and 3 for the whole phrase."""
    spark = records.sparkSession
    asked = spark.range(1).select(tokenize(F.lit(query), stopwords).alias("t")).first()["t"]
    shown = [F.col(c) for c in ("year", "medium", "title", "status", "url")]
    rows = records.select(*shown, genre().alias("source_type"), F.concat_ws(" ", "title", "medium", first_set(F.col("text_normalized"), F.col("text_clean"))).alias("x_text"))
    columns = ["score", "year", "source_type", "medium", "title", "status", "url"]
    if not asked:
        return rows.withColumn("score", F.lit(0)).select(columns).limit(0)
    rows = worked_out(rows, x_plain=fold("x_text"))
    plain, phrase = F.col("x_plain"), " ".join(_plain(query).split())
    # A token or the phrase is a piece of the folded text: what has none of them needs no tokens.
    rows = rows.filter(reduce(or_, [F.contains(plain, F.lit(t)) for t in sorted({*asked, *phrase.split()[:1]})]))
    often = Counter(asked)
    score = F.aggregate(tokenize("x_plain"), F.lit(0), lambda n, t: n + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in often.items() for x in p]), t), F.lit(0)))
    bonus = F.when(F.contains(squeeze("x_plain"), F.lit(phrase)), 3).otherwise(0)
    return worked_out(rows, score=(score + bonus).cast("int")).filter("score > 0").select(columns).orderBy(F.desc("score"), "year", "medium", "url").limit(limit)
