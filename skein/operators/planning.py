"""Plans of searches: what is asked of an index, in which order, and how a run's choices are read from text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import domain
from ..functions.text import fold_squeeze

PLAN = "year int, month int, layer string, term string, place int, query string"
#: Months of a layer that is searched once a year.
YEARLY = (0,)
SEED, BUDGET = 2026, 8


def ordered_distinct(values: Column, key=fold_squeeze) -> Column:
    """An array's values without empty ones, each folded form once, where it is first met."""
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    return F.get(F.transform(F.array(F.struct(kept.alias("v"), F.transform(kept, key).alias("k"))), lambda x: F.filter(x["v"], lambda v, i: F.array_position(x["k"], F.get(x["k"], i)) == i + 1)), F.lit(0))


def quoted(term: Column) -> Column:
    """A term of several words in quotes, unless it is a query itself."""
    is_query = term.rlike(r"(?i)\bOR\b|[()]|domain:")
    return F.when(term.rlike(r"\s") & ~is_query & ~term.rlike('^".*"$'), F.concat(F.lit('"'), F.replace(term, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(term)


def either(terms: Column, before: str = "") -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit(before), quoted(t))), " OR ")


def index_query(terms: Column, places: Column, domains: Column, without: Column, without_domains: Column, site: str = "domain") -> Column:
    """A query for any of the terms, places and domains, without the others; all are arrays. ``site``: how the index names a domain."""

    def hosts(c: Column) -> Column:
        return F.filter(F.transform(c, lambda d: domain(F.trim(d), anywhere=True)), lambda d: d != "")

    terms, places, without = (ordered_distinct(c) for c in (terms, places, without))
    out = F.when(F.size(terms) > 1, F.concat(F.lit("("), either(terms), F.lit(")"))).otherwise(either(terms))
    for more in (either(places), F.array_join(F.transform(hosts(domains), lambda d: F.concat(F.lit(f"{site}:"), d)), " OR ")):
        out = F.when(more != "", F.concat(F.lit("("), out, F.lit(") ("), more, F.lit(")"))).otherwise(out)
    less = F.concat(F.transform(without, lambda t: F.concat(F.lit("-"), quoted(t))), F.transform(hosts(without_domains), lambda d: F.concat(F.lit(f"-{site}:"), d)))
    return F.when(F.size(less) > 0, F.concat_ws(" ", out, F.array_join(less, " "))).otherwise(out)


def search_plan(spark: SparkSession, years: Sequence[int], layers: Mapping[str, Sequence[int]], terms: Sequence[str], budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """``PLAN``: for each year, layer and month of the layer ``budget`` of the terms, drawn and ordered by a hash with the seed.

    The grid is as small as the plan; drawing is a window within one step.
    """
    steps = spark.createDataFrame([(y, m, k) for y in years for k, months in layers.items() for m in months], "year int, month int, layer string")
    rows = steps.withColumn("term", F.explode(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), "year", "month", "layer", "term"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("year", "month", "layer").orderBy(drawn, "term"))).filter(F.col("place") <= budget)
    return placed.withColumn("query", quoted(F.col("term")))


def write_plan(plan: DataFrame, path: str) -> None:
    """A plan as lines of JSON, in its order."""
    plan.orderBy("year", "layer", "month", "place").coalesce(1).write.mode("overwrite").json(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan from lines of JSON; lines that are none are left out."""
    return spark.read.schema(PLAN).option("mode", "DROPMALFORMED").json(path)


def domain_profile(records: DataFrame, profiles: Mapping[str, Sequence[str]], first: int = 200, otherwise: str = "generic") -> str:
    """The first profile that one of the first records, by ``ord``, has a mark of in its title or query. One small job: the choice is made before the plan."""
    names = [c for c in ("query", "title") if c in records.columns]
    hay = fold_squeeze(F.concat_ws(" ", *names))
    few = records.orderBy("ord").limit(first).select(hay.alias("h"))
    found = few.agg(*[F.coalesce(F.bool_or(F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(F.col("h"), m))), F.lit(False)).alias(name) for name, marks in profiles.items()]).first()
    return next((name for name in profiles if found and found[name]), otherwise)


def groups_of_lines(text: str | None, base: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """Named groups from lines ``name: a, b``, over those of ``base``. Names keep letters, digits, hyphens and underscores; lines without a name or terms say nothing."""
    out = {k: list(v) for k, v in (base or {}).items()}
    for name, colon, terms in (line.partition(":") for line in (text or "").splitlines()):
        name = "_".join(filter(None, re.findall(r"[A-Za-z0-9_-]+", name))).strip("_")
        own = [t.strip() for t in terms.split(",") if t.strip()]
        if colon and name and own:
            out[name] = own
    return out


def lines_of_groups(groups: Mapping[str, Sequence[str]]) -> str:
    return "\n".join(f"{name}: {', '.join(terms)}" for name, terms in groups.items())


def by_priority(domains: DataFrame, classes: Sequence[Sequence[str]], last: Sequence[str] = (), most: int = 6) -> DataFrame:
    """The first ``most`` distinct domains: by the first class that names one of its marks, others, then ``last``; by name within."""
    name = F.col("domain")
    rank = F.lit(len(classes))
    for k, marks in reversed(list(enumerate(classes))):
        rank = F.when(F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(name, m)), F.lit(k)).otherwise(rank)
    if last:
        rank = F.when(F.exists(F.array(*map(F.lit, last)), lambda m: F.contains(name, m)), F.lit(len(classes) + 1)).otherwise(rank)
    own = domains.select(domain(name, anywhere=True).alias("domain")).filter("domain <> ''").distinct()
    return own.withColumn("priority", rank).orderBy("priority", "domain").limit(most)
