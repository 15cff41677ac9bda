"""Records: classification, filters, keys, deduplication, quotas, aggregates."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import keys, text
from skein.operators import aggregate, dedup, records

SCHEMA = """ord long, url string, title string, medium string, year int, status string, source_type string, text_clean string, text_normalized string, text_length int,
language string, country string, geographic_scope string, source_api string, error string, published_date string, fetched_at string"""


@pytest.fixture(scope="session")
def make(spark):
    def f(*rows):
        names = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
        return spark.createDataFrame([tuple(({"ord": i} | r).get(n) for n in names) for i, r in enumerate(rows)], SCHEMA)

    return f


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_source_classification(spark):
    for url, medium, want in (
        ("https://www.lanacion.example/noticias/a", "lanacion.example", "news"),
        ("https://www.gob.mx/salud/a", "gob.mx", "institutional_report"),
        ("https://www.reddit.com/r/x/comments/1", "reddit.com", "forum"),
        ("https://doi.org/10.1000/xyz", "doi.org", "scientific_article"),
        ("https://example.org/journal/12", "example.org", "scientific_article"),
        ("https://plain.example/x", "", "other"),
    ):
        assert one(spark, records.classify_source(F.lit(url), F.lit(medium), F.lit("")))["source_type"] == want


def test_region_filter(make):
    rows = make({"url": "https://a.es/x", "title": "algo"}, {"url": "https://a.com.mx/x", "title": "algo"}, {"url": "https://b.org/x", "title": "en México hoy"})
    fits = records.in_region("Mexico", ["mexico"], ["mx"], [".mx"])
    assert [r.f for r in rows.select("ord", fits.alias("f")).orderBy("ord").collect()] == [False, True, True]
    assert rows.filter(records.in_region("global", [], [], [])).count() == 3


def test_access_policy(spark, make):
    profiles = spark.createDataFrame([(1, "paper.example", "partial"), (2, "wall.example", "paywall"), (3, "example", "open")], "ord int, domain string, access string")
    got = records.access_policy(make({"url": "https://www.paper.example/a"}, {"url": "https://x.wall.example/"}, {"url": "https://other.example"}, {"url": None}), profiles)
    assert [r.access for r in got.orderBy("ord").collect()] == ["partial", "paywall", "open", "unknown"]


def test_traceability(make):
    row = records.traceability(make({"url": "u", "title": "t", "year": 2020, "status": "ok", "source_type": "news"})).first()
    assert len(row.record_hash) == 64 and row.status == "ok"


def test_usable(make):
    rows = make({"status": "ok", "text_clean": "x"}, {"status": "ok", "text_clean": ""}, {"status": "ok_partial", "text_clean": "x" * 100}, {"status": "ok_partial", "text_clean": "x", "text_length": 100}, {"status": "ok_partial", "text_clean": "x"}, {"status": "error", "text_clean": "x"}, {})
    assert [r.u for r in rows.select("ord", records.usable().alias("u")).orderBy("ord").collect()] == [True, False, True, True, False, False, False]


def test_localization(make):
    rows = make({"country": "mx", "medium": "a.com.mx", "title": "", "text_clean": ""}, {"title": "", "text_clean": "", "geographic_scope": "México"}, {"title": "", "text_clean": "x"})
    got = [r.w for r in rows.select("ord", records.localization().alias("w")).orderBy("ord").collect()]
    assert [g.localization for g in got] == ["Mexico-focused", "Mexico-mentioned", "Global/unclear"] and got[0].mexico_score == 8


def test_exclusion_and_topic(make):
    rows = make({"medium": "Bad Press", "title": "x"}, {"medium": "m", "title": "Un Día", "text_clean": "tattoo tattoo"}, {"medium": "m", "title": "tattoo"})
    got = [r.exclusion_reason for r in records.exclude(rows, ["un dia"], ["bad press"]).orderBy("ord").collect()]
    assert got == ["excluded_medium:Bad Press", "excluded_term:un dia", ""]
    got = [(r.topical_relevance_score, r.exclusion_reason) for r in records.by_topic(rows, ["tattoo"], 3).orderBy("ord").collect()]
    assert got == [(0, "low_topical_relevance:0"), (2, "low_topical_relevance:2"), (3, "")]


def test_keys(spark):
    assert one(spark, keys.doi_key(F.lit("see https://doi.org/10.1234/AB.c);"))) == "10.1234/ab.c"
    assert one(spark, keys.url_key(F.lit(" HTTPS://www.A.org/x/?q=1#z "))) == "a.org/x"
    assert one(spark, keys.url_path_key(F.lit("https://www.A.org/X//?q"))) == "url:a.org/X"
    key = lambda **k: one(spark, keys.document_key(*[F.lit(k.get(n)) for n in ("url", "title", "year", "medium")]))
    assert key(url="https://doi.org/10.1234/x", title="T", year=2020, medium="m") == "doi:10.1234/x"
    assert key(url="https://a.org/1", title="Él Título", year=2020, medium="m") == "title_year_medium:2020:m:el titulo"
    assert key(url="https://a.org/1") == "url:a.org/1" and key(title="T", year=2020) == "title_year:2020:t" and key() == ""


def test_dedup_policies(make):
    rows = make({"url": "https://x.org/10.1234/abc", "title": "A"}, {"url": "https://y.org/10.1234/abc.", "title": "B"}, {"url": "http://z.org/a", "title": "C"}, {"url": "https://www.z.org/a/", "title": "C2"})
    assert sorted(r.ord for r in dedup.dedup(rows).collect()) == [0, 2]
    assert sorted(r.ord for r in dedup.dedup(rows, "url_last").collect()) == [0, 1, 3]
    assert sorted(r.ord for r in dedup.dedup(rows, "url_or_title").collect()) == [0, 1, 2, 3]
    assert dedup.dedup(dedup.dedup(rows)).count() == 2
    with pytest.raises(ValueError, match="policy"):
        dedup.dedup_key("none")


def test_quota_equals_the_sequential_rule(make):
    dice = random.Random(4)
    rows = [{"ord": i * 5000 // 7, "year": dice.choice([2020, 2021]), "source_type": dice.choice(["news", "forum"]), "status": dice.choice(["ok", "error"]), "text_clean": "x"} for i in range(200)]
    taken, want = {}, []
    for r in rows:
        k = r["year"], r["source_type"]
        if taken.get(k, 0) < 15:
            want.append(r["ord"])
            taken[k] = taken.get(k, 0) + (r["status"] == "ok")
    assert sorted(r.ord for r in dedup.quota(make(*rows), 15).collect()) == sorted(want)


def test_aggregates(make):
    rows = make(*[{"year": 2020 + i % 2, "source_type": ["news", "forum", "news"][i % 3], "medium": f"m{i % 4}", "status": "ok", "text_clean": "x" * (i * 100), "url": str(i), "title": "t"} for i in range(1, 25)])
    got = aggregate.cartography(rows).collect()
    assert sum(r.weight_share for r in got) == pytest.approx(1, abs=1e-4) and got and sum(r.records for r in got) == 24
    assert sorted(r.rank for r in got) == [1, 2, 3, 4] and next(r for r in got if r["rank"] == 1).pareto_core
    assert sum(r.records for r in aggregate.distribution(rows).filter("level = 1").collect()) == 24
    assert aggregate.social_balance(rows).first().status == "social_layers_present"
    assert aggregate.annual_coverage(rows, 5).filter("status = 'ok'").count() == 2
    assert aggregate.genre_coverage(rows).first().source_balance_status.startswith("missing_or_under_target:institutional_report")


def test_text_functions(spark):
    assert one(spark, text.tokenize(F.lit("Él niño come 3 pan-es, y come"), ["come"])) == ["nino", "pan-es"]
    assert one(spark, text.ngrams(F.array(*map(F.lit, "abcd")), 3)) == ["a b c", "b c d"] and one(spark, text.ngrams(F.array(F.lit("a")), 2)) == []
    j = lambda a, b: one(spark, text.jaccard(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert (j("ab", "bc"), j("ab", "ab")) == (1 / 3, 1.0)
    assert one(spark, text.count_word(F.lit("criticó critic critics"), "critic")) == 1
    assert one(spark, text.canon(F.lit("Ñandú – ängel"))) == "nandu   Zngel"
    assert one(spark, text.first_set(F.lit(""), F.lit(None).cast("string"), F.lit("b"))) == "b"
