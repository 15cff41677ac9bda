"""Graphs, covers, fronts, statistics, streams, readers, sinks, web pages, queries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import cover, geometry, graph, planning
from skein.operators import html as pages
from skein.plans import QUERIES
from skein.plans.nucleus import nucleus
from skein.schema import RECORD
from skein.schema import records as load
from skein.sources import readers, sinks
from skein.streaming import stateful, streams
from tests.test_records import make  # noqa: F401


def points(spark, rows):
    return spark.createDataFrame(rows, "u1 double, u2 double, u3 double")


def test_hypervolume(spark):
    assert geometry.hypervolume(points(spark, [(0.8, 0.5, 0.6)])).first()[0] == 0.24
    assert geometry.hypervolume(points(spark, [(0.5, 0.5, 0.5), (0.75, 0.25, 0.5)])).first()[0] == 0.15625
    assert geometry.hypervolume(points(spark, []).limit(0)).first()[0] == 0.0


def test_skyline_equals_brute_force(spark):
    dice = random.Random(1)
    rows = [tuple(round(dice.random(), 1) for _ in range(3)) for _ in range(120)]
    want = [a for a in rows if not any(b != a and all(x >= y for x, y in zip(b, a, strict=True)) for b in rows)]
    assert sorted(map(tuple, geometry.skyline(points(spark, rows)).collect())) == sorted(want)


def test_removal_impact():
    p = cover.Problem({"a": 3.0, "b": 2.0, "c": 1.0}, [("a", "b", 0.7), ("b", "c", 0.3)])
    s = cover.evaluate(p, ["a"])
    assert s.removed_edges == 1 and s.removed_share == pytest.approx(0.7) and s.node_share == 0.5 and s.feasible
    assert cover.evaluate(p, ["a", "a", "x"]).violation == 2
    assert cover.evaluate(cover.Problem(p.scores, p.edges, mode="incident"), ["a"]).removed_share == pytest.approx(0.3)
    assert cover.evaluate(cover.Problem(p.scores, p.edges, mode="induced"), ["a", "b"]).removed_share == pytest.approx(0.3)


def test_searches_keep_to_budget_and_limits():
    dice = random.Random(2)
    ids = [f"n{i}" for i in range(15)]
    p = cover.Problem({i: dice.random() for i in ids}, [(*dice.sample(ids, 2), dice.random()) for _ in range(30)], most=4)
    for method in cover.METHODS:
        s = cover.Search(p, 150, 7)
        cover.RUNS[method](s)
        found = cover.front(s.archive)
        assert s.left >= -1 and found and all(f.feasible and 1 <= len(f.ids) <= 4 for f in found), method
        assert not any(cover.dominates(a, b) for a in found for b in found)
        assert cover.search(p, method, 150, 7) == cover.search(p, method, 150, 7)


def test_statistics():
    low, high = cover.bootstrap_mean([0.1, 0.4, 0.35, 0.8])
    assert low <= 0.4125 <= high and cover.bootstrap_mean([0.1, 0.4, 0.35, 0.8]) == (low, high)
    assert cover.bootstrap_mean([]) == (0.0, 0.0) and cover.bootstrap_mean([2.0]) == (2.0, 2.0)
    nothing = cover.bootstrap_mean([None, float("nan")])
    assert nothing == (0.0, 0.0)


def test_resamples_are_drawn_one_at_a_time():
    """The draws of CPython's generator one by one, also where n is a power of two, without a list of all of them."""
    for n in (2, 7, 64, 1000):
        dice = random.Random(5)
        drawn = cover.draws(n, 30, 5)
        assert iter(drawn) is drawn
        assert [row.tolist() for row in drawn] == [[dice.randrange(n) for _ in range(n)] for _ in range(30)]


def test_quality_of_fronts_against_all_pairs(spark, monkeypatch):
    """Clumps, an outlier, repeated places, a lone point and nulls; with a grid and without, each place compared with few others in a grid."""
    dice = random.Random(2)
    table = [(f"m{dice.randrange(2)}", *(round(c + dice.gauss(0, s), 4) for c in (0.1, 0.5, 0.7))) for s in (0.001, 0.2) for _ in range(150)]
    table += [*table[:20], ("m0", 6.0, -3.0, 0.0), ("m2", 0.3, 0.3, 0.3), ("m1", None, 0.1, 0.1)]
    away = lambda a, b: None if None in (*a[1:], *b[1:]) else sum((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True)) ** 0.5
    wanted = {}
    for m in ("m0", "m1", "m2"):
        own = [p for p in table if p[0] == m]
        near = [min((d for p in own if (d := away(r, p)) is not None), default=None) for r in table]
        near = [d for d in near if d is not None]
        gaps = [min((d for j, p in enumerate(own) if j != i and (d := away(q, p)) is not None), default=0.0) for i, q in enumerate(own)]
        mean = sum(gaps) / len(gaps)
        wanted[m] = (sum(near) / len(near), (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5)
    rows = spark.createDataFrame(table, "method string, u1 double, u2 double, u3 double")
    for direct in (geometry.DIRECT, 2000):
        monkeypatch.setattr(geometry, "DIRECT", direct)
        got = {r.method: (r.igd, r.spacing_std) for r in geometry.quality(rows, rows.drop("method")).collect()}
        assert got.keys() == wanted.keys()
        assert all(abs(x - y) < 1.1e-5 for m in got for x, y in zip(got[m], wanted[m], strict=True)), (got, wanted)


def test_signed_ranks(spark):
    """Exact p-values against all signs of the ranks; shared ranks and zeros by the normal approximation."""
    dice = random.Random(3)
    groups = {f"g{k}": [(dice.random(), dice.random()) for _ in range(k)] for k in (1, 2, 5, 9)}
    groups |= {"same": [(1.0, 1.0), (2.0, 2.0)], "ties": [(2.0, 1.0), (4.0, 3.0), (1.0, 3.0), (7.0, 7.0)], "none": [(None, 1.0), (float("nan"), 2.0)]}
    rows = spark.createDataFrame([(g, a, b) for g, pairs in groups.items() for a, b in pairs], "g string, a double, b double")
    got = {r.g: r for r in cover.wilcoxon(rows, "a", "b", "g").collect()}
    assert set(got) == set(groups) - {"none"}
    for g, pairs in groups.items():
        if not g.startswith("g"):
            continue
        order = sorted((a - b for a, b in pairs), key=abs)
        n, plus = len(order), sum(i + 1 for i, d in enumerate(order) if d > 0)
        least = min(plus, n * (n + 1) / 2 - plus)
        sums = [sum(i + 1 for i in range(n) if mask >> i & 1) for mask in range(1 << n)]
        assert got[g].status == "exact" and got[g].wilcoxon_statistic == least
        assert got[g].p_value == pytest.approx(min(1.0, 2 * sum(s <= least for s in sums) / len(sums)), abs=1e-6)
    assert (got["same"].p_value, got["same"].status, got["same"].wilcoxon_statistic) == (1.0, "no differences", 0.0)
    ties = got["ties"]  # sizes 1, 1, 2: ranks 1.5, 1.5, 3, of which the last is negative
    assert ties.status == "normal approximation" and ties.wilcoxon_statistic == 3.0 and ties.n_pairs == 4 and ties.p_value == 1.0


def test_fronts_by_partition(spark):
    dice = random.Random(2)
    rows = [(f"m{dice.randrange(3)}", *(dice.randrange(12) / 12 for _ in range(3))) for _ in range(600)]
    table = spark.createDataFrame(rows, "method string, u1 double, u2 double, u3 double").repartition(7)

    def front(points):
        return {p for p in points if not any(q != p and all(x >= y for x, y in zip(q, p, strict=True)) for q in points)}

    whole = front({r[1:] for r in rows})
    assert sorted(map(tuple, geometry.skyline(table).collect())) == sorted(r for r in rows if r[1:] in whole)
    for r in geometry.front_summary(table).collect():
        own = front({x[1:] for x in rows if x[0] == r.method})
        assert (r.front_points, r.global_nondominated_points) == (len(own), len(own & whole))
    assert geometry.skyline(table.limit(0)).count() == 0


def test_graph_measures(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("x", "y", 4)], "source string, target string, weight long")
    nodes = spark.createDataFrame([(n, n, "t", 1) for n in "abcxyz"], "id string, label string, node_type string, count long")
    assert {(r.id, r.component) for r in graph.connected_components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    g = graph.normalize(graph.Graph(nodes, edges.withColumn("edge_type", F.lit("e"))))
    assert {r.id for r in g.nodes.collect()} == set("abcxy") and max(r.weight for r in g.edges.collect()) == 1.0
    assert graph.density(nodes, edges).first().density == 0.2


def test_window_pairs(spark):
    got = spark.createDataFrame([(list("abac"),)], "t array<string>").select(graph.window_pairs(F.col("t"), 2).alias("p")).first().p
    assert sorted((p.source, p.target) for p in got) == [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c")]


def test_streams_equal_batches(spark, sf, tmp_path):
    rows = spark.createDataFrame([(i, 2020, "news", int(i % 3 > 0)) for i in range(40)], "ord long, year int, source_type string, usable int")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    got = streams.run(stateful.quota(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 5))
    assert sorted(r.ord for r in got.collect()) == list(range(8))
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert streams.run(streams.month_counts(streams.events(spark, sf)), "complete").agg(F.sum("n")).first()[0] == n


def test_readers(spark, tmp_path):
    path = tmp_path / "c"
    path.mkdir()
    (path / "news_records.jsonl").write_text('{"url": "b", "year": 2021}\nbroken\n{"url": "a", "year": 2020, "other": 1}\n')
    assert [r.url for r in readers.read_corpus(spark, str(path), in_order=True).collect()] == ["a", "b"]
    assert [r.value for r in readers.broken_lines(spark, str(path / "news_records.jsonl")).collect()] == ["broken"]
    seeds = tmp_path / "s.json"
    seeds.write_text(json.dumps([{"url": "u1", "fecha": "02/03/2020", "titulo": "T", "medio": "m"}, {"url": "u2", "year": "2019"}, {"url": "u3"}, {"date": "2020-01-01"}]))
    got = readers.read_seeds(spark, str(seeds)).orderBy("url").collect()
    assert [(r.url, r.title, str(r.published)) for r in got] == [("u1", "T", "2020-03-02"), ("u2", "", "2019-01-01")]
    works = spark.createDataFrame([("w", "t", 2020, "https://doi.org/10.1234/X", {"b": [1], "a": [0, 2]})], "id string, title string, publication_year int, doi string, abstract_inverted_index map<string,array<int>>")
    assert readers.openalex_records(works).first().text_clean == "a b a"
    months = readers.month_periods(spark, "2021-02-10", "2021-04-05").orderBy("start").collect()
    assert [r.start.month for r in months] == [2, 3, 4] and months[0].start.day == 10 and months[2].end.day == 5
    feed = tmp_path / "f.xml"
    feed.write_text("<rss><channel><item><title>in</title><pubDate>Tue, 02 Feb 2021 10:00:00 GMT</pubDate></item><item><title>out</title><pubDate>Tue, 02 Mar 2021 10:00:00 GMT</pubDate></item><item><title>none</title></item></channel></rss>")
    names = lambda undated: sorted(r.title for r in readers.read_feed(spark, str(feed), "2021-02-01", "2021-02-28", undated).collect())
    assert names(False) == ["in"] and names(True) == ["in", "none"]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "2021-02.jsonl").write_text('{"url": "u", "title": "t"}\n')
    spark.dataSource.register(readers.IndexSource)
    got = spark.read.format("article_index").options(queries="q", months="2021-01,2021-02", folder=str(tmp_path)).load().collect()
    assert [(r.query, r.month, r.url) for r in got] == [("q", "2021-02", "u")]


def test_works_of_other_indexes(spark):
    cross = spark.createDataFrame(
        [("10.1/AB", "t", "<p>An <i>abstract</i>\n here</p>", [("u.html", "text/html"), ("u.pdf", "application/PDF")], 2020), ("10.2/c", "t", None, None, 2021)],
        "DOI string, title string, abstract string, link array<struct<URL: string, `content-type`: string>>, year int",
    )
    assert sorted(map(tuple, readers.crossref_records(cross).collect())) == [("10.1/ab", "t", 2020, "An abstract here", "u.pdf"), ("10.2/c", "t", 2021, "", "")]
    works = spark.createDataFrame([("12", "t", " a  b ", 2020), ("", "u", None, 2021), ("13", "v", "x", 2019)], "cveArticulo string, titulo string, resumen string, anio int")
    assert sorted(map(tuple, readers.redalyc_records(works, [2020, 2021]).collect())) == [("t", 2020, "a b", "https://www.redalyc.org/pdf/12.pdf"), ("u", 2021, "", "")]
    lines = spark.createDataFrame([("see https://a.b/c. and (http://d.e/f), https://a.b/c",), ("none",), (None,)], "value string")
    assert sorted(r.url for r in readers.seeds_from_text(lines).collect()) == ["http://d.e/f", "https://a.b/c"]


def test_export_and_nucleus(spark, tmp_path):
    rows = load(spark, "/root/testdata/sf0.001")
    layers = nucleus(rows, ["und"], {"problem": ("the",), "solution": ("und",)})
    core = {r.source for r in layers["sources"].collect() if r.pareto_core}
    frames = layers["frames"].collect()
    assert core and {r.medium for r in frames} == core and len(frames) == rows.filter(F.col("medium").isin(*core)).count()
    assert layers["deltas"].count() == len(frames) and layers["silences"].first().expected_topic == "und"
    sinks.write_export(str(tmp_path / "e"), {"sources": layers["sources"], "deltas": layers["deltas"]}, {"made": "now"})
    assert json.loads(spark.read.text(str(tmp_path / "e/manifest")).first().value) == {"made": "now", "tables": ["deltas", "sources"]}
    assert spark.read.json(str(tmp_path / "e/deltas")).count() == len(frames)


def test_sinks(spark, make, tmp_path):  # noqa: F811
    rows = make({"url": "a", "year": 2020, "title": "t", "medium": "m", "status": "ok", "text_clean": "x", "source_type": "news"})
    m = sinks.manifest(rows, {"b": 1, "a": 2})
    assert (m["records_total"], m["records_usable"], m["records_by_source_type"]) == (1, 1, {"news": 1}) and m["config_sha256"] == sinks.stable_hash({"a": 2, "b": 1})
    sinks.write_records(rows, str(tmp_path / "r"))
    assert spark.read.schema(RECORD).json(str(tmp_path / "r")).first().url == "a"
    with pytest.raises(sinks.EmptyMerge):
        sinks.write_checked(rows.limit(0), str(tmp_path / "r"))
    a, b = spark.createDataFrame([("x", 1)], "frame_id string, current int"), spark.createDataFrame([("y", 2, "x")], "frame_id string, current int, previous_frame_id string")
    sinks.write_csv(str(tmp_path / "csv"), a, b)
    got = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert got.columns == ["frame_id", "current", "previous_frame_id"] and sorted(map(tuple, got.collect()))[1] == ("y", "2", "x")


def test_pages(spark):
    page = "<html><head><title>Title here</title><script>x()</script></head><body><nav>menu<nav>deep</nav>still</nav><p>One &amp; two</p><p>One &amp; two</p><div>Publicidad</div><p>Related articles</p><p>gone</p></body></html>"
    assert pages.visible_text(page) == "Title here\n\nOne & two\n\nOne & two\n\nPublicidad\n\nRelated articles\n\ngone"
    assert pages.visible_text(None) == "" and pages.visible_text("<header>a<nav>b</header>c</nav>d") == "cd"
    table = spark.createDataFrame([(1, "u", page), (2, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.clean_pages(table).collect()}
    # The last block is cut to nothing before boilerplate is counted: "Related articles" is a mark inside a block, too.
    assert got[1].text_clean == "One & two\n\ngone" and sorted(got[1].cleaning_notes) == ["removed_boilerplate_blocks:1", "removed_duplicate_blocks:1", "removed_repeated_title_blocks:1"]
    assert got[2].text_clean == "" and got[2].cleaning_notes == [] and got[2].word_count == 0


def test_plans(spark, tmp_path):
    plan = planning.search_plan(spark, [2020], {"news": [1, 2], "academic": planning.YEARLY}, ["a b", "c", "d"], 2)
    got = plan.collect()
    assert len(got) == 6 and {r.place for r in got} == {1, 2} and all(r.query == ('"a b"' if r.term == "a b" else r.term) for r in got)
    planning.write_plan(plan, str(tmp_path / "plan"))
    assert sorted(map(tuple, planning.read_plan(spark, str(tmp_path / "plan")).select(plan.columns).collect())) == sorted(map(tuple, got))
    assert planning.search_plan(spark, [2020], {"news": [1]}, []).count() == 0
    groups = planning.groups_of_lines("my group!: a, b,,c\nno line\n: x\nempty:\nbase: z", {"base": ["y"], "kept": ["k"]})
    assert groups == {"base": ["z"], "kept": ["k"], "my_group": ["a", "b", "c"]} and planning.groups_of_lines(planning.lines_of_groups(groups)) == groups
    rows = spark.createDataFrame([(1, "About Códing"), (2, None), (3, "body art")], "ord long, title string")
    marks = {"art": ("body art",), "code": ("coding",)}
    assert [planning.domain_profile(rows, marks), planning.domain_profile(rows, marks, 1), planning.domain_profile(rows.limit(0), marks)] == ["art", "code", "generic"]
    one = spark.range(1).select(planning.ordered_distinct(F.array(*map(F.lit, ["Ár", "", "ar", " b ", "B"]))).alias("x")).first().x
    assert one == ["Ár", "b"]


def test_stream_ends_early_and_counts_late_rows(spark, tmp_path):
    for k, days in enumerate(([1, 2], [20], [21], [3, 22])):
        spark.createDataFrame([(d, f"2024-01-{d:02d} 00:00:00") for d in days], "n long, at string").selectExpr("n", "timestamp(at) AS ts", "'e' AS event_type", "1.0D AS value").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    schema = spark.read.parquet(str(tmp_path / "in0")).schema

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in*"))

    import os

    for k in range(4):
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k * 100,) * 2)
    assert sorted(r.n for r in streams.run_until(stream(), lambda df: df.count() >= 3).collect()) == [1, 2, 20]
    assert streams.run_until(stream(), lambda df: False, lambda: True).count() == 0
    counted = streams.period_counts(stream(), "1 day", "5 days").writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    counted.awaitTermination()
    assert streams.late_rows(counted) == 1  # the third day, after the twentieth; a batch takes the watermark of the one before
    breaker = streams.Breaker(2)
    assert not breaker.open()
    breaker.refused()
    assert [breaker.open() for _ in range(3)] == [True, True, False]


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())
