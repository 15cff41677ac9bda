"""Queries on frames in time, graphs, fronts, covers and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import actors as actor_names
from ..operators import communities as community
from ..operators import cover, extract, folds, geometry, graph, terms
from ..operators.records import flow_stage, usable
from ..schema import read, records as load
from ..storage import cut, shared_folder
from ..streaming import stateful, streams
from . import text_queries as tq
from .catalog import TOKENS, query

#: The commonest terms of the corpus that a network is made of.
NETWORK_TERMS = 50
PAIRS = f""", u AS (SELECT ord, unnest({TOKENS}) AS t, generate_subscripts({TOKENS}, 1) AS p FROM r),
vocabulary AS (SELECT t FROM u WHERE {tq.NOT_STOP} GROUP BY t ORDER BY count(*) DESC, min(ord * 1000000000 + p) LIMIT {NETWORK_TERMS}),
k AS (SELECT ord, list(t ORDER BY p) AS t FROM u WHERE t IN (SELECT t FROM vocabulary) GROUP BY ord),
i AS (SELECT t, unnest(range(1, len(t))) AS p FROM k WHERE len(t) > 1), o AS (SELECT t[p] AS a, unnest(t[p + 1:p + 4]) AS b FROM i),
e AS (SELECT least(a, b) AS source, greatest(a, b) AS target, count(*) AS weight FROM o WHERE a <> b GROUP BY ALL HAVING count(*) >= 2),
n AS (SELECT id, count(*) AS count FROM (SELECT unnest(t) AS id FROM k) GROUP BY id)"""
BOTH = "(SELECT source AS id, weight FROM e UNION ALL SELECT target, weight FROM e)"


def _words(spark, sf_dir):
    """The network of the commonest terms; as many as a display holds come to the driver."""
    rows = load(spark, sf_dir)
    chosen = [r["term"] for r in terms.top_terms(rows, 1, NETWORK_TERMS, 1, tq.STOPS).collect()]
    return graph.cooccurrence(rows.select(text.tokenize(F.col("text_normalized")).alias("terms")), chosen)


@query(f"{PAIRS} SELECT source, target, weight FROM e")
def cooccurrence_edges(spark, sf_dir):
    return _words(spark, sf_dir).edges.select("source", "target", "weight")


@query(f"{PAIRS} SELECT id, count(*) AS degree, sum(weight)::BIGINT AS weighted_degree FROM {BOTH} GROUP BY id")
def graph_degrees(spark, sf_dir):
    return graph.degrees(_words(spark, sf_dir).edges)


NORM = f"""{PAIRS}, en AS (SELECT *, round(weight / (max(weight) OVER ())::DOUBLE, 6) AS w FROM e), d AS (SELECT id, count(*) AS degree, sum(weight) AS wd FROM {BOTH} GROUP BY id),
nn AS (SELECT n.id, degree, round(count / (max(count) OVER ())::DOUBLE, 6) AS c, round(wd / (max(wd) OVER ())::DOUBLE, 6) AS v FROM n JOIN d USING (id))"""


@query(f"{NORM} SELECT id, c AS count_norm, v AS weighted_degree_norm, round((c + v) / 2, 6) AS score FROM nn")
def graph_normalize(spark, sf_dir):
    return graph.normalize(_words(spark, sf_dir)).nodes.select("id", "count_norm", "weighted_degree_norm", "score")


@query(
    f"""{NORM}, s AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS k, count(*) OVER () AS m FROM en),
es AS (SELECT round(min(w), 6) AS edge_weight_min, round(max(w), 6) AS edge_weight_max, round(avg(w), 6) AS edge_weight_mean, round(var_pop(w), 6) AS edge_weight_variance,
  max(CASE WHEN k = round_even((m - 1) * 0.25::DOUBLE, 0)::INT THEN w END) AS edge_weight_q25, max(CASE WHEN k = round_even((m - 1) * 0.5::DOUBLE, 0)::INT THEN w END) AS edge_weight_q50,
  max(CASE WHEN k = round_even((m - 1) * 0.75::DOUBLE, 0)::INT THEN w END) AS edge_weight_q75, round(sum(CASE WHEN k >= m - greatest(1, ceil(m * 0.1::DOUBLE)) THEN w END) / sum(w), 6) AS top_10pct_edge_weight_share, count(*) AS ne FROM s),
ns AS (SELECT round(avg(round((c + v) / 2, 6)), 6) AS node_weight_mean, round(var_pop(round((c + v) / 2, 6)), 6) AS node_weight_variance, round(avg(degree), 6) AS degree_mean, round(var_pop(degree), 6) AS degree_variance, count(*) AS nv FROM nn)
SELECT es.* EXCLUDE (ne), ns.* EXCLUDE (nv), CASE WHEN nv < 3 OR ne = 0 THEN 'insufficient_data' WHEN degree_mean > 0 AND degree_variance / degree_mean > 2.5 THEN 'heterogeneous_or_hub_dominated'
  WHEN top_10pct_edge_weight_share > 0.55 THEN 'weight_concentrated' ELSE 'relatively_homogeneous' END AS network_type_diagnostic FROM es, ns"""
)
def graph_stats(spark, sf_dir):
    return graph.weight_stats(graph.normalize(_words(spark, sf_dir)))


@query(f"{PAIRS}, x AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges) SELECT *, round(2 * edges / (nodes * (nodes - 1))::DOUBLE, 5) AS density FROM x")
def graph_density(spark, sf_dir):
    g = _words(spark, sf_dir)
    return graph.density(g.nodes, g.edges)


@query(
    f"""{NORM}, t AS (SELECT id FROM nn ORDER BY round((c + v) / 2, 6) DESC, id LIMIT 5)
SELECT source, target, w AS weight FROM en WHERE source IN (SELECT id FROM t) AND target IN (SELECT id FROM t)"""
)
def visible_subgraph(spark, sf_dir):
    return graph.visible(graph.normalize(_words(spark, sf_dir)), 5).edges.select("source", "target", "weight")


@query(
    """WITH RECURSIVE l AS (SELECT 'c' || o_custkey AS a, 'k' || o_orderkey AS b FROM orders),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), w(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.id)
SELECT id, min(c) AS component FROM w GROUP BY id""",
    records=False,
)
def components(spark, sf_dir):
    edges = read(spark, sf_dir, "orders").selectExpr("'c' || o_custkey AS source", "'k' || o_orderkey AS target", "1 AS weight")
    return graph.connected_components(edges)


@query(
    f"""{NORM}, sc AS (SELECT id, round((c + v) / 2, 6) AS score FROM nn), ch AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM sc QUALIFY rank <= 10),
fe AS (SELECT least(a.rank, b.rank) AS rank, w FROM en LEFT JOIN ch a ON a.id = en.source LEFT JOIN ch b ON b.id = en.target WHERE a.rank IS NOT NULL OR b.rank IS NOT NULL), ad AS (SELECT rank, count(*) AS new_edges, sum(w) AS nw FROM fe GROUP BY rank)
SELECT rank, id, round(score, 6) AS node_weight, coalesce(new_edges, 0)::BIGINT AS new_edges, round(coalesce(nw, 0), 6) AS new_edge_weight, (sum(coalesce(new_edges, 0)) OVER o)::BIGINT AS edges_touched,
  round(sum(score) OVER o / (SELECT sum(score) FROM sc), 6) AS node_weight_share, round(sum(coalesce(nw, 0)) OVER o / (SELECT sum(w) FROM en), 6) AS edge_weight_share FROM ch LEFT JOIN ad USING (rank) WINDOW o AS (ORDER BY rank ROWS UNBOUNDED PRECEDING)"""
)
def cover_marginals(spark, sf_dir):
    g = graph.normalize(_words(spark, sf_dir))
    best = g.nodes.orderBy(F.desc("score"), "id").limit(10)
    chosen = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))
    return graph.marginals(g, chosen)


@query(
    f"""{PAIRS}, x AS (SELECT source, target FROM e WHERE weight >= 3 AND abs(ascii(source) - ascii(target)) <= 2), y AS (SELECT source AS id, target AS o FROM x UNION SELECT target, source FROM x),
w(id, c) AS (SELECT id, id FROM y UNION SELECT y.id, w.c FROM w JOIN y ON y.o = w.id), m AS (SELECT id, min(c) AS component FROM w GROUP BY id), d AS (SELECT id, sum(weight) AS wd FROM {BOTH} GROUP BY id),
z AS (SELECT component, count(*) AS size FROM m GROUP BY component), q AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS k FROM z),
t AS (SELECT component, first(id ORDER BY wd DESC, count DESC, id) AS central, array_to_string((list(id ORDER BY wd DESC, count DESC, id))[1:12], ', ') AS terms FROM m JOIN n USING (id) JOIN d USING (id) GROUP BY component)
SELECT 'topic_' || k || '_' || substring(central, 1, 40) AS topic_group, central AS central_ngram, size, terms FROM q JOIN t USING (component) WHERE k <= 12""",
    recursive=True,
)
def adaptive_topics(spark, sf_dir):
    """Groups of the network whose links are strong and whose ends begin alike, so that there are several."""
    g = _words(spark, sf_dir)
    alike = g.edges.filter((F.col("weight") >= 3) & (F.abs(F.ascii("source") - F.ascii("target")) <= 2))
    nodes = g.nodes.join(graph.degrees(g.edges).select("id", "weighted_degree"), "id").withColumn("node_type", F.lit("monogram"))
    return graph.topics(nodes, graph.connected_components(alike.select("source", "target", "weight")))


PARTITION = f"""{PAIRS}, home AS (SELECT id, ascii(id) % 5 AS c FROM n), x AS (SELECT weight, a.c AS a, b.c AS b FROM e JOIN home a ON a.id = source JOIN home b ON b.id = target),
t AS (SELECT c, sum(weight) AS t FROM (SELECT a AS c, weight FROM x UNION ALL SELECT b, weight FROM x) GROUP BY c)
SELECT round((SELECT sum(weight) FROM x WHERE a = b) / (SELECT sum(weight) FROM x)::DOUBLE - (SELECT sum(t * t) FROM t) / pow((SELECT sum(t) FROM t), 2), 5) AS modularity"""


@query(PARTITION)
def partition_modularity(spark, sf_dir):
    """How well a given partition of the network fits it."""
    g = _words(spark, sf_dir)
    return community.modularity(g.edges, g.nodes.select("id", (F.ascii("id") % 5).alias("community")))


@query()
def louvain(spark, sf_dir):
    return community.louvain(_words(spark, sf_dir).edges)


@query()
def greedy_communities(spark, sf_dir):
    return community.community_rows(community.greedy(_words(spark, sf_dir).edges))


@query(
    f"""{PAIRS}, x AS (SELECT source, target FROM e WHERE weight >= 3 AND abs(ascii(source) - ascii(target)) <= 2), y AS (SELECT source AS id, target AS o FROM x UNION SELECT target, source FROM x UNION SELECT id, id FROM n),
w(id, c) AS (SELECT id, id FROM y UNION SELECT y.id, w.c FROM w JOIN y ON y.o = w.id), m AS (SELECT id, min(c) AS component FROM w GROUP BY id)
SELECT row_number() OVER (ORDER BY count(*) DESC, component) AS community, count(*) AS size, array_to_string((list(id ORDER BY id))[1:40], ', ') AS terms FROM m GROUP BY component""",
    recursive=True,
)
def component_communities(spark, sf_dir):
    """Communities by components, as the analysis falls back to: terms without links are communities of one."""
    g = _words(spark, sf_dir)
    alike = g.edges.filter((F.col("weight") >= 3) & (F.abs(F.ascii("source") - F.ascii("target")) <= 2))
    return community.community_rows(community.communities(alike, g.nodes, "connected_components"))


@query(
    f"""{tq.FOUND}, x AS (SELECT 'source::' || medium AS source, 'speech_act::' || speech_act AS target, 'uses_speech_act' AS edge_type FROM q
UNION ALL SELECT 'source::' || medium, 'actor::' || lower(subject), 'mentions_actor' FROM q WHERE subject <> '' UNION ALL SELECT 'actor::' || lower(subject), 'speech_act::' || speech_act, 'actor_in_speech_act' FROM q WHERE subject <> ''
UNION ALL SELECT 'source::' || medium, 'logic::causal_claim', 'makes_logic_move' FROM q WHERE has_causal_relation
UNION ALL SELECT 'source::' || medium, 'fallacy::' || f, 'contains_fallacy_signal' FROM (SELECT medium, unnest(string_split(fallacies, ', ')) AS f FROM q) WHERE f <> ''
UNION ALL SELECT 'source::' || medium, 'vector::' || f, 'contains_vector_signal' FROM (SELECT medium, unnest(string_split(disinformation_vectors, ', ')) AS f FROM q) WHERE f <> '')
SELECT source, target, edge_type, count(*) AS weight FROM x GROUP BY ALL HAVING count(*) >= 2"""
)
def influence_edges(spark, sf_dir):
    return graph.influence(tq._found(spark, sf_dir)).edges


STAGE_PAIRS = "\nUNION ALL ".join(
    f"SELECT least('stage::{a}', 'stage::{b}'), greatest('stage::{a}', 'stage::{b}'), 'stage_co_document', 1.0 FROM m WHERE {a} <> '' AND {b} <> ''" for i, a in enumerate(tq.EVENTS) for b in list(tq.EVENTS)[i + 1 :]
)


@query(
    f"""{tq.EVENT_ROWS}, m AS (SELECT v.*, 'doc::' || r.ord AS doc, 'source::' || medium AS s, 'year::' || year AS y, 'type::' || source_type AS t, 'flow::' ||
  CASE source_type WHEN 'forum' THEN 'individual_dialogue' WHEN 'news' THEN 'news_media' WHEN 'institutional_report' THEN 'institutional_authority' WHEN 'industry_report' THEN 'technical_or_industry_derivation' WHEN 'scientific_article' THEN 'research' ELSE 'other_or_unclear_derivation' END AS f FROM v JOIN r USING (ord)),
x(a, b, k, w) AS (SELECT doc, s, 'document_source', 1.0 FROM m UNION ALL SELECT doc, y, 'document_year', 1.0 FROM m UNION ALL SELECT doc, t, 'document_source_type', 1.0 FROM m UNION ALL SELECT doc, f, 'document_flow', 1.0 FROM m
"""
    + "\n".join(
        f"UNION ALL SELECT {o}, 'stage::{st}', '{k}', 1.0 FROM m WHERE {st} <> ''" for st in tq.EVENTS for o, k in (("doc", "document_stage"), ("s", "source_stage"), ("y", "year_stage"), ("t", "type_stage"), ("f", "flow_stage"))
    )
    + f"\nUNION ALL {STAGE_PAIRS}) SELECT least(a, b) AS source, greatest(a, b) AS target, k AS edge_type, round(sum(w)::DOUBLE, 3) AS weight FROM x GROUP BY ALL"
)
def event_graph(spark, sf_dir):
    return graph.event_graph(extract.narrative_events(load(spark, sf_dir), tq.EVENTS), tuple(tq.EVENTS)).edges


@query()
def event_graph_actors(spark, sf_dir):
    rows = load(spark, sf_dir)
    found = extract.narrative_events(rows, tq.EVENTS).join(actor_names.actors(rows).select("ord", "actors"), "ord")
    return graph.event_graph(found, tuple(tq.EVENTS), emphasis=True).edges


@query()
def knowledge_graph(spark, sf_dir):
    rows = load(spark, sf_dir)
    chosen = [r["node"] for r in terms.repeated_phrases(rows, 15, stopwords=tq.STOPS).filter("node_type <> 'absorbed_ngram'").collect()]
    found = terms.canonical_terms(rows.select("ord", "text_clean", "text_normalized", "title", "medium", "year", "source_type"), sorted(set(chosen)), tq.STOPS)
    found = found.select(F.col("terms").alias("concepts"), "medium", "year", F.lit("Global/unclear").alias("localization"), flow_stage(F.col("source_type")).alias("narrative_flow_stage"))
    return graph.knowledge(found).edges


@query(
    f"""{tq.FRAME_ROWS}, t AS (SELECT ord, list_distinct(list_filter(string_split(frame_terms, ' '), lambda t: t <> '')) AS t FROM f WHERE frame_terms <> '')
SELECT a.ord AS i, b.ord AS j, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 5) AS similarity
FROM t a JOIN t b ON a.ord < b.ord AND len(a.t) >= len(b.t) * 0.8::DOUBLE - 1e-9 AND len(b.t) >= len(a.t) * 0.8::DOUBLE - 1e-9
WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE >= 0.8"""
)
def jaccard_pairs(spark, sf_dir):
    frames = cut(extract.argument_frames(load(spark, sf_dir), parts=tq.PARTS).select("ord", "frame_terms"))
    sets = frames.filter("frame_terms <> ''").select(F.col("ord").alias("id"), F.array_distinct(F.filter(F.split("frame_terms", " "), lambda t: t != "")).alias("tokens"))
    return folds.similar_sets(sets, 0.8).select("i", "j", F.round("similarity", 5).alias("similarity"))


def tok(p):
    return rf"list_distinct(list_filter(list_transform(regexp_extract_all({p}, '[\p{{L}}\p{{N}}\p{{M}}_-]+'), lambda t: lower(t)), lambda t: length(t) > 2))"


def share(a, b):
    return f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END)"


@query(
    f"""{tq.FRAME_ROWS}, h AS (SELECT ord, {tq.HASH} AS record_hash FROM r),
s AS MATERIALIZED (SELECT ord, substring(sha1(record_hash || ':frame'), 1, 16) AS frame_id, {tok("frame_terms")} AS x, row_number() OVER (ORDER BY ord) AS k FROM f JOIN h USING (ord)),
u AS (SELECT k, unnest(x) AS t FROM s), c AS (SELECT b.k AS j, a.k AS i, count(*) AS common FROM u a JOIN u b ON a.t = b.t AND a.k < b.k GROUP BY ALL),
p AS (SELECT j, i, common / (len(a.x) + len(b.x) - common)::DOUBLE AS sim FROM c JOIN s a ON a.k = i JOIN s b ON b.k = j
  UNION ALL SELECT b.k, a.k, 1.0::DOUBLE FROM s a JOIN s b ON len(a.x) = 0 AND len(b.x) = 0 AND a.k < b.k),
l AS MATERIALIZED (SELECT j AS k, list({{'i': i, 's': sim}}) AS near FROM p GROUP BY j),
w(k, kept, best, origin) AS (
  SELECT k, [TRUE], 0.0::DOUBLE, NULL::BIGINT FROM s WHERE k = 1
  UNION ALL SELECT k, list_append(kept, best < 0.9), best, CASE WHEN best >= 0.9 THEN list_min(list_transform(list_filter(near, lambda e: kept[e.i] AND e.s = best), lambda e: e.i)) END
  FROM (SELECT s.k, w.kept, near, coalesce(list_max(list_transform(list_filter(near, lambda e: w.kept[e.i]), lambda e: e.s)), 0)::DOUBLE AS best FROM w JOIN s ON s.k = w.k + 1 LEFT JOIN l ON l.k = s.k))
SELECT s.ord, s.frame_id, CASE WHEN origin IS NULL THEN 'original_or_variant' ELSE 'echo' END AS echo_status, coalesce(o.frame_id, '') AS echo_of_frame_id, round(best, 5) AS echo_similarity,
  CASE WHEN origin IS NOT NULL THEN 'ECO_DE' WHEN s.k = 1 THEN 'ORIGEN_DE_MARCO' ELSE 'NARRATIVA_ALTERNATIVA_DE' END AS relation_type,
  CASE WHEN origin IS NULL THEN 'store_structural_frame' ELSE 'store_hash_relation_only' END AS storage_decision FROM w JOIN s USING (k) LEFT JOIN s o ON o.k = origin""",
    recursive=True,
)
def echo_frames(spark, sf_dir):
    found = folds.echo_frames(extract.argument_frames(load(spark, sf_dir), parts=tq.PARTS))
    return found.select("ord", "frame_id", "echo_status", "echo_of_frame_id", "echo_similarity", "relation_type", "storage_decision")


CHANGED = "concat_ws(', ', " + ", ".join(f"CASE WHEN {share(f'n.x_{p}', f'l.x_{p}')} < 0.82 THEN '{p}' END" for p in tq.PARTS) + ")"


@query(
    f"""{tq.FRAME_ROWS}, h AS (SELECT ord, {tq.HASH} AS record_hash FROM r),
s AS (SELECT medium, year, substring(sha1(record_hash || ':frame'), 1, 16) AS frame_id, {", ".join(f"{tok(p)} AS x_{p}" for p in (*tq.PARTS, "frame_terms"))} FROM f JOIN h USING (ord)),
n AS (SELECT *, row_number() OVER (PARTITION BY medium ORDER BY year, frame_id) AS k FROM s),
d(medium, k, last, year, frame_id, previous_frame_id, delta_type, similarity_to_previous, changed_fields, storage_decision) AS (
  SELECT medium, k, k, year, frame_id, NULL::VARCHAR, 'baseline', NULL::DOUBLE, '{", ".join(tq.PARTS)}', 'store_structural_frame' FROM n WHERE k = 1
  UNION ALL SELECT medium, k, CASE WHEN c <> '' THEN k ELSE last END, year, frame_id, previous, CASE WHEN c <> '' THEN 'change' ELSE 'stable_repetition' END, sim, c, CASE WHEN c <> '' THEN 'store_delta' ELSE 'timestamp_counter_only' END
  FROM (SELECT n.medium, n.k, d.last, n.year, n.frame_id, l.frame_id AS previous, round({share("n.x_frame_terms", "l.x_frame_terms")}, 5) AS sim, {CHANGED} AS c FROM d JOIN n ON n.medium = d.medium AND n.k = d.k + 1 JOIN n l ON l.medium = d.medium AND l.k = d.last))
SELECT medium, year, frame_id, previous_frame_id, delta_type, similarity_to_previous, changed_fields, storage_decision FROM d""",
    recursive=True,
)
def frame_deltas(spark, sf_dir):
    return folds.frame_deltas(extract.argument_frames(load(spark, sf_dir), parts=tq.PARTS), parts=tuple(tq.PARTS))


POINTS = """WITH p AS (SELECT l_suppkey AS id, round(count(*) / (max(count(*)) OVER ())::DOUBLE, 4) AS u1, round(avg(l_discount) * 10, 4) AS u2, round(avg(l_tax) * 10, 4) AS u3 FROM lineitem GROUP BY l_suppkey)"""


def _points(spark, sf_dir):
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"))
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount") * 10, 4).alias("u2"), F.round(F.avg("l_tax") * 10, 4).alias("u3"))
    return rows.select("id", F.round(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))), 4).alias("u1"), "u2", "u3")


@query(f"{POINTS} SELECT id, u1, u2, u3 FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.u1 >= a.u1 AND b.u2 >= a.u2 AND b.u3 >= a.u3 AND (b.u1 > a.u1 OR b.u2 > a.u2 OR b.u3 > a.u3))", records=False)
def skyline(spark, sf_dir):
    return geometry.skyline(_points(spark, sf_dir))


@query(
    f"""{POINTS}, q AS (SELECT * FROM p),
x AS (SELECT v AS a, lead(v) OVER (ORDER BY v) AS b FROM (SELECT DISTINCT least(1, u1) AS v FROM q UNION SELECT 0)), y AS (SELECT v AS a, lead(v) OVER (ORDER BY v) AS b FROM (SELECT DISTINCT least(1, u2) AS v FROM q UNION SELECT 0)),
z AS (SELECT v AS a, lead(v) OVER (ORDER BY v) AS b FROM (SELECT DISTINCT least(1, u3) AS v FROM q UNION SELECT 0))
SELECT round(sum((x.b - x.a) * (y.b - y.a) * (z.b - z.a))::DOUBLE, 6) AS hypervolume FROM x, y, z WHERE x.b IS NOT NULL AND y.b IS NOT NULL AND z.b IS NOT NULL AND EXISTS (SELECT 1 FROM q WHERE q.u1 >= x.b AND q.u2 >= y.b AND q.u3 >= z.b)""",
    records=False,
)
def hypervolume_3d(spark, sf_dir):
    return geometry.hypervolume(geometry.skyline(_points(spark, sf_dir)))


D = "sqrt((a.u1 - b.u1) ** 2 + (a.u2 - b.u2) ** 2 + (a.u3 - b.u3) ** 2)"


@query(
    f"""{POINTS}, m AS (SELECT *, 'm' || (id % 3) AS method FROM p),
i AS (SELECT method, round(avg(d), 5) AS igd FROM (SELECT b.method, a.id, min({D}) AS d FROM p a, m b GROUP BY ALL) GROUP BY method),
s AS (SELECT method, round(stddev_pop(d), 5) AS spacing_std FROM (SELECT a.method, a.id, coalesce(min({D}), 0) AS d FROM m a LEFT JOIN m b ON a.method = b.method AND a.id <> b.id GROUP BY ALL) GROUP BY method),
e AS (SELECT method, round(((max(u1) - min(u1)) + (max(u2) - min(u2)) + (max(u3) - min(u3))) / 3, 5) AS dispersion_extent FROM m GROUP BY method)
SELECT method, igd, spacing_std, dispersion_extent FROM i JOIN s USING (method) JOIN e USING (method)""",
    records=False,
)
def igd(spark, sf_dir):
    points = cut(_points(spark, sf_dir))
    methods = points.withColumn("method", F.concat(F.lit("m"), (F.col("id") % 3).cast("string")))
    return geometry.quality(methods.drop("id"), points.drop("id"))


@query(f"{POINTS} SELECT least(floor(u1 * 10), 9)::INTEGER AS x_bin, least(floor(u2 * 10), 9)::INTEGER AS y_bin, round(max(u3), 6) AS best_u3, count(*) AS points FROM p GROUP BY ALL", records=False)
def pareto_surface(spark, sf_dir):
    return geometry.surface(_points(spark, sf_dir))


@query(
    """WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT p_brand, first(p_size ORDER BY n DESC, p_size) AS mode FROM c GROUP BY p_brand)
SELECT p_brand, count(*) AS n, round(avg(p_size), 6) AS mean, round(median(p_size), 6) AS median, min(p_size) AS minimum, max(p_size) AS maximum, round(var_samp(p_size), 6) AS variance, any_value(mode) AS mode FROM part JOIN m USING (p_brand) GROUP BY p_brand""",
    records=False,
)
def numeric_summary(spark, sf_dir):
    return geometry.numeric_summary(read(spark, sf_dir, "part"), "p_size", ["p_brand"])


def _problem(spark, sf_dir):
    g = graph.visible(graph.normalize(_words(spark, sf_dir)), 40)
    return cover.problem_of(g.nodes, g.edges, most=6)


def _cover(method):
    def f(spark, sf_dir):
        return cover.solve(spark, _problem(spark, sf_dir), [method], (1, 2), 400)

    f.__name__ = f"cover_{method}"
    return query()(f)


cover_queries = [_cover(m) for m in cover.METHODS]


@query()
def cover_experiment(spark, sf_dir):
    return cover.experiment(spark, _problem(spark, sf_dir), cover.METHODS[:4], 10, 60)


@query()
def bootstrap_ci(spark, sf_dir):
    return cover.bootstrap(_points(spark, sf_dir).withColumn("g", F.col("id") % 3), "u2", "g")


@query(
    """WITH RECURSIVE w(n, ways) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range(1, len(ways) + n + 2), lambda i: coalesce(ways[i], 0) + CASE WHEN i > n + 1 THEN ways[i - n - 1] ELSE 0 END) FROM w WHERE n < 50),
p AS (SELECT p_brand, p_size, avg(p_retailprice) AS a FROM part GROUP BY ALL), q AS (SELECT p_size, avg(p_retailprice) AS b FROM part GROUP BY ALL),
d AS (SELECT p_brand, a - b AS d FROM p JOIN q USING (p_size)),
r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY abs(d)) AS r FROM d WHERE abs(d) > 1e-12),
s AS (SELECT p_brand, count(*) AS n, coalesce(sum(CASE WHEN d > 0 THEN r END), 0) AS plus FROM r GROUP BY ALL),
t AS (SELECT p_brand, count(*) AS n_pairs, round(median(d), 6) AS median_difference FROM d GROUP BY ALL),
e AS (SELECT p_brand, n, least(plus, n * (n + 1) / 2 - plus) AS stat FROM s)
SELECT p_brand, n_pairs, median_difference, round(stat::DOUBLE, 6) AS wilcoxon_statistic, round(least(1.0::DOUBLE, 2 * list_sum(ways[1:(stat + 1)::INT]) / 2.0::DOUBLE ** n), 6) AS p_value, 'exact' AS status
FROM e JOIN t USING (p_brand) JOIN w USING (n)""",
    records=False,
)
def wilcoxon(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    own = part.groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("a"))
    return cover.wilcoxon(own.join(part.groupBy("p_size").agg(F.avg("p_retailprice").alias("b")), "p_size"), "a", "b", "p_brand")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", records=False)
def stream_daily_counts(spark, sf_dir):
    out = streams.run(streams.period_counts(streams.events(spark, sf_dir)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT date_trunc('month', ts)::TIMESTAMP AS month, event_type, count(*) AS n FROM events GROUP BY ALL", records=False)
def stream_month_counts(spark, sf_dir):
    out = streams.run(streams.month_counts(streams.events(spark, sf_dir)), "complete")
    return out.select(F.col("month").cast("timestamp_ntz").alias("month"), "event_type", "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL", records=False)
def stream_dedup(spark, sf_dir):
    out = streams.run(streams.deduplicated(streams.events(spark, sf_dir), ["user_id", "event_type"], "60 days"))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    records=False,
)
def stream_sessions(spark, sf_dir):
    out = streams.run(streams.sessions(streams.events(spark, sf_dir)), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(
    """, u AS (SELECT ord, year, source_type, (CASE WHEN status = 'ok' THEN text_normalized <> '' WHEN status = 'ok_partial' THEN length(text_normalized) >= 100 OR text_length >= 100 ELSE FALSE END) AS usable FROM r),
p AS (SELECT ord, year, source_type, coalesce(sum(CASE WHEN usable THEN 1 ELSE 0 END) OVER (PARTITION BY year, source_type ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS accepted_before FROM u)
SELECT * FROM p WHERE accepted_before < 12"""
)
def stream_quota(spark, sf_dir):
    import uuid

    rows = load(spark, sf_dir).select("ord", "year", "source_type", F.coalesce(usable(), F.lit(False)).cast("int").alias("usable"))
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return streams.run(stateful.quota(spark.readStream.schema(rows.schema).parquet(path), 12))


@query()
def html_visible_text(spark, sf_dir):
    from ..operators.html import visible_pages

    return visible_pages(read(spark, sf_dir, "pages")).select("page_id", "text_visible")


@query()
def clean_article(spark, sf_dir):
    from ..operators.html import clean_pages

    return clean_pages(read(spark, sf_dir, "pages")).select("page_id", "text_clean", F.array_join("cleaning_notes", ", ").alias("cleaning_notes"), "word_count")


@query("SELECT conv_id, turn, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ALL", records=False)
def forum_turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    """SELECT d.doc_id, d.source, CASE WHEN l.quality = 1 THEN 'Checked Name ' || l.doc_id ELSE 'Found Name' END AS actors, coalesce(CASE WHEN l.quality = 1 THEN 'validated' WHEN l.quality = 0 THEN 'rejected' END, 'automatic') AS actor_status
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    records=False,
)
def validation_join(spark, sf_dir):
    """Labels as people's validations: an older one of each is overruled, one without names changes the status only."""
    key = F.col("doc_id").cast("string").alias("doc_key")
    events = read(spark, sf_dir, "documents").select("doc_id", key, "source", F.array(F.lit("Found Name")).alias("actors"))
    names = F.when(F.col("quality") == 1, F.array(F.concat(F.lit("Checked Name "), F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("quality") == 1, "validated").otherwise("rejected").alias("status")
    last = read(spark, sf_dir, "labels").select(key, names.alias("validated_actors"), status, F.lit("b").alias("validator"), F.lit(2).alias("validated_at"))
    first = last.withColumns({"validated_actors": F.array(F.lit("Overruled")), "status": F.lit("draft"), "validated_at": F.lit(1)})
    out = actor_names.apply_validations(events, last.unionByName(first))
    return out.select("doc_id", "source", F.array_join("actors", ", ").alias("actors"), "actor_status")
