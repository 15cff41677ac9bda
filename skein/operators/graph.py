"""Graphs as two tables, ``nodes`` and ``edges``: builders and measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, words, worked_out
from ..storage import cut


@dataclass
class Graph:
    """``nodes``: id, label, node_type, count; ``edges``: source, target, edge_type, weight."""

    nodes: DataFrame
    edges: DataFrame


def endpoints(edges: DataFrame) -> DataFrame:
    """Each edge as seen from both of its ends, in one pass."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"))))
    return edges.select(ends.alias("e"), "weight").select("e.id", "e.other", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and 2E / V(V - 1)."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    v = F.col("nodes")
    return n.crossJoin(m).withColumn("density", F.when(v < 2, 0.0).otherwise(F.round(F.try_divide(2 * F.col("edges"), v * (v - 1)), 5)))


def normalize(graph: Graph) -> Graph:
    """Weights as shares of the largest; raw ones are kept. A node's score is the mean of its shares of count and weighted degree. Unlinked nodes go."""
    top = graph.edges.agg(F.max("weight").alias("x_top"))  # one row
    edges = graph.edges.crossJoin(top).withColumns({"raw_weight": F.col("weight").cast("double"), "weight_norm": F.round(F.coalesce(F.try_divide(F.col("weight"), F.col("x_top")), F.lit(0.0)), 6)})
    edges = edges.withColumn("weight", F.col("weight_norm")).drop("x_top")
    nodes = graph.nodes.join(degrees(graph.edges), "id")
    tops = nodes.agg(F.max("count").alias("x_c"), F.max("weighted_degree").alias("x_w"))
    share = {"count_norm": ("count", "x_c"), "weighted_degree_norm": ("weighted_degree", "x_w")}
    nodes = nodes.crossJoin(tops).withColumns({k: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6) for k, (a, b) in share.items()})
    nodes = nodes.withColumn("weight_norm", F.round((F.col("count_norm") + F.col("weighted_degree_norm")) / 2, 6)).withColumn("score", F.col("weight_norm"))
    return Graph(nodes.drop("x_c", "x_w"), edges)


def weight_stats(graph: Graph) -> DataFrame:
    """One row on the distribution of a normalised graph's weights and degrees. Quantiles are the values at the nearest rank."""
    # Normalised weights are rounded, so a graph of any size has a bounded number of distinct ones; ranks are running counts of these.
    edges = graph.edges.groupBy(F.col("weight_norm").alias("w")).agg(F.count(F.lit(1)).alias("c"))
    order, whole = Window.partitionBy(F.lit(0)).orderBy("w"), Window.partitionBy(F.lit(0))
    ranked = edges.withColumns({"k": F.sum("c").over(order), "n": F.sum("c").over(whole)})

    def at(q: float, name: str) -> Column:
        return F.min(F.when(F.col("k") > F.bround((F.col("n") - 1) * q).cast("long"), F.col("w"))).alias(name)

    tenth = F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))
    mean = F.sum(F.col("w") * F.col("c")) / F.sum("c")
    e = ranked.agg(
        F.round(F.min("w"), 6).alias("edge_weight_min"), F.round(F.max("w"), 6).alias("edge_weight_max"), F.round(mean, 6).alias("edge_weight_mean"),
        F.round(F.greatest(F.lit(0.0), F.sum(F.col("w") * F.col("w") * F.col("c")) / F.sum("c") - mean * mean), 6).alias("edge_weight_variance"), at(0.25, "edge_weight_q25"), at(0.5, "edge_weight_q50"), at(0.75, "edge_weight_q75"),
        F.round(F.try_divide(F.sum(F.col("w") * F.greatest(F.lit(0), F.least(F.col("c"), F.col("k") - F.col("n") + tenth))), F.sum(F.col("w") * F.col("c"))), 6).alias("top_10pct_edge_weight_share"), F.coalesce(F.sum("c"), F.lit(0)).alias("x_e"),
    )
    n = graph.nodes.agg(
        F.round(F.avg("weight_norm"), 6).alias("node_weight_mean"), F.round(F.var_pop("weight_norm"), 6).alias("node_weight_variance"),
        F.round(F.avg("degree"), 6).alias("degree_mean"), F.round(F.var_pop("degree"), 6).alias("degree_variance"), F.count(F.lit(1)).alias("x_n"),
    )
    kind = (
        F.when((F.col("x_n") < 3) | (F.col("x_e") == 0), "insufficient_data")
        .when((F.col("degree_mean") > 0) & (F.try_divide(F.col("degree_variance"), F.col("degree_mean")) > 2.5), "heterogeneous_or_hub_dominated")
        .when(F.col("top_10pct_edge_weight_share") > 0.55, "weight_concentrated")
        .otherwise("relatively_homogeneous")
    )
    return e.crossJoin(n).withColumn("network_type_diagnostic", kind).drop("x_e", "x_n")


def connected_components(edges: DataFrame, most: int = 200) -> DataFrame:
    """``id, component``: the least id that each node reaches. Labels spread along links and jump along labels until none changes."""
    links = cut(endpoints(edges).select("id", "other").distinct())
    labels = cut(links.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")))
    for _ in range(most):
        near = links.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", F.least("component", "m").alias("c"))
        jump = step.select(F.col("id").alias("c"), F.col("c").alias("up"))
        new = cut(step.join(jump, "c", "left").select("id", F.coalesce("up", "c").alias("component")))
        if new.join(labels.withColumnRenamed("component", "old"), "id").filter("component <> old").isEmpty():
            return new
        labels = new
    raise RuntimeError("the components did not settle")


def window_pairs(tokens: Column, width: int) -> Column:
    """Pairs of different tokens at most ``width`` places apart, each in alphabetical order."""

    def pairs(t: Column) -> Column:
        def of(i: Column) -> Column:
            near = F.slice(t, i + 1, F.lit(width))
            here = F.get(t, i - 1)
            return F.transform(F.filter(near, lambda o: o != here), lambda o: F.struct(F.least(here, o).alias("source"), F.greatest(here, o).alias("target")))

        return F.when(F.size(t) > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), of))).otherwise(F.array().cast("array<struct<source:string,target:string>>"))

    return let(tokens, pairs)


def cooccurrence(rows: DataFrame, vocabulary: Sequence[str], width: int = 4, least: int = 2) -> Graph:
    """Terms of a bounded vocabulary that stand near each other once all other terms are left out. ``rows``: ``terms``.

    Nodes and links are counted in one pass over the texts. What is left is as
    small as the vocabulary, and is kept: measures that use the graph many times don't read the texts again.
    """
    pairs = window_pairs(F.col("t"), width)
    alone = F.transform("t", lambda t: F.struct(t.alias("source"), F.lit(None).cast("string").alias("target")))
    kept = worked_out(rows, t=F.filter("terms", lambda t: t.isin(*vocabulary)) if vocabulary else words(())).select("t")
    counts = cut(kept.select(F.explode(F.concat(alone, pairs)).alias("p")).groupBy("p.source", "p.target").agg(F.count(F.lit(1)).alias("weight")))
    nodes = counts.filter("target IS NULL").select(F.col("source").alias("id"), F.col("source").alias("label"), F.lit("term").alias("node_type"), F.col("weight").alias("count"))
    return Graph(nodes, counts.filter((F.col("weight") >= least) & F.col("target").isNotNull()).withColumn("edge_type", F.lit("cooccurrence")))


def node(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}::"), value)


def influence(propositions: DataFrame, least: int = 2) -> Graph:
    """Directed links of sources, speech acts, actors and signals; nodes count their mentions."""
    source, act, actor = node("source", F.col("medium")), node("speech_act", F.col("speech_act")), node("actor", F.lower("subject"))
    has_actor = F.col("subject") != ""

    def listed(column: str, kind: str, label: str, edge: str):
        items = F.filter(F.split(column, ", "), lambda x: x != "")
        return F.transform(items, lambda x: F.struct(source.alias("source"), node(kind, x).alias("target"), F.lit(edge).alias("edge_type"))), F.transform(items, lambda x: F.struct(node(kind, x).alias("id"), x.alias("label"), F.lit(label).alias("node_type")))

    def one(a, b, kind, when=None):
        s = F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("edge_type"))
        return s if when is None else F.when(when, s)

    def named(i, lab, kind, when=None):
        s = F.struct(i.alias("id"), lab.alias("label"), F.lit(kind).alias("node_type"))
        return s if when is None else F.when(when, s)

    causal = F.lit("logic::causal_claim")
    fallacies, vectors = listed("fallacies", "fallacy", "fallacy_signal", "contains_fallacy_signal"), listed("disinformation_vectors", "vector", "disinformation_vector", "contains_vector_signal")
    single = [one(source, act, "uses_speech_act"), one(source, actor, "mentions_actor", has_actor), one(actor, act, "actor_in_speech_act", has_actor), one(source, causal, "makes_logic_move", F.col("has_causal_relation"))]
    edges = F.concat(F.filter(F.array(*single), lambda e: e.isNotNull()), fallacies[0], vectors[0])
    own = [named(source, F.col("medium"), "source"), named(act, F.col("speech_act"), "speech_act"), named(actor, F.col("subject"), "actor", has_actor), named(causal, F.lit("causal claim"), "logic", F.col("has_causal_relation"))]
    nodes = F.concat(F.filter(F.array(*own), lambda e: e.isNotNull()), fallacies[1], vectors[1])
    found = propositions.select(F.explode(edges).alias("e")).groupBy("e.source", "e.target", "e.edge_type").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least)
    every = propositions.select(F.explode(nodes).alias("n")).groupBy("n.id").agg(F.min("n.label").alias("label"), F.first("n.node_type").alias("node_type"), F.count(F.lit(1)).alias("count"))
    return Graph(every, found)


def pairs_of(items: Column, kind: str) -> Column:
    """All pairs of an array of a bounded number of ids, each in alphabetical order."""
    return let(
        F.array_distinct(items),
        lambda x: F.flatten(F.transform(x, lambda a: F.transform(F.filter(x, lambda b: b > a), lambda b: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("edge_type"))))),
    )


def event_graph(events: DataFrame, stages: Sequence[str], most_actors: int = 8, least: int = 1, emphasis: bool = False) -> Graph:
    """Documents, sources, years, genres, flows, stages and actors of events, and what links them.

    ``emphasis`` gives stages double weight and documents one plus their
    completeness. ``events`` may have ``actors``, an array.
    """
    doc = node("doc", F.col("ord").cast("string"))
    meta = {
        "source": node("source", F.coalesce("medium", F.lit("unknown"))),
        "year": node("year", F.coalesce(F.col("year").cast("string"), F.lit("unknown"))),
        "type": node("type", F.coalesce("source_type", F.lit("other"))),
        "flow": node("flow", F.coalesce("narrative_flow_stage", F.lit("unknown"))),
    }
    heavy = 2.0 if emphasis else 1.0
    present = F.filter(F.array(*[F.when(F.col(s) != "", F.lit(f"stage::{s}")) for s in stages]), lambda s: s.isNotNull())
    named = F.transform(F.slice("actors", 1, most_actors), lambda a: node("actor", a)) if "actors" in events.columns else F.array().cast("array<string>")
    rows = events.select(doc.alias("doc"), *[c.alias(k) for k, c in meta.items()], present.alias("stages"), F.array_distinct(named).alias("actors"), F.lit(1.0).alias("one"), F.col("narrative_completeness").alias("full"))

    def link(a, b, kind, weight=1.0):
        return F.struct(F.least(a, b).alias("source"), F.greatest(a, b).alias("target"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"))

    kinds = {"source": "document_source", "year": "document_year", "type": "document_source_type", "flow": "document_flow"}
    edges = [F.array(*[link(F.col("doc"), F.col(k), kind) for k, kind in kinds.items()])]
    edges.append(F.transform("stages", lambda s: link(F.col("doc"), s, "document_stage", heavy)))
    edges += [_each("stages", k, f"{k}_stage", link) for k in kinds]
    edges.append(_each("actors", "doc", "document_actor", link))
    edges.append(F.flatten(F.transform("actors", lambda a: F.transform("stages", lambda s: link(a, s, "actor_stage")))))
    edges += [F.transform(pairs_of(F.col(c), kind), lambda p: F.struct(p["source"], p["target"], p["edge_type"], F.lit(1.0).alias("weight"))) for c, kind in (("actors", "actor_co_document"), ("stages", "stage_co_document"))]
    found = rows.select(F.explode(F.concat(*edges)).alias("e")).groupBy("e.source", "e.target", "e.edge_type").agg(F.round(F.sum("e.weight"), 3).alias("weight")).filter((F.col("weight") >= least) & (F.col("source") != F.col("target")))
    size = F.lit(1.0) + F.col("full") if emphasis else F.col("one")
    own = F.concat(F.array(F.struct(F.col("doc").alias("id"), size.alias("w")), *[F.struct(F.col(k).alias("id"), F.col("one").alias("w")) for k in kinds]), F.transform("stages", lambda s: F.struct(s.alias("id"), F.lit(heavy).alias("w"))), F.transform("actors", lambda a: F.struct(a.alias("id"), F.lit(1.0).alias("w"))))
    nodes = rows.select(F.explode(own).alias("n")).groupBy("n.id").agg(F.round(F.sum("n.w"), 3).alias("count"))
    return Graph(nodes.select("id", F.element_at(F.split("id", "::", 2), 2).alias("label"), F.split("id", "::", 2)[0].alias("node_type"), "count"), found)


def _each(items: str, other: str, kind: str, link) -> Column:
    return F.transform(items, lambda x: link(F.col(other), x, kind))


def knowledge(rows: DataFrame, most_concepts: int = 80, least: int = 2) -> Graph:
    """Concepts of documents, linked to their source, year, place and flow and to each other. ``rows``: ``concepts, medium, year, localization, narrative_flow_stage``."""
    concepts = F.slice(F.array_sort(F.array_distinct("concepts")), 1, most_concepts)
    meta = {"source": "medium", "year": "year", "geo": "localization", "flow": "narrative_flow_stage"}
    base = rows.select(concepts.alias("c"), *[node(k, F.coalesce(F.col(c).cast("string"), F.lit("unknown"))).alias(k) for k, c in meta.items()])
    links = [_concept_links(k) for k in meta] + [pairs_of(F.col("c"), "concept_co_document")]
    edges = base.select(F.explode(F.concat(*links)).alias("e")).groupBy("e.source", "e.target", "e.edge_type").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least)
    counted = base.select(F.explode("c").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("count")).withColumn("node_type", F.lit("concept"))
    linked = edges.filter("edge_type <> 'concept_co_document'").select(F.col("source").alias("id")).distinct().select("id", F.lit(0).cast("long").alias("count"), F.split("id", "::", 2)[0].alias("node_type"))
    return Graph(counted.unionByName(linked).select("id", F.col("id").alias("label"), "node_type", "count"), edges)


def _concept_links(kind: str) -> Column:
    return F.transform("c", lambda x: F.struct(F.col(kind).alias("source"), x.alias("target"), F.lit(f"{kind}_concept").alias("edge_type")))


def marginals(graph: Graph, chosen: DataFrame, weight: str = "score") -> DataFrame:
    """What each of the ``chosen`` nodes (``id, rank``) adds to those before it: its weight, and the edges that none of them touches.

    An edge is first touched at the lesser rank of its ends, so nothing is
    compared with all before it: one aggregation by rank, then running sums over
    as many rows as were chosen.
    """
    ranks = chosen.select("id", "rank")
    a, b = ranks.select(F.col("id").alias("source"), F.col("rank").alias("ra")), ranks.select(F.col("id").alias("target"), F.col("rank").alias("rb"))
    first = graph.edges.join(a, "source", "left").join(b, "target", "left").withColumn("rank", F.least("ra", "rb"))
    added = first.filter("rank IS NOT NULL").groupBy("rank").agg(F.count(F.lit(1)).alias("new_edges"), F.sum("weight").alias("new_edge_weight"))
    own = ranks.join(graph.nodes.select("id", F.col(weight).alias("node_weight")), "id").join(added, "rank", "left").fillna(0, ["new_edges", "new_edge_weight"])
    totals = graph.edges.agg(F.sum("weight").alias("x_e")).crossJoin(graph.nodes.agg(F.sum(weight).alias("x_n")))  # one row each
    so_far = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    running = {f"cumulative_{c}": F.sum(c).over(so_far) for c in ("node_weight", "new_edges", "new_edge_weight")}
    out = own.withColumns(running).crossJoin(totals)
    return out.select(
        "rank", "id", F.round("node_weight", 6).alias("node_weight"), "new_edges", F.round("new_edge_weight", 6).alias("new_edge_weight"),
        F.col("cumulative_new_edges").alias("edges_touched"), F.round(F.try_divide("cumulative_node_weight", "x_n"), 6).alias("node_weight_share"), F.round(F.try_divide("cumulative_new_edge_weight", "x_e"), 6).alias("edge_weight_share"),
    )


def topics(nodes: DataFrame, members: DataFrame, most: int = 12, terms: int = 12, kinds: Sequence[str] = ("monogram", "bigram", "trigram")) -> DataFrame:
    """``topic_group, central_ngram, size, terms`` of the ``most`` largest groups of ``members`` (``id, component``), the least first of equals.

    Terms are nodes of the given kinds, by weighted degree and count, of equals
    by id; a group without any is named by its number.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(most)
    numbered = sizes.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "component")))
    own = members.join(nodes.filter(F.col("node_type").isin(*kinds)), "id")
    best = own.groupBy("component").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weighted_degree")).alias("d"), (-F.col("count")).alias("c"), "id", "label"))), 1, terms).alias("t"))
    central = F.coalesce(F.get("t", F.lit(0))["label"], F.concat(F.lit("group_"), F.col("k").cast("string")))
    return numbered.join(best, "component", "left").select(
        F.concat(F.lit("topic_"), F.col("k").cast("string"), F.lit("_"), F.substring(F.replace(central, F.lit(" "), F.lit("_")), 1, 40)).alias("topic_group"), central.alias("central_ngram"), "size",
        F.coalesce(F.array_join(F.transform("t", lambda x: x["label"]), ", "), F.lit("")).alias("terms"),
    )


def visible(graph: Graph, limit: int = 50) -> Graph:
    """The best nodes by score and the edges among them; ``limit`` bounds what is broadcast."""
    nodes = graph.nodes.orderBy(F.desc("score"), "id").limit(limit)
    ids = nodes.select("id")
    edges = graph.edges.join(F.broadcast(ids.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "target")), "target", "left_semi")
    return Graph(nodes, edges)
