"""Queries on texts: terms, dictionaries, sentences, propositions, frames, sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import actors as actor_names
from ..operators import extract, terms
from ..schema import records as load
from .catalog import SQUEEZE, TOKENS, query

STOPS = ("the", "and", "der")
FRAMES, MARKS = lexicon.PROSE_FRAMES, lexicon.PROSE_MARKERS
NOT_STOP = "t NOT IN ('the', 'and', 'der')"
KEPT = f"list_filter({TOKENS}, lambda t: {NOT_STOP})"
EVENTS = {"initial_event": ("the", "der"), "conflict": ("and", "und"), "turning_point": ("with", "for"), "resolution": ("que", "that"), "consequences": ("from", "mit")}
ACTS = {"assertive": ("is", "was"), "directive": ("that", "for"), "commissive": ("with",)}
PARTS = {"problem": ("the ", "der "), "culprit": ("from", "von"), "solution": ("with", "mit"), "urgency": ("que", "was")}
GOOD, BAD, NO, MUCH = ("the", "that"), ("and", "und", "from"), ("with", "was"), ("for",)


def grams(n: int) -> str:
    """Rows ``ord, p, term`` of n-grams of kept tokens."""
    return f""", k AS (SELECT ord, year, source_type, {KEPT} AS t FROM r),
g AS (SELECT ord, year, source_type, p, array_to_string(t[p:p + {n - 1}], ' ') AS term FROM (SELECT *, unnest(range(1, len(t) - {n - 2})) AS p FROM k WHERE len(t) >= {n}))"""


def top(n: int, limit: int, least: int) -> str:
    return f"{grams(n)}, c AS (SELECT term, count(*) AS count, min(ord * 1000000000 + p) AS f FROM g GROUP BY term ORDER BY count DESC, f LIMIT {limit}) SELECT term, count FROM c WHERE count >= {least}"


@query(top(1, 30, 1))
def top_terms(spark, sf_dir):
    return terms.top_terms(load(spark, sf_dir), 1, 30, 1, STOPS)


@query(top(2, 30, 2))
def top_bigrams(spark, sf_dir):
    return terms.top_terms(load(spark, sf_dir), 2, 30, 2, STOPS)


@query(top(3, 30, 2))
def top_trigrams(spark, sf_dir):
    return terms.top_terms(load(spark, sf_dir), 3, 30, 2, STOPS)


@query(
    f"""{grams(1)}, c AS (SELECT term, count(*) AS count, min(ord * 1000000000 + p) AS f FROM g GROUP BY term ORDER BY count DESC, f LIMIT 20),
s AS (SELECT term, count, row_number() OVER w AS rank, round(count / sum(count) OVER ()::DOUBLE, 5) AS weight_share, round(sum(count) OVER w / (sum(count) OVER ())::DOUBLE, 5) AS cumulative_weight_share,
  sum(count) OVER w / (sum(count) OVER ())::DOUBLE <= 0.8 OR row_number() OVER w = 1 AS core FROM c WINDOW w AS (ORDER BY count DESC, term ROWS UNBOUNDED PRECEDING)) SELECT * FROM s"""
)
def pareto_terms(spark, sf_dir):
    return terms.term_shares(load(spark, sf_dir), 20, STOPS)


@query(
    f""", g AS (SELECT ord, unnest({TOKENS}) AS term, generate_subscripts({TOKENS}, 1) AS p FROM r),
c AS (SELECT term, count(*) AS raw_count, min(ord * 1000000000 + p) AS f FROM g GROUP BY term ORDER BY raw_count DESC, f LIMIT 60)
SELECT term, raw_count FROM c WHERE term NOT IN ('the', 'and', 'der') AND raw_count >= 3 ORDER BY raw_count DESC, f LIMIT 20"""
)
def stopword_candidates(spark, sf_dir):
    return terms.stopword_candidates(load(spark, sf_dir), 20, STOPS)


@query(
    f"""{grams(1)}, v AS (SELECT term FROM g GROUP BY term ORDER BY count(*) DESC, min(ord * 1000000000 + p) LIMIT 20),
c AS (SELECT source_type AS dimension, term, count(*) AS count FROM g WHERE term IN (SELECT term FROM v) GROUP BY ALL)
SELECT *, round(count / (max(count) OVER ())::DOUBLE, 6) AS global_share, round(count / (sum(count) OVER (PARTITION BY dimension))::DOUBLE, 6) AS dimension_share FROM c"""
)
def term_dimension_matrix(spark, sf_dir):
    return terms.dimension_matrix(load(spark, sf_dir), "source_type", 20, 1, STOPS)


def hits(term: str) -> str:
    return rf"len(regexp_extract_all(lower(text_normalized), '\b{term}\b'))"


def group_sql(groups, by=""):
    """Long rows of hits, then the group's figures."""
    each = ", ".join(f"{{'g': '{g}', 't': '{t}', 'i': {i}, 'n': {hits(t)}}}" for g, ts in groups.items() for i, t in enumerate(ts))
    key = f"{by}, " if by else ""
    total = f"JOIN (SELECT {by}, count(*) AS docs FROM r GROUP BY {by}) USING ({by})" if by else "CROSS JOIN (SELECT count(*) AS docs FROM r)"
    return f""", h AS (SELECT ord, {key}unnest([{each}]) AS x FROM r),
d AS (SELECT {key}x.g AS "group", ord, sum(x.n) AS n FROM h GROUP BY ALL),
s AS (SELECT {key}"group", sum(n)::BIGINT AS keyword_hits, count_if(n > 0)::BIGINT AS documents_with_group FROM d GROUP BY ALL),
t AS (SELECT {key}x.g AS "group", x.t AS term, x.i AS i, sum(x.n) AS n FROM h GROUP BY ALL HAVING sum(x.n) > 0),
b AS (SELECT {key}"group", string_agg(term, ', ' ORDER BY n DESC, i) AS top_terms FROM t GROUP BY ALL)
SELECT {key}s."group", keyword_hits, documents_with_group, round(documents_with_group / greatest(1, docs)::DOUBLE, 4) AS document_share, coalesce(top_terms, '') AS top_terms
FROM s LEFT JOIN b USING ({key}"group") {total}"""


@query(group_sql(FRAMES))
def frame_counts(spark, sf_dir):
    return terms.group_counts(load(spark, sf_dir), FRAMES)


@query(group_sql(FRAMES, "year"))
def frame_counts_year(spark, sf_dir):
    return terms.group_counts(load(spark, sf_dir), FRAMES, ["year"])


@query(group_sql(MARKS))
def idea_groups(spark, sf_dir):
    return terms.group_counts(load(spark, sf_dir), MARKS, top=8)


@query("SELECT ord, " + ", ".join(f"({' + '.join(hits(t) for t in ts)})::INTEGER AS {g}" for g, ts in FRAMES.items()) + " FROM r")
def idea_matrix(spark, sf_dir):
    return terms.group_matrix(load(spark, sf_dir), FRAMES)


def split_sql(source: str, capital: bool) -> str:
    """Sentences as a list: a mark is put where one ends."""
    after = "([A-ZÁÉÍÓÚÑ0-9¿¡])" if capital else r"(\S)"
    back = r"\1' || chr(1) || '\2"
    return rf"string_split(regexp_replace({SQUEEZE.format(source)}, '([.!?¿¡])\s+{after}', '{back}', 'g'), chr(1))"


SENT_A = f"list_filter({split_sql('text_clean', True)}, lambda s: length(s) BETWEEN 45 AND 500)[1:80]"
SENT_B = f"list_filter({split_sql('''title || ' ' || text_clean''', False)}, lambda s: length(s) >= 25)"


@query(f"SELECT ord, len({SENT_A}) AS sentences, sha256(array_to_string({SENT_A}, '|')) AS digest FROM r")
def sentences_a(spark, sf_dir):
    parts = text.event_sentences(F.col("text_clean"))
    return load(spark, sf_dir).select("ord", F.size(parts).cast("long").alias("sentences"), F.sha2(F.array_join(parts, "|"), 256).alias("digest"))


@query(f"SELECT ord, len({SENT_B}[1:40]) AS sentences, sha256(array_to_string({SENT_B}[1:40], '|')) AS digest FROM r")
def sentences_b(spark, sf_dir):
    parts = text.sentences(F.concat_ws(" ", "title", "text_clean"), 40)
    return load(spark, sf_dir).select("ord", F.size(parts).cast("long").alias("sentences"), F.sha2(F.array_join(parts, "|"), 256).alias("digest"))


def marks_sql(stage):
    marks = ", ".join(rf"CASE WHEN regexp_matches(lower(s), '(^|[^\p{{L}}\p{{N}}_]){t}($|[^\p{{L}}\p{{N}}_])') THEN '{t}' END" for t in EVENTS[stage])
    return f"list_filter([{marks}], lambda m: m IS NOT NULL)"


EVENT_ROWS = f""", e AS (SELECT ord, list_filter({split_sql("title || '. ' || text_normalized", True)}, lambda s: length(s) BETWEEN 45 AND 500)[1:80] AS a FROM r),
s AS (SELECT ord, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM e),
""" + ",\n".join(
    f"b_{k} AS (SELECT ord, first(s ORDER BY len(m) DESC, i) AS {k}, array_to_string(first(m ORDER BY len(m) DESC, i), ', ') AS {k}_markers FROM (SELECT *, {marks_sql(k)} AS m FROM s) WHERE len(m) > 0 GROUP BY ord)" for k in EVENTS
) + ",\nv AS (SELECT ord, " + ", ".join(f"coalesce({k}, '') AS {k}, coalesce({k}_markers, '') AS {k}_markers" for k in EVENTS) + " FROM r " + " ".join(f"LEFT JOIN b_{k} USING (ord)" for k in EVENTS) + ")"
PRESENT = " + ".join(f"(CASE WHEN {k} <> '' THEN 1 ELSE 0 END)" for k in EVENTS)


@query(f"{EVENT_ROWS} SELECT *, ({PRESENT})::INTEGER AS stages_detected, round(({PRESENT}) / 5.0::DOUBLE, 3) AS narrative_completeness FROM v")
def narrative_events(spark, sf_dir):
    found = extract.narrative_events(load(spark, sf_dir), EVENTS)
    return found.select("ord", *EVENTS, *[f"{k}_markers" for k in EVENTS], F.col("stages_detected").cast("int").alias("stages_detected"), "narrative_completeness")


@query(f"{EVENT_ROWS} " + " UNION ALL ".join(f"SELECT '{k}' AS narrative_stage, count_if({k} <> '')::BIGINT AS documents_with_stage, round(count_if({k} <> '') / count(*)::DOUBLE, 4) AS document_share FROM v" for k in EVENTS))
def event_summary(spark, sf_dir):
    return extract.event_summary(extract.narrative_events(load(spark, sf_dir), EVENTS), tuple(EVENTS))


SENTENCES = f""", p AS (SELECT ord, year, source_type, medium, unnest({SENT_B}[1:40]) AS s, generate_subscripts({SENT_B}[1:40], 1) AS i FROM r)"""


def first_mark(groups, what):
    cases = []
    for g, ts in groups.items():
        for t in ts:
            cases.append(f"WHEN contains(lower(s), '{t}') THEN '{g if what == 'group' else t}'")
    return f"CASE {' '.join(cases)} ELSE '{'assertive' if what == 'group' else 'default_statement'}' END"


@query(f"{SENTENCES} SELECT {first_mark(ACTS, 'group')} AS speech_act, {first_mark(ACTS, 'term')} AS speech_marker, count(*) AS sentences FROM p GROUP BY ALL")
def speech_acts(spark, sf_dir):
    found = extract.propositions(load(spark, sf_dir), acts=ACTS)
    return found.groupBy("speech_act", "speech_marker").agg(F.count(F.lit(1)).alias("sentences"))


def group_labels(groups):
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(lower(s), '{t}')''' for t in ts)} THEN '{g}' END" for g, ts in groups.items()) + ")"


@query(f"{SENTENCES} SELECT ord, i AS sentence_index, {group_labels(MARKS)} AS fallacies, contains(lower(s), 'que') OR contains(lower(s), 'that') AS has_causal_relation FROM p")
def marker_detection(spark, sf_dir):
    rows = load(spark, sf_dir)
    found = extract.propositions(rows, fallacies=MARKS, causal=("que", "that"))
    return found.select(F.substring("url", 7, 20).cast("long").alias("ord"), F.col("sentence_index").cast("long").alias("sentence_index"), "fallacies", "has_causal_relation")


WORDS = r"regexp_extract_all(s, '[\p{L}\p{N}\p{M}_-]+')"
VERB = "list_position(list_transform(w, lambda x: lower(x) IN ('is', 'was', 'are', 'es', 'ist') OR regexp_matches(lower(x), '(ó|o|a|an|en|ed|ing)$')), TRUE)"
SVO = f"""{SENTENCES}, w AS (SELECT *, {WORDS} AS w FROM p), v AS (SELECT *, coalesce({VERB}, 0) AS vi FROM w),
o AS (SELECT *, CASE WHEN vi > 1 THEN array_to_string(w[greatest(1, vi - 5):vi - 1], ' ') ELSE '' END AS subject, CASE WHEN vi > 1 THEN w[vi] ELSE '' END AS verb,
  CASE WHEN vi > 1 THEN array_to_string(w[vi + 1:vi + 8], ' ') ELSE '' END AS object FROM v)"""


@query(f"{SVO} SELECT ord, i AS sentence_index, subject, verb, object, CASE WHEN subject <> '' AND object <> '' THEN 'medium' ELSE 'low' END AS svo_confidence FROM o")
def svo(spark, sf_dir):
    found = extract.propositions(load(spark, sf_dir), verbs=lexicon.PROSE_VERBS)
    return found.select(F.substring("url", 7, 20).cast("long").alias("ord"), F.col("sentence_index").cast("long").alias("sentence_index"), "subject", "verb", "object", "svo_confidence")


SURE = f"round(0.35::DOUBLE + CASE WHEN subject <> '' AND verb <> '' THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN object <> '' THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN {group_labels(MARKS)} <> '' THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN {group_labels(FRAMES)} <> '' THEN 0.05::DOUBLE ELSE 0 END, 3)"
HASH = rf"sha256(url || '|' || {SQUEEZE.format('title')} || '|||' || status || '|' || {SQUEEZE.format('text_clean')})"
FOUND = f"""{SVO}, q AS (SELECT o.*, {first_mark(ACTS, 'group')} AS speech_act, {group_labels(MARKS)} AS fallacies, {group_labels(FRAMES)} AS disinformation_vectors, contains(lower(s), 'que') AS has_causal_relation, {SURE} AS structural_confidence FROM o)"""


def _found(spark, sf_dir):
    return extract.propositions(load(spark, sf_dir), acts=ACTS, causal=("que",), fallacies=MARKS, vectors=FRAMES, verbs=lexicon.PROSE_VERBS)


@query(
    f"""{FOUND}, h AS (SELECT ord, {HASH} AS record_hash FROM r)
SELECT substring(sha1(record_hash || ':' || i || ':' || s), 1, 16) AS proposition_id, s AS sentence, speech_act, fallacies, disinformation_vectors, has_causal_relation, structural_confidence FROM q JOIN h USING (ord)"""
)
def propositions(spark, sf_dir):
    return _found(spark, sf_dir).select("proposition_id", "sentence", "speech_act", "fallacies", "disinformation_vectors", "has_causal_relation", "structural_confidence")


def entropy_sql(value):
    return f"(SELECT year, source_type, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 5) AS e FROM (SELECT year, source_type, {value} AS v, count(*) AS n FROM q WHERE {value} <> '' GROUP BY ALL) GROUP BY ALL)"


@query(
    f"""{FOUND} SELECT year, source_type, count(*) AS propositions, count_if(has_causal_relation)::BIGINT AS causal_relations, count_if(fallacies <> '')::BIGINT AS fallacy_signals,
  count_if(disinformation_vectors <> '')::BIGINT AS disinformation_vector_signals, round(avg(structural_confidence), 5) AS mean_structural_confidence,
  any_value(a.e) AS speech_act_entropy, coalesce(any_value(b.e), 0) AS predicate_entropy
FROM q LEFT JOIN {entropy_sql('speech_act')} a USING (year, source_type) LEFT JOIN {entropy_sql('lower(verb)')} b USING (year, source_type) GROUP BY year, source_type"""
)
def structural_summary(spark, sf_dir):
    return extract.structural_summary(_found(spark, sf_dir))


@query(
    f"{FOUND} SELECT medium, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 5) AS entropy FROM (SELECT medium, speech_act, count(*) AS n FROM q GROUP BY ALL) GROUP BY medium"
)
def entropy(spark, sf_dir):
    return extract.entropy(_found(spark, sf_dir), ["medium"], F.col("speech_act"), "entropy")


def part_sql(terms_of):
    return "coalesce(substring(list_filter(a, lambda s: " + " OR ".join(f"contains(lower(s), '{t}')" for t in terms_of) + ")[1], 1, 500), '')"


FRAME_ROWS = f""", a AS (SELECT ord, medium, year, url, {SENT_B}[1:60] AS a FROM r), f0 AS (SELECT ord, medium, year, {", ".join(f"{part_sql(t)} AS {p}" for p, t in PARTS.items())} FROM a),
f AS (SELECT *, array_to_string(list_filter(list_transform(regexp_extract_all(concat_ws(' ', {", ".join(PARTS)}), '[\\p{{L}}\\p{{N}}\\p{{M}}_-]+'), lambda t: lower(t)), lambda t: length(t) > 2)[1:80], ' ') AS frame_terms,
  round(({" + ".join(f"(CASE WHEN {p} <> '' THEN 1 ELSE 0 END)" for p in PARTS)}) / 4.0::DOUBLE, 3) AS frame_density FROM f0)"""


@query(f"{FRAME_ROWS} SELECT ord, {', '.join(PARTS)}, frame_terms, frame_density FROM f")
def argument_frames(spark, sf_dir):
    return extract.argument_frames(load(spark, sf_dir), parts=PARTS).select("ord", *PARTS, "frame_terms", "frame_density")


TOPICS = ("thereon", "und", "ciónque", "nowhere at all")


@query(
    f"""{FRAME_ROWS}, m AS (SELECT medium, lower(concat_ws(' ', {", ".join(PARTS)}, frame_terms)) AS h FROM f), t AS (SELECT unnest(['thereon', 'und', 'ciónque', 'nowhere at all']) AS expected_topic),
c AS (SELECT expected_topic, (SELECT count(DISTINCT medium) FROM m) AS sources_total, (SELECT count(DISTINCT medium) FROM m WHERE contains(h, expected_topic)) AS sources_mentioning FROM t)
SELECT *, round(1.0::DOUBLE - sources_mentioning / sources_total::DOUBLE, 5) AS missing_share, 1.0::DOUBLE - sources_mentioning / sources_total::DOUBLE >= 0.7 AS alert,
  CASE WHEN 1.0::DOUBLE - sources_mentioning / sources_total::DOUBLE >= 0.7 THEN 'IGNORA_A' ELSE 'CUBRE_A' END AS relation_type,
  CASE WHEN 1.0::DOUBLE - sources_mentioning / sources_total::DOUBLE >= 0.7 THEN 'high_value_silence_alert' ELSE 'no_alert' END AS storage_decision FROM c"""
)
def silence_alerts(spark, sf_dir):
    return extract.silence_alerts(extract.argument_frames(load(spark, sf_dir), parts=PARTS), TOPICS, parts=tuple(PARTS))


def quoted(ts):
    return "(" + ", ".join(f"'{t}'" for t in ts) + ")"


CANON_TITLE = r"regexp_replace(regexp_replace(translate(lower(title || ' ' || text_normalized), 'áéíóúüñ', 'aeiouun'), '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', 'Z', 'g')"
SENTIMENT = rf""", k AS (SELECT ord, year, source_type, regexp_extract_all(lower({CANON_TITLE}), '\b([a-z][a-z0-9_-]{{2,}})\b', 1) AS t FROM r),
h AS (SELECT ord, t[p] AS term, p, (CASE WHEN len(list_filter(t[greatest(1, p - 3):p - 1], lambda x: x IN {quoted(MUCH)})) > 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN t[p] IN {quoted(GOOD)} THEN 1 ELSE -1 END)
  * (CASE WHEN len(list_filter(t[greatest(1, p - 3):p - 1], lambda x: x IN {quoted(NO)})) > 0 THEN -1 ELSE 1 END) AS v FROM (SELECT *, unnest(range(1, len(t) + 1)) AS p FROM k) WHERE t[p] IN {quoted(GOOD + BAD)}),
a AS (SELECT ord, sum(CASE WHEN v > 0 THEN v ELSE 0 END) AS pos, sum(CASE WHEN v < 0 THEN -v ELSE 0 END) AS neg, array_to_string((list(term ORDER BY p))[1:40], ', ') AS terms FROM h GROUP BY ord),
s AS (SELECT r.ord, r.year, r.source_type, coalesce((pos - neg) / (pos + neg), 0) AS score, round(coalesce(pos, 0), 3) AS positive_hits, round(coalesce(neg, 0), 3) AS negative_hits, coalesce(terms, '') AS sentiment_terms FROM r LEFT JOIN a USING (ord))"""


def _sentiment(spark, sf_dir):
    rows = load(spark, sf_dir).withColumn("title", text.canon(F.col("title")))
    return extract.sentiment(rows, GOOD, BAD, NO, MUCH)


@query(f"{SENTIMENT} SELECT ord, round(score, 5) AS sentiment_score, positive_hits, negative_hits, CASE WHEN score >= 0.15 THEN 'positive' WHEN score <= -0.15 THEN 'negative' ELSE 'neutral_or_mixed' END AS sentiment_label, sentiment_terms FROM s")
def sentiment_docs(spark, sf_dir):
    return _sentiment(spark, sf_dir).select("ord", "sentiment_score", "positive_hits", "negative_hits", "sentiment_label", "sentiment_terms")


@query(
    f"{SENTIMENT} SELECT year, source_type, count(*) AS documents, round(avg(round(score, 5)), 5) AS mean_sentiment, round(var_pop(round(score, 5)), 5) AS sentiment_variance, round(stddev_pop(round(score, 5)), 5) AS sentiment_std, round((avg(round(score, 5)) + 1) / 2, 5) AS radial_value_0_1 FROM s GROUP BY ALL"
)
def sentiment_year(spark, sf_dir):
    return extract.sentiment_by_year(_sentiment(spark, sf_dir))


@query()
def actors(spark, sf_dir):
    found = actor_names.actors(load(spark, sf_dir))
    return found.select("ord", "doc_key", F.array_join("actors", ", ").alias("actors"))


@query()
def actor_counts(spark, sf_dir):
    return actor_names.actor_counts(actor_names.actors(load(spark, sf_dir)))


def counted(n: int) -> str:
    return f"c{n} AS (SELECT term, {n} AS size, count(*) AS count, min(ord * 1000000000 + p) AS f FROM (SELECT ord, p, array_to_string(t[p:p + {n - 1}], ' ') AS term FROM (SELECT *, unnest(range(1, len(t) - {n - 2})) AS p FROM kept WHERE len(t) >= {n})) GROUP BY term), t{n} AS (SELECT * FROM (SELECT * FROM c{n} ORDER BY count DESC, f LIMIT 30) WHERE count >= 2)"


@query(
    f""", kept AS (SELECT ord, {KEPT} AS t FROM r), {counted(1)}, {counted(2)}, {counted(3)}, phrases AS (SELECT * FROM t3 UNION ALL SELECT * FROM t2), small AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
absorbed AS (SELECT s.term, s.count, first(p.term ORDER BY p.size DESC, p.count DESC, p.f) AS absorbed_by FROM small s JOIN phrases p ON s.size < p.size AND contains(' ' || p.term || ' ', ' ' || s.term || ' ') WHERE s.count >= 2 AND p.count / s.count::DOUBLE >= 0.8 GROUP BY ALL)
SELECT term AS node, 'trigram' AS node_type, count, '' AS absorbed_by FROM t3 UNION ALL SELECT term, 'bigram', count, '' FROM t2 UNION ALL SELECT term, 'monogram', count, '' FROM t1 WHERE term NOT IN (SELECT term FROM absorbed)
UNION ALL SELECT term, 'absorbed_ngram', count, absorbed_by FROM absorbed"""
)
def phrase_composition(spark, sf_dir):
    return terms.repeated_phrases(load(spark, sf_dir), stopwords=STOPS)


@query()
def canonical_terms(spark, sf_dir):
    rows = load(spark, sf_dir)
    chosen = [r["node"] for r in terms.repeated_phrases(rows, stopwords=STOPS).filter("node_type <> 'absorbed_ngram'").collect()]
    found = terms.canonical_terms(rows.select("ord", "text_clean", "text_normalized", "title"), sorted(set(chosen)), STOPS)
    return found.select("ord", F.array_join("terms", "|").alias("terms"))
