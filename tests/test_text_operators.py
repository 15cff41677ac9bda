"""Events, propositions, frames, sentiment, folds, terms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import actors, articles, extract, folds, infer, records, terms
from tests.test_records import make  # noqa: F401


def test_propositions(make):  # noqa: F811
    rows = make({"title": "", "status": "ok", "medium": "m", "year": 2020, "source_type": "news", "text_clean": "The new law must change because everyone fears the danger. Nunca hay alternativa a la crisis total hoy. Short."})
    got = extract.propositions(rows).orderBy("sentence_index").collect()
    assert [r.sentence_index for r in got] == [1, 2]
    a = got[0]
    assert a.speech_act == "directive" and a.speech_marker == "must" and a.has_causal_relation and a.causal_markers == "because"
    assert "appeal_to_fear" in a.fallacies and a.hidden_premise_hint.startswith("Supone una relación causal") and len(a.proposition_id) == 16
    assert 0 <= a.structural_confidence <= 1
    summary = extract.structural_summary(extract.propositions(rows)).first()
    assert summary.propositions == 2 and summary.speech_act_entropy <= 1


def test_svo(spark):
    f = lambda s: spark.range(1).select(extract.subject_verb_object(F.lit(s)).alias("x")).first()["x"].asDict()
    assert f("La gente dice cosas") == {"subject": "", "verb": "", "object": "", "svo_confidence": "low"}
    assert f("We think that people promises much") == {"subject": "We think that people", "verb": "promises", "object": "much", "svo_confidence": "medium"}
    assert f("")["verb"] == ""


def test_entropy(spark):
    rows = spark.createDataFrame([("g", x) for x in "aabbcc"] + [("g", "")] + [("h", "a")], "g string, v string")
    got = {r.g: r.e for r in extract.entropy(rows, ["g"], F.col("v"), "e").collect()}
    assert got == {"g": round(math.log2(3), 5), "h": 0.0}


def test_sentiment(make):  # noqa: F811
    rows = make({"title": "", "text_clean": "trust and respect"}, {"title": "", "text_clean": "never trust; extremely dangerous fear"}, {"title": "", "text_clean": "nothing"})
    got = extract.sentiment(rows).orderBy("ord").collect()
    assert [r.sentiment_label for r in got] == ["positive", "negative", "neutral_or_mixed"]
    assert (got[1].positive_hits, got[1].negative_hits) == (0.0, 2.5)


def test_events(make):  # noqa: F811
    stages = {"conflict": ("crisis", "dispute"), "resolution": ("agreement",)}
    rows = make({"url": "u", "title": "T", "text_clean": "A dispute over the crisis began in the northern town. A crisis is a thing that nobody here would want. They said that no one else would come to see it."})
    e = extract.narrative_events(rows, stages).first()
    assert e.conflict.startswith("A dispute") and e.conflict_markers == "crisis, dispute" and e.resolution == "" and e.narrative_completeness == 0.5


def test_actors(make, spark):  # noqa: F811
    cases = {
        "they say that Maria Lopez met the World Bank; later Maria Lopez said so": ["Maria Lopez", "World Bank"],
        "the UN-HABITAT office and Banco de la Nación with Ana Ruiz y Pedro Paz": ["Ana Ruiz", "Pedro Paz"],
        "OMS and UNAM spoke. The Group of Seven, AI": ["UNAM", "OMS", "AI"],
        "Source: Maria Lopez": ["Maria Lopez"],
        "Unknown Person, Journal Methods, Müller Straße Nord, x": [],
        "One Two Three Four Five Six Seven Eight nine": ["One Two Three Four Five Six", "Seven Eight"],
        "New-York Times-": ["New-York Times"],
        "": [],
    }
    rows = make(*({"title": "", "text_clean": t, "url": f"u{i}"} for i, t in enumerate(cases)), {"title": None, "text_clean": None, "url": "none"})
    got = {r.ord: r.actors for r in actors.actors(rows).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[len(cases)] == []
    noise = {"": True, "source: x": True, "Maria Lopez": False, "The": True, "Lopez": True, "hiv": False, "AREA METROPOLITANA Sur": True, "ABCD": True}
    table = spark.createDataFrame([(n,) for n in noise], "n string").select("n", actors.no_actor(F.col("n")).alias("x"))
    assert {r.n: r.x for r in table.collect()} == noise


def test_acronyms_and_names_of_a_text():
    assert list(actors.acronyms("The WHO, ABC-12 and AB-C-DEF; aBC X ABC-12x ÑU_X")) == ["WHO", "ABC-12", "AB-C", "DEF", "ABC"]
    assert list(actors.capitalised("(Maria Lopez) de Maria de la Cruz and of Bob Stone, Joe\nDoe & Son")) == ["Maria Lopez", "Bob Stone", "Joe Doe"]  # one small word between two at most


def clean(make, title, *lines):  # noqa: F811
    out = articles.clean(make({"title": title, "text_clean": "\n".join(lines)}).withColumnRenamed("text_clean", "raw"), "raw").first()
    return out.text_clean.split("\n\n") if out.text_clean else [], out.cleaning_notes


def test_articles(make):  # noqa: F811
    many = "and then many more words follow so that the block is long enough for it"
    assert clean(make, "A Tale - The Paper", "A Tale", f"A Tale {many}", "end") == ([many, "end"], ["removed_repeated_title_blocks:2"])
    assert clean(make, "A Tale", f"A Tale a tale {many}") == ([f"a tale {many}"], ["removed_repeated_title_blocks:1"])
    assert clean(make, "A Tale | Paper", f"A Tale A TALE News March 3, 2020 {many}")[0] == [many]
    assert clean(make, "A Tale - Paper", f"A Tale, Paper {many}")[0] == [f", Paper {many}"]
    assert clean(make, "", "A", "text of it", "text of it!") == (["text of it"], ["removed_boilerplate_blocks:1", "removed_duplicate_blocks:1"])
    assert clean(make, "t x", "one here", "two here", "three by the author", "four") == (["one here", "two here"], ["cut_author_bio_tail"])
    long = "w " * 150 + "the author wrote it"
    kept, notes = clean(make, "t x", long, "gone")
    assert notes == ["cut_author_bio_tail"] and len(kept) == 1 and kept[0] == long[: long.index("author") - 20].strip()
    assert clean(make, None) == ([], [])
    own = articles.clean(make({"title": "", "text_clean": "a b c\nour own end here\nlost"}).withColumns({"raw": F.col("text_clean"), "marks": F.array(F.lit("own end"))}), "raw", "marks").first()
    assert own.text_clean == "a b c" and own.cleaning_notes == ["cut_after_related_content"]
    assert articles.clean(make().withColumn("raw", F.col("text_clean")), "raw").count() == 0


def test_limits_can_be_lifted(make):  # noqa: F811
    text = " ".join(f"This is the sentence number {i} of a very long text." for i in range(200))
    rows = make({"title": "t", "text_clean": text + " The zzmark stands at the very end of it.", "text_normalized": text + " The zzmark stands at the very end of it.", "url": "u"})
    assert extract.propositions(rows).count() == 40 and extract.propositions(rows, most=None).count() >= 200
    assert extract.argument_frames(rows, None, {"p": ("zzmark",)}).first().p != "" and extract.argument_frames(rows, parts={"p": ("zzmark",)}).first().p == ""
    assert extract.narrative_events(rows, {"s": ("199",)}, None).first().s != "" and extract.narrative_events(rows, {"s": ("199",)}).first().s == ""
    assert records.exclude(rows, ["zzmark"], []).first().exclusion_reason == "" and records.exclude(rows, ["zzmark"], [], None).first().exclusion_reason != ""
    near = [rows.select(records.localization(("zzmark",), (), n).alias("x")).first().x.mexico_score for n in (5000, None)]
    assert near == [0, 1]


def test_declared_places(make):  # noqa: F811
    rows = make({"title": "t"}).withColumn("geographic_terms", F.array(F.lit("Mexico")))
    got = records.enrich(rows).first()
    assert (got.mexico_score, got.localization) == (2, "Mexico-mentioned") and "declared_mexico_scope" in got.localization_evidence


def test_dates(spark):
    cases = {"20200102T": 2020, "Tue, 31 Dec 2019 23:30:00 -0100": 2020, "Tue, 31 Dec 2019 23:30:00 GMT": 2019, "no date": 7, "": 7, None: 7}
    table = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r.d: r.y for r in table.select("d", infer.year([F.col("d")], F.lit(7)).alias("y")).collect()} == cases
    seeds = {"03/02/2021": "2021-02-03", "2021-2-3": "2021-02-03", "20210203": "2021-02-03", "2021/02/03": "2021-02-03", "Wed, 3 Feb 2021 10:00:00 +0000": "2021-02-03", "31/02/2021": None, "x": None}
    got = spark.createDataFrame([(k,) for k in seeds], "d string").select("d", infer.seed_date(F.col("d")).cast("string").alias("s")).collect()
    assert {r.d: r.s for r in got} == seeds
    titles = {"https://a.b/x/my-long_title/": "my long title", "https://a.b": "https://a.b", "": ""}
    got = spark.createDataFrame([(k,) for k in titles], "u string").select("u", infer.title_from_url(F.col("u")).alias("t")).collect()
    assert {r.u: r.t for r in got} == titles


def echoes(frames, threshold):
    kept, out = [], []
    for f in sorted(frames, key=lambda f: f[0]):
        best, sim = None, 0.0
        for k in kept:
            a, b = set(f[2].split()), set(k[2].split())
            s = 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0
            if s > sim:
                best, sim = k, s
        if best and sim >= threshold:
            out.append((f[0], best[1], round(sim, 5)))
        else:
            kept.append(f)
            out.append((f[0], "", round(sim, 5)))
    return out


def test_echoes_equal_the_sequential_rule(spark):
    dice = random.Random(8)
    base = [[f"tok{dice.randint(0, 40)}" for _ in range(20)] for _ in range(8)]
    frames = []
    for i in range(80):
        own = list(dice.choice(base))
        for _ in range(dice.randint(0, 3)):
            own[dice.randrange(20)] = f"tok{dice.randint(0, 40)}"
        frames.append((i * 3, f"f{i}", " ".join(own) if i % 13 else ""))
    rows = spark.createDataFrame(frames, "ord long, frame_id string, frame_terms string")
    for threshold in (0.7, 0.9):
        got = folds.echo_frames(rows, threshold).orderBy("ord").collect()
        assert [(r.ord, r.echo_of_frame_id, r.echo_similarity) for r in got] == echoes(frames, threshold)
        assert got[0].relation_type == "ORIGEN_DE_MARCO"


def test_similar_sets_against_all_pairs(spark, monkeypatch):
    """Large groups of equal sets, near ones, single tokens and empty sets; what is shuffled doesn't grow with the square of a group."""
    monkeypatch.setattr(folds, "CHUNK", 7)
    dice = random.Random(4)
    sets = {k: {f"w{j}" for j in range(30)} for k in range(40)}
    for k in range(40, 160):
        sets[k] = {f"w{int(dice.paretovariate(0.7))}" for _ in range(dice.randint(0, 12))}
        if k % 3 == 0:
            sets[k] = sets[dice.randrange(k)] ^ {f"w{dice.randrange(30)}"}
    rows = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")
    made, classes = [], folds.similar_classes
    monkeypatch.setattr(folds, "similar_classes", lambda s, t: made.append(s) or classes(s, t))
    for threshold in (0.5, 0.8, 1.0):
        got = {(r.i, r.j): r.similarity for r in folds.similar_sets(rows, threshold).collect()}
        assert got == {(i, j): s for j, b in sets.items() for i, a in sets.items() if i < j and a and b and (s := len(a & b) / len(a | b)) >= threshold}
    assert made[0].count() == len({frozenset(v) for v in sets.values() if v}) < len(sets) - 40 + 1


def test_closest_earlier_set_in_blocks(spark, monkeypatch):
    """Blocks of few ids meet each other in groups of their own."""
    monkeypatch.setattr(folds, "BLOCK", 40)
    test_closest_earlier_set_against_all_pairs(spark)


def test_closest_earlier_set_against_all_pairs(spark):
    """Tokens that are everywhere, rare ones, sets of all sizes and of one token, none alike."""
    dice = random.Random(3)
    sets = {}
    for i in range(150):
        own = {f"hot{k}" for k in range(dice.randint(0, 4))} | {f"w{int(dice.paretovariate(0.6))}" for _ in range(dice.randint(0, 30))}
        sets[i * 7 % 1009] = own or {f"only{i}"}
    sets[5000] = {"never"}
    got = {r.id: r.similarity for r in folds.closest_earlier(spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")).collect()}
    assert got.keys() == sets.keys()
    for k, v in sets.items():
        assert abs(got[k] - max((len(v & w) / len(v | w) for j, w in sets.items() if j < k), default=0.0)) < 1e-9
    assert folds.closest_earlier(spark.createDataFrame([], "id long, tokens array<string>")).count() == 0


def test_deltas_return_to_an_earlier_state(spark):
    rows = [("m", 2020 + i, f"f{i}", p, "", "", "", p) for i, p in enumerate(["alpha beta", "alpha beta", "gamma delta", "alpha beta"])] + [("n", 2020, "g", "", "", "", "", "")]
    got = folds.frame_deltas(spark.createDataFrame(rows, "medium string, year int, frame_id string, problem string, culprit string, solution string, urgency string, frame_terms string"))
    got = sorted((r.medium, r.year, r.delta_type, r.previous_frame_id, r.changed_fields) for r in got.collect())
    assert [g[2] for g in got] == ["baseline", "stable_repetition", "change", "change", "baseline"] and got[3][3] == "f2" and got[2][4] == "problem"


def test_frames_and_silence(make):  # noqa: F811
    rows = make({"title": "", "medium": "a", "text_clean": "There is a big problem in this town now. The proposal should resolve most of it soon."}, {"title": "", "medium": "b", "text_clean": "x"})
    frames = extract.argument_frames(rows)
    f = frames.orderBy("ord").first()
    assert f.problem.startswith("There is") and f.solution.startswith("The proposal") and 0 < f.frame_density <= 1
    got = {r.expected_topic: r.alert for r in extract.silence_alerts(frames, ["Problem", "water"], 0.7).collect()}
    assert got == {"problem": False, "water": True}


def test_phrases_and_canonical_terms(make):  # noqa: F811
    rows = make(*[{"text_clean": "pair programming tools help pair programming tools"} for _ in range(3)])
    found = {(r.node, r.node_type): r for r in terms.repeated_phrases(rows).collect()}
    assert found["pair programming tools", "trigram"]["count"] == 6
    assert found["pair programming", "absorbed_ngram"].absorbed_by == "pair programming tools" and ("pair programming", "bigram") in found
    assert ("pair", "monogram") not in found
    assert terms.canonical_run("a b c a b d".split(), frozenset(["a b", "a b c", "d"])) == ["a b c", "a b", "d"]
    got = terms.canonical_terms(rows, ["pair programming tools", "help"]).first().terms
    assert got == ["pair programming tools", "help", "pair programming tools"]


def test_top_terms_ties_are_first_seen(make):  # noqa: F811
    rows = make({"text_clean": "bbb aaa ccc"}, {"text_clean": "ccc ddd"})
    assert [r.term for r in terms.top_terms(rows, 1, 3).collect()] == ["ccc", "bbb", "aaa"]
    assert sum(r["count"] for r in terms.term_counts(rows, 2).collect()) == 3


@pytest.mark.parametrize("by", [(), ("year",)])
def test_group_counts(make, by):  # noqa: F811
    rows = make({"year": 2020, "text_clean": "risk and more risk"}, {"year": 2020, "text_clean": "none"})
    r = terms.group_counts(rows, {"g": ("risk", "more"), "h": ("zzz",)}, list(by)).orderBy("group").collect()
    assert (r[0].keyword_hits, r[0].documents_with_group, r[0].document_share, r[0].top_terms) == (3, 1, 0.5, "risk, more") and r[1].top_terms == ""
