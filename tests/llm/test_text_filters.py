"""Language, quality, URLs and personal data."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import zstandard
from skein.llm import language_id, pii, quality, queries, url_filter
from skein.llm.common import read


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_language_held_out_accuracy(spark, sf):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = rows(queries.op1_language_id(spark, "/root/testdata/sf0.01"))
    held = [r for r in found if r["held_out"]]
    assert len(found) == 1000 and all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_odd_rows(spark, docs_of, odd):
    model = language_id.LanguageModel({"en": b"the cat sat on the mat and the dog " * 50, "xx": b"zq vk wj " * 200})
    found = rows(language_id.identify_languages(docs_of([*odd, (20, "123 456"), (21, "the dog and the cat")]), model))
    assert len(found) == len(odd) + 2
    by = {r["doc_id"]: r for r in found}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 20)] == ["und"] * 4 and by[1]["score"] == 0
    assert by[21]["lang_pred"] == "en" and by[9]["lang_pred"] in {"en", "xx"}
    assert language_id.identify_languages(docs_of([]), model).count() == 0
    untrained = rows(language_id.identify_languages(docs_of([(1, "words")])))
    assert untrained[0]["lang_pred"] in {"und", "en"}


def test_language_training_skips_folds_and_nulls(docs_of):
    held = next(i for i in range(50) if crc32(str(i).encode()) % 3 == 1)
    own = next(i for i in range(50) if crc32(str(i).encode()) % 3 != 1)
    model = language_id.train(docs_of([(held, "held out words", "no", "s"), (own, "training words", "yes", "s"), (own, None, "yes", "s"), (own, "w", None, "s"), (None, "w", "none", "s")]))
    assert list(model.dictionaries) == ["yes"]
    assert language_id.train(docs_of([])).dictionaries == {}


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect()}
    held = [r for r in rows(queries.op3_quality(spark, sf)) if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 100 and sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.97


def test_quality_odd_rows(spark, docs_of, odd):
    model = quality.fit([quality.features("good words in order")] * 5 + [quality.features("BAD!! BAD!! BAD!!")] * 5, [1] * 5 + [0] * 5)
    found = rows(quality.score_quality(docs_of(odd), model))
    assert len(found) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert model.score("good words in order") > 0.5 > model.score("BAD!! BAD!! BAD!!")
    empty = {r["score"] for r in found if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in rows(quality.score_quality(docs_of(odd), quality.train(docs_of(odd), labels)))} == {0.5}
    assert quality.keep_good(docs_of([(1, "good words"), (2, "BAD!! BAD!! BAD!!")]), model).columns == docs_of([]).columns


def test_language_classify_against_the_definition():
    """Sizes by a compressor made anew for each text and dictionary."""
    dice = random.Random(2)
    dictionaries = {k: " ".join("".join(dice.choice(letters) for _ in range(5)) for _ in range(400)).encode() for k, letters in (("aa", "abcde"), ("bb", "defgh"), ("cc", "ghijk"))}
    model = language_id.LanguageModel(dictionaries)
    for _ in range(200):
        text = " ".join("".join(dice.choice("abcdefghijk") for _ in range(5)) for _ in range(dice.randint(1, 40)))
        sizes = {}
        for lang, content in dictionaries.items():
            how = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, min_match=language_id.MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
            own = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes[lang] = len(own.compress(text.encode()))
        best, second = sorted(sizes.values())[:2]
        lang, score, margin, accepted = model.classify(text)
        assert lang == min(sizes, key=lambda k: (sizes[k], k)) and margin == (second - best) / second and accepted == (margin >= language_id.MARGIN)
        assert abs(score - 1 / sum(2.0 ** (best - s) for s in sizes.values())) < 1e-12


def test_language_sample_gives_all_documents_to_the_dictionary(docs_of, spark):
    own = [i for i in range(400) if crc32(str(i).encode()) % 3 != 1][:150]
    table = [(i, f"start{i:04d} " * 200, "yes", "s") for i in own] + [(own[0], "again " * 9, "few", "s")] * 500
    model = language_id.train(docs_of(table), sample_docs=60, stretch=40)
    parts = model.dictionaries["yes"].split(b"\n")
    assert len(parts) == 60 and len({re.search(rb"start(\d{4})", p)[1] for p in parts}) == 60 and all(len(p) == 40 for p in parts)
    assert list(model.dictionaries) == ["few", "yes"]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sample", "")
    language_id.train(docs_of(table).repartition(40), sample_docs=60)
    assert len(jobs.getJobIdsForGroup("sample")) < 12  # not one for each partition
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def plain_features(text):
    """Feature names, without hashing, word by word."""
    words, out = (text or "").split(), Counter()
    for w in words:
        marked = f"<{w}>"
        out.update([("word", marked), *((n, marked[i : i + n]) for n in (3, 4) for i in range(len(marked) - n + 1))])
    out.update(("pair", a, b) for a, b in zip(words, words[1:], strict=False))
    out["equal"] += sum(a == b for a, b in zip(words, words[1:], strict=False))
    return out


def test_quality_features_against_plain_ones(odd, monkeypatch):
    """Each name has one bucket, and a text the buckets of its names, however it is cut."""
    texts = [t for _, t in odd] + ["a a b", "  x\u00a0y\tz ", "\ud800 broken", "ñ ñ ñ", "one"]
    bucket_of = {"equal": quality.EQUAL}
    for t in ["a", "b", "a a", *texts]:
        for name in plain_features(t):
            if name[0] == "word":
                bucket_of[name] = int(np.concatenate([b for b, _ in quality.hashed_features([name[1][1:-1]])][:1])[0])
    for size in (1 << 18, 50):
        monkeypatch.setattr(quality, "AT_ONCE", size)
        got = [Counter() for _ in texts]
        for buckets, of in quality.hashed_features(texts):
            for b, i in zip(buckets.tolist(), of.tolist(), strict=True):
                got[i][b] += 1
        for t, g in zip(texts, got, strict=True):
            names = plain_features(t)
            assert sum(g.values()) == sum(names.values())
            for name, n in names.items():
                assert g[bucket_of[name]] >= n if name in bucket_of else True
            at, counts = quality.features(t)
            assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == dict(g)


def test_quality_gradient_and_scores(monkeypatch):
    """Against finite differences, and a forward pass by the softmax itself."""
    dice = np.random.default_rng(1)
    vectors, out, bias = dice.normal(size=(50, 4)), dice.normal(size=(2, 4)), dice.normal(size=2)
    at, counts = np.array([3, 7, 20]), np.array([1, 4, 2])

    def loss():
        hidden = (vectors[at] * counts[:, None]).sum(axis=0) / counts.sum()
        odds = out @ hidden + bias
        return np.log(np.exp(odds).sum()) - odds[1]

    _, d_vectors, d_out, d_bias = quality.gradient(vectors, out, bias, at, counts, 1)
    for values, found in ((vectors, {(i, j): d_vectors[k, j] for k, i in enumerate(at) for j in range(4)}), (out, dict(np.ndenumerate(d_out))), (bias, dict(np.ndenumerate(d_bias)))):
        for where, d in found.items():
            old = values[where]
            values[where] = old + 1e-6
            up = loss()
            values[where] = old - 1e-6
            down = loss()
            values[where] = old
            assert abs((up - down) / 2e-6 - d) < 1e-6
    model = quality.QualityModel(dice.normal(size=quality.BUCKETS), 0.3)
    texts = ["a b c", None, "", "long words " * 500, "x x"]
    for t, s in zip(texts, model.scores(texts), strict=True):
        at, counts = quality.features(t)
        mean = (model.gain[at] * counts).sum() / counts.sum() if len(at) else 0.0
        assert abs(s - 1 / (1 + math.exp(-mean - 0.3))) < 1e-9


def test_quality_training_reads_whole_texts_and_bounded_rows(spark, docs_of):
    own = [i for i in range(80) if crc32(str(i).encode()) % 3 != 1]
    texts = [(i, "plain " * 5000 + ("good" if k % 2 else "BAD!!")) for k, i in enumerate(own)]
    labels = spark.createDataFrame([(i, k % 2, 0, "t") for k, i in enumerate(own)], "doc_id long, quality int, toxic int, text string")
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda bags, wanted, **k: seen.append((bags, wanted)) or fit(bags, wanted, **k)
        quality.train(docs_of([*texts, *[texts[0]] * 50]), labels, 20)
    finally:
        quality.fit = fit
    bags, wanted = seen[0]
    assert len(bags) == len(wanted) == 20
    ends = [set(quality.features(w)[0].tolist()) for w in ("BAD!!", "good")]
    assert all(ends[y] <= set(at.tolist()) for (at, _), y in zip(bags, wanted, strict=True))


def test_url_filter(spark):
    bad = spark.createDataFrame(
        [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Casino-win.Example.org/fr/1"), (4, "http://a.example.com/en/72?x#y"), (5, "http://a.example.com/en/8"), (6, "http://casinos.org/"), (7, "http://free-bets.org/x"),
         (8, "http://ads-track.org/x"), (9, "http://free.org/free"), (10, "http://b.example.net/de/81"), (11, "http://de.net/de/1"), (11, "http://de.net/de/1"), (12, "x://" + "a" * 100_000)],
        "page_id long, url string",
    )
    got = {r["page_id"]: r for r in rows(url_filter.filter_urls(bad.selectExpr("*", "'z' AS host", "1 AS verdict")))}
    assert url_filter.filter_urls(bad).count() == 13
    assert (got[1]["host"], got[1]["path"], got[1]["verdict"], got[2]["host"]) == ("", "", "allow", "")
    assert got[3]["host"] == "www.casino-win.example.org" and got[3]["verdict"] == "block" and got[3]["rule"] is None
    assert (got[4]["rule"], got[4]["verdict"], got[5]["rule"], got[5]["verdict"]) == ("example.com/en/7", "allow", "com/en/", "block")
    assert got[6]["verdict"] == "allow" and got[7]["verdict"] == "block" and got[8]["verdict"] == "block" and got[9]["verdict"] == "allow"
    assert got[10]["rule"] == "example.net/de/8" and got[11]["rule"] == "net/de/"
    assert url_filter.filter_urls(bad.limit(0)).count() == 0


def test_url_rules_are_those_of_the_contract():
    """Each rule's word, on addresses that no other rule and no term decides otherwise."""
    assert set(url_filter.RULES) == {("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")}
    how = url_filter.UrlFilter()
    wanted = {"a.com/en/1": "block", "example.com/en/71": "allow", "a.net/de/casino": "allow", "x.example.net/de/1": "allow", "example.net/de/81": "block", "a.org/es/": "block", "a.org/fr/": "allow"}
    assert {u: how.judge(f"http://{u}")[3] for u in wanted} == wanted
    assert "('allow', 'net', '/de/')" in url_filter.oracle()


def test_url_weights(spark):
    """Against sums over split words, for weights other than 1; and a vocabulary from a table."""
    terms = spark.createDataFrame([("Bad", None), ("bad", 1.0), ("two", 2.0), ("half", 0.5), ("half", 0.25), ("one", 1.0), ("", 9.0), (None, 9.0)], "term string, weight double")
    how = url_filter.UrlFilter.of_vocabulary(terms, soft_bound=2.5, rules=())
    assert list(how.strict) == ["bad"] and dict(how.soft) == {"two": 2.0, "half": 0.5, "one": 1.0}
    with pytest.raises(ValueError):
        url_filter.UrlFilter.of_vocabulary(terms, most=2)
    dice = random.Random(8)
    for judge, strict, soft, bound in ((how, {"bad"}, dict(how.soft), 2.5), (url_filter.UrlFilter(rules=()), set(url_filter.STRICT), url_filter.SOFT, url_filter.SOFT_BOUND)):
        for _ in range(500):
            words = [dice.choice([*strict, *soft, "plain", "twofold"]) for _ in range(dice.randint(0, 3))]
            url = "http://h.test/" + dice.choice("-/_.").join(words)
            found = set(re.findall("[a-z0-9]+", url))
            want = "block" if found & strict or sum(w for t, w in soft.items() if t in found) >= bound else "allow"
            assert judge.judge(url)[3] == want, url
    assert max(url_filter.SOFT.values()) < url_filter.SOFT_BOUND


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        out += [("card", m.start(), m.end())] * (16 <= len(d) <= 19 and luhn(d))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def test_plain_spans_equal_the_expressions():
    dice = random.Random(3)
    for _ in range(5000):
        t = "".join(dice.choice(["a", "1", "0", ".", "@", "+", "-", " ", "(", ")", "25", "4111 1111 1111 1111", "é"]) for _ in range(dice.randint(0, 40)))
        assert pii.plain_spans(t) == brute(t), t


def test_disguised_spans_map_back():
    cases = {
        "mail john.doe (at) example (dot) com now": ("email", "john.doe (at) example (dot) com"),
        "write jane at example dot org": ("email", "jane at example dot org"),
        "jоhn@exаmple.com": ("email", "jоhn@exаmple.com"),
        "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ": ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        "call plus one six one nine five five five one two three four": ("phone", "plus one six one nine five five five one two three four"),
        "192 dot 168 dot 1 dot 20": ("ip", "192 dot 168 dot 1 dot 20"),
        "a\u200bb@x\u200b.org": ("email", "a\u200bb@x\u200b.org"),
    }
    for text, (kind, span) in cases.items():
        assert [(k, text[s:e], d) for k, s, e, d in pii.find_spans(text)] == [(kind, span, True)], text
    for clean in ("meet at example.com", "one two three", "at the dot", "is here at noon dot"):
        assert pii.find_spans(clean) == []


def test_pii_odd_rows(docs_of, odd):
    found = rows(pii.digest_spans(pii.find_pii(docs_of([*odd, (30, "a@b.cd 1.2.3.4"), (31, "1" * 60_000), (32, "a" * 60_000 + "@"), (33, "+1" + " " * 60_000)]))))
    assert len(found) == len(odd) + 4
    by = {r["doc_id"]: r for r in found}
    assert by[30]["spans"] == "email:0:6,ip:7:14" and (by[30]["n_email"], by[30]["n_ip"], by[30]["n_card"]) == (1, 1, 0)
    assert by[1]["spans"] == "" and by[1]["base_sha256"] == by[2]["base_sha256"]
    assert pii.find_pii(docs_of([])).count() == 0
