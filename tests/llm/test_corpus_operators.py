"""Deduplication, decontamination, language model, mixing: against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import bitslice, decontaminate, exact_dedup, hashes, language_model, mixing, simhash, substring_dedup
from skein.llm import components as components_of
from skein.llm.components import components

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def made():
    """Texts with copies, near copies and shared passages."""
    dice = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [dice.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(60):
        own = [dice.choice(vocabulary) for _ in range(dice.randint(0, 120))]
        if i % 4 == 0:
            at = dice.randint(0, len(own))
            a = dice.randint(0, 30)
            own[at:at] = passage[a : a + dice.randint(10, 30)]
        out.append((i, " ".join(own)))
    out += [(100 + i, out[i][1]) for i in range(0, 40, 5)]
    out += [(200 + i, out[i][1] + "  ") for i in range(0, 40, 8)]
    out += [(300 + i, " ".join(words(out[i][1])[:-1] + ["changed"])) for i in range(1, 40, 6)]
    return out


def test_exact_dedup(docs_of, odd, made):
    for digest in (exact_dedup.sha256, lambda c: F.lit("one for all").cast("binary"), lambda c: F.substring(F.md5(c), 1, 1).cast("binary")):
        table = [*made, *[r for r in odd if r[0] is not None]]
        found = rows(exact_dedup.exact_dedup(docs_of(table), digest, salts=3))
        groups = defaultdict(list)
        for d, t in table:
            groups[SPACE.sub("", t or "")].append((-len(t or ""), d))
        want = sorted((d, min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, d in g)
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)


def test_exact_dedup_odd(docs_of, odd):
    found = rows(exact_dedup.exact_dedup(docs_of(odd)))
    assert len(found) == len(odd)
    nulls = [r for r in found if r["doc_id"] is None]
    assert sorted(r["keep_id"] for r in nulls) == [3, 6]  # white space is longer than no text
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0
    kept = exact_dedup.drop_copies(docs_of(odd))
    assert kept.columns == docs_of([]).columns and sorted(r["doc_id"] for r in rows(kept)) == [3, 4, 5, 6, 8, 9]


def test_one_row_of_each_text(docs_of):
    """Against brute force, with digests that tell texts apart and ones that don't."""
    dice = random.Random(4)
    table = [(dice.choice([None, 1, 2, 3, 4]), dice.choice(["a b", "ab", "a  b", "c", " c", "", None, "d d"])) for _ in range(60)]
    for digest in (exact_dedup.sha256, lambda c: F.lit("one").cast("binary"), lambda c: F.substring(F.md5(c), 1, 1).cast("binary")):
        for part in (table, table[:7], [(7, "alpha"), (3, "beta"), (7, "beta"), (9, "gamma"), (9, "gamma")]):
            best = {}
            for d, t in part:
                own = (-len(t or ""), d is None, d or 0)
                bare = SPACE.sub("", t or "")
                best[bare] = min(best.get(bare, own), own)
            found = exact_dedup.drop_copies(docs_of(part), digest, salts=3)
            assert found.columns == docs_of([]).columns
            assert sorted((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0) for r in rows(found)) == sorted(best.values())
            assert all(r["x_id"] == "x" and r["first"] == 7 for r in rows(found))


def test_hot_text_meets_its_group_in_salts(docs_of, spark):
    """A text that is most rows isn't one partition of the last join, with adaptive execution off."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exact_dedup.exact_dedup(docs_of([(i, "hot" if i % 10 else f"t{i}") for i in range(4000)]))
        sizes = [r["n"] for r in rows(found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_pieces_keep_buckets_small():
    assert [simhash.pieces_for(n) for n in (0, 10**6, 10**8, 10**10)] == [6, 6, 7, 8]


def test_mixing_keeps_columns(docs_of):
    table = [(i, f"w{i} " * (i % 5), "en", "ab"[i % 2]) for i in range(50)] + [(None, None, "en", None)]
    plain = rows(mixing.mix_sources(docs_of(table), slice_rows=8))
    kept = rows(mixing.mix_sources(docs_of(table), slice_rows=8, keep=["text", "x_id"]))
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    assert [r | {"text": dict((t[0], t[1]) for t in table)[r["doc_id"]], "x_id": "x"} for r in sorted(plain, key=order)] == sorted(kept, key=order)


def test_mixing(docs_of, odd):
    dice = random.Random(1)
    table = [(i, " ".join(["w"] * dice.randint(0, 30)), "en", dice.choice(["a", "b", "c", "é", None])) for i in range(300)] + [(r[0], r[1], "en", "big") for r in odd]
    found = rows(mixing.mix_sources(docs_of(table), slice_rows=16))
    assert len(found) == len(table)
    sizes = Counter()
    for _, t, _, s in table:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    left, targets = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}
    total = 1.5 * sum(sizes.values())
    while left:
        level = total / sum(left.values())
        over = {s for s, w in left.items() if level * w > 2 * sizes[s]}
        for s in over or left:
            targets[s] = 2.0 * sizes[s] if over else level * left[s]
        if not over:
            break
        total -= sum(targets[s] for s in over)
        left = {s: w for s, w in left.items() if s not in over}
    taken, by_size = Counter(), defaultdict(set)
    for r in found:
        taken[r["source_size"]] += r["taken"]
        by_size[r["source_size"]].add(r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s, n in sizes.items():
        assert any(abs(t - targets[s]) < 1e-6 * max(1, t) for t in by_size[n])
        if list(sizes.values()).count(n) == 1:
            assert taken[n] == math.floor(targets[s] + 1e-9)
    again = rows(mixing.mix_sources(docs_of(table), slice_rows=1000))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(found, key=key) == sorted(again, key=key)
    assert mixing.mix_sources(docs_of([])).count() == 0
    assert {r["taken"] for r in rows(mixing.mix_sources(docs_of([(1, None), (2, " ")])))} == {0}


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(table, items):
    out = {}
    for d, t in table:
        w = TOKEN.findall(low(t))
        hit, those = set(), set()
        for item, text in items:
            b = TOKEN.findall(low(text))
            m = min(10, len(b))
            windows = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
            for i in range(len(w) - m + 1):
                if m and tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    those.add(item)
        out[d] = (len(w), len(hit), len(those), decontaminate.sha_of(list(those)))
    return out


def test_decontaminate(spark, docs_of, made):
    passage = words(made[0][1])
    items = [(1, " ".join(passage)), (2, made[4][1].upper()), (3, "w1 w2"), (4, ""), (5, None), (6, "w7"), (11, " ".join(words(made[8][1])[3:16])), (11, " ".join(words(made[8][1])[3:16])), (12, "ñ w5 w6")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = [*made, (900, None), (901, ""), (902, "a-b w1, W2! " + "w7 " * 40), (903, " ".join(passage[:12]))]
    want = contaminated(table, items)
    for size in (300_000, 60):
        found = rows(decontaminate.digest_contamination(decontaminate.find_contamination(docs_of(table), bench, size)))
        assert len(found) == len(table)
        for r in found:
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == want[r["doc_id"]], r
            assert r["contaminated"] == (r["n_hit"] > 0)
        kept = rows(decontaminate.drop_contaminated(docs_of(table), bench, size))
        assert sorted(r["doc_id"] for r in kept) == sorted(d for d, v in want.items() if not v[1])


def test_decontaminate_odd(spark, docs_of, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in rows(decontaminate.digest_contamination(decontaminate.find_contamination(docs_of(odd), none)))} == {0}
    bench = spark.createDataFrame([(None, odd[3][1]), (2, "same text here")], "item_id long, text string")
    for words_of_an_index in (decontaminate.INDEX_WORDS, 1):
        found = rows(decontaminate.digest_contamination(decontaminate.find_contamination(docs_of(odd), bench, words_of_an_index)))
        assert len(found) == len(odd)
        by = {r["doc_id"]: r for r in found}
        assert by[4]["n_hit"] == 30_000 and by[4]["n_items"] == 0 and by[6]["n_items"] == 1 and by[1]["n_words"] == 0
        assert sorted((r["n_hit"] for r in found if r["doc_id"] in (None, 7))) == [0, 3, 3, 3]
        assert decontaminate.find_contamination(docs_of([]), bench, words_of_an_index).count() == 0
        kept = decontaminate.drop_contaminated(docs_of(odd), bench, words_of_an_index)
        assert kept.columns == docs_of([]).columns and sorted(str(r["doc_id"]) for r in rows(kept)) == ["1", "2", "3", "8", "9", "None"]


def test_winnowing_keeps_a_hash_of_every_window():
    dice = np.random.default_rng(0)
    for _ in range(200):
        h = dice.integers(0, 20, dice.integers(0, 40)).astype(np.uint64)
        kept = set(decontaminate.winnowed(h, 6).tolist())
        for i in range(len(h) - 5):
            assert any(p in kept and h[p] == h[i : i + 6].min() for p in range(i, i + 6))


def test_cover_brings_any_two_positions_together():
    for a in range(substring_dedup.PERIOD):
        for b in range(substring_dedup.PERIOD):
            assert any((a + s) % substring_dedup.PERIOD in substring_dedup.COVER and (b + s) % substring_dedup.PERIOD in substring_dedup.COVER for s in range(substring_dedup.PERIOD))


def kept_words(table):
    least = {}
    for d, t in table:
        w = words(t)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            if d is not None:
                least[k] = min(d, least.get(k, d))
    out = []
    for d, t in table:
        w = words(t)
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        out.append((d, len(w), len(gone), substring_dedup.sha_of([x for i, x in enumerate(w) if i not in gone])))
    return out


@pytest.mark.parametrize("gather", [1 << 21, 300])
def test_substring_dedup(docs_of, made, odd, gather, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GATHER", gather)
    table = [*made, *[(d + 1000 if d is not None else d, t) for d, t in odd], (-5, made[0][1]), (2000, "r " * 200), (2001, "r " * 30)]
    found = rows(substring_dedup.digest(substring_dedup.substring_dedup(docs_of(table))))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=key) == sorted(kept_words(table), key=key)
    assert any(r["n_removed"] for r in found)
    assert substring_dedup.substring_dedup(docs_of([])).count() == 0


def test_hashes_agree_with_spark(spark):
    values = [0, 1, -1, 5, 1 << 40, -(1 << 62), (1 << 63) - 1]
    there = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64("v")).collect()]
    assert hashes.xxhash64_of_longs(np.array(values, np.int64)).view(np.int64).tolist() == there
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64))
    assert np.array_equal(hashes.unpacked(hashes.packed(v, True), True), v) and len(hashes.unpacked(hashes.packed(v[:0]))) == 0


def test_bit_slices_find_all_links():
    dice = np.random.default_rng(0)
    for _ in range(25):
        n, r = int(dice.integers(2, 400)), int(dice.integers(0, 8))
        keys = np.sort(dice.integers(0, dice.integers(1, 30), n))
        prints = dice.integers(0, 1 << 63, 5, dtype=np.uint64)[dice.integers(0, 5, n)]
        for _ in range(3):
            prints = prints ^ (np.uint64(1) << dice.integers(0, 64, n).astype(np.uint64))
        i, j = bitslice.spanning_links(keys, prints, r, blocks=64)
        a, b = np.nonzero((keys[:, None] == keys) & (np.bitwise_count(prints[:, None] ^ prints) <= r))
        mine, all_of = bitslice.Forest(n), bitslice.Forest(n)
        mine.join(i, j)
        all_of.join(a, b)
        assert (np.bitwise_count(prints[i] ^ prints[j]) <= r).all() and np.array_equal(mine.root, all_of.root)


def near(table):
    prints = []
    for _, t in table:
        w = words(low(t))
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    n = len(table)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: table[k][0])] = min(a, b, key=lambda k: table[k][0])
    return {(table[i][0], f"{prints[i]:016x}", table[find(i)][0]) for i in range(n)}


@pytest.mark.parametrize("block_rows", [8192, 3])
def test_simhash(docs_of, made, odd, block_rows):
    table = [*made, *[(d + 1000, t) for d, t in odd if d is not None and len(t or "") < 1000]]
    found = rows(simhash.near_duplicates(docs_of(table), block_rows=block_rows))
    assert len(found) == len(table)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found} == near(table)


def test_simhash_odd(docs_of, odd):
    found = rows(simhash.near_duplicates(docs_of(odd)))
    assert len(found) == len(odd)
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16 and by[3]["component_id"] == 1
    assert sorted(r["component_id"] for r in found if r["doc_id"] is None) == [1, 6]
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_components(spark):
    dice = random.Random(2)
    links = [(dice.randint(0, 200), dice.randint(0, 200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(links, "a long, b long").repartition(4))
    assert {(r["node"], r["component"]) for r in rows(found)} == {(x, find(x)) for x in list(root)}


@pytest.mark.parametrize("few", [4, 64])
def test_components_of_more_links_than_a_task_takes(spark, monkeypatch, few):
    """A long path, a star, a tree and small groups, whose links lie in any partition."""
    monkeypatch.setattr(components_of, "FEW", few)
    links = [(i, i + 1) for i in range(100)] + [(500 + i, 500) for i in range(1, 150)] + [(2000 + i, 2000 + i // 2) for i in range(1, 120)] + [(3000 + 3 * i, 3001 + 3 * i) for i in range(90)]
    random.Random(5).shuffle(links)
    want = {(i, 0) for i in range(101)} | {(500 + i, 500) for i in range(150)} | {(2000 + i, 2000) for i in range(120)} | {(3000 + 3 * i + k, 3000 + 3 * i) for i in range(90) for k in (0, 1)}
    found = rows(components(spark.createDataFrame(links, "a long, b long").repartition(7)))
    assert len(found) == len(want) and {(r["node"], r["component"]) for r in found} == want


def test_a_group_that_all_partitions_found_takes_few_jobs(spark):
    """Every step over its links is tasks and shuffle files of each partition: it took 16 jobs."""
    links = spark.range(0, 32 * 300, 1, 32).selectExpr("id % 300 + 1 AS a", "id % 300 DIV 150 AS b").unionByName(spark.sql("SELECT 1L AS a, 0L AS b"))
    sc = spark.sparkContext
    sc.setJobGroup("large group", "")
    try:
        found = rows(components(links))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 301 and {(r["node"], r["component"]) for r in found} == {(i, 0) for i in range(301)}
    assert len(sc.statusTracker().getJobIdsForGroup("large group")) <= 8


def test_language_model(docs_of, made, odd):
    table = [*made, *[(d + 1000, t) for d, t in odd if d is not None and d != 7]]
    found = {r["doc_id"]: r for r in rows(language_model.score_corpus(docs_of(table)))}
    tokens = {d: words(low(t)) + ["</s>"] for d, t in table}
    c, pairs = Counter(), Counter()
    for d, w in tokens.items():
        if crc32(str(d).encode()) % 10:
            c.update(w)
            pairs.update(zip(["<s>", *w], w, strict=False))
    total, types = sum(c.values()), len(c)

    def discounts(values):
        return language_model.discounts([sum(v == k for v in values) for k in (1, 2, 3, 4)])

    before = Counter(b for _, b in pairs)
    d2, d1 = discounts(pairs.values()), discounts(before.values())
    cut = lambda n, d: 0 if not n else d[min(n, 3) - 1]
    spare = sum(cut(v, d1) for v in before.values()) / len(pairs)
    follows, seen = defaultdict(float), Counter()
    for (a, _), n in pairs.items():
        follows[a] += cut(n, d2)
        seen[a] += n

    def chance(a, b):
        lower = (before[b] - cut(before[b], d1)) / len(pairs) + spare / (types + 1)
        return (pairs[a, b] - cut(pairs[a, b], d2) + follows[a] * lower) / seen[a] if seen[a] else lower

    some = list(c)
    assert abs(sum(chance("w1", b) for b in some) + follows["w1"] / seen["w1"] * spare / (types + 1) - 1) < 1e-9
    for d, w in tokens.items():
        r = found[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), total, crc32(str(d).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(chance(a, b)) for a, b in zip(["<s>", *w], w, strict=False)), rel_tol=1e-9)


def test_language_model_odd(docs_of, odd):
    found = rows(language_model.score_corpus(docs_of(odd)))
    assert len(found) == len(odd) and {r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    assert language_model.score_corpus(docs_of([])).count() == 0
    held = next(i for i in range(99) if crc32(str(i).encode()) % 10 == 0)
    alone = rows(language_model.score_corpus(docs_of([(held, "only held out")])))[0]
    assert (alone["train_tokens"], alone["n_known"], alone["score"]) == (0, 0, 0.0)
