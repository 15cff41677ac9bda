"""The prefix trie, MinHash with Bayesian verification and ranked search against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import conversation_trie, lexical_search, minhash, scans

SPACE = re.compile(r"[\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, path string, depth int, `a.b` string"


def rows(df):
    return [r.asDict() for r in df.collect()]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def test_running_sums_across_partitions(spark):
    """A segment that fills several partitions, with neighbours on both sides."""
    dice = random.Random(3)
    keys = [1] * 5 + [2] * 400 + [3] + [4] * 90 + [9] * 3
    table = [(k, i, dice.randint(-9, 9), dice.getrandbits(60)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(table, "k long, i long, v long, h long").repartition(5)
    for segment in ("k", None):
        found = {r["i"]: r for r in rows(scans.scanned(df, ["k", "i"], {"total": "v"}, {"mix": "h"}, segment))}
        total, mix, before = 0, 0, None
        for k, i, v, h in table:
            if segment and k != before:
                total, mix = 0, 0
            total, mix, before = total + v, mix ^ h, k
            assert (found[i]["total"], found[i]["mix"]) == (total, mix)
    assert scans.scanned(df.limit(0), ["k"], {"total": "v"}).count() == 0


def brute_trie(table, every=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text, *_ in table:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)} {role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[2] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c in own:
        h = crc32(str(c).encode()) % heads
        built[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        leaves, saved = (0, (len(members[path]) - 1) * (len(words(path[-1][1])) if path else 0)) if children[path] else (1, (len(members[path]) - 1) * (len(words(path[-1][1])) if path else 0))
        for below in children[path]:
            leaves, saved = leaves + sums[below][0], saved + sums[below][1]
        sums[path] = leaves, saved
    out = []
    for path, of in members.items():
        ends = sorted(c for c in of if len(built[c]) == len(path))
        out.append((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(children[path]), *sums[path], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, table):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in table], TURNS)
    found = rows(conversation_trie.conversation_trie(df))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(r["at"] for r in found) == list(range(1, len(found) + 1))
    assert all(r["at"] <= r["until"] for r in found)
    return sorted((tuple(r[n] for n in names) for r in found), key=repr)


def test_trie_against_brute_force(spark):
    dice = random.Random(8)
    table = []
    for c in range(-25, 90):
        if c % 7 == 3:
            continue  # gaps, some of them where others would begin
        n = dice.choice([1, 1, 2, 3, 4, 6])
        table += [(c, t, dice.choice(["user", "assistant", None]), dice.choice(["a b", "a  b c", "", None, "Hello there", "é x"])) for t in range(n)]
    table += [(200 + i, t, "system", f"long {t % 3}") for i in range(3) for t in range(40 + 5 * i)]
    table += [(300 + i, t, "user", "copy") for i in range(50) for t in range(3)]
    table += [(7, None, "user", "null turn"), (8, 0, "user", "same number"), (8, 0, "user", "same number"), (None, 1, "user", "lost"), (401, 0, "ab", "c"), (402, 0, "a", "bc")]
    dice.shuffle(table)
    assert trie_of(spark, table) == brute_trie(table)


def test_trie_of_little(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "a", "b")]) == []
    for table in ([(20, 0, "user", "only")], [(21, 0, None, None)], [(c, 0, "u", "t") for c in range(1, 9)]):
        assert trie_of(spark, table) == brute_trie(table)


def test_hash_of_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 60)
    ends = spark.createDataFrame([(1, 5, 6, i) for i in range(500)] + [(2, 5, 6, 7)], "depth long, a long, b long, conv_id long")
    found = {r["depth"]: r["ends_sha256"] for r in rows(conversation_trie.digests_of_ends(ends))}
    assert found == {1: hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest(), 2: hashlib.sha256(b"7").hexdigest()}


def shingles(text):
    w = words(low(text))
    return {" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def brute_links(table):
    sets = [(d, shingles(t)) for d, t in table]
    root = list(range(len(table)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(table)):
        groups[find(i)].append(i)
    out = []
    for of in groups.values():
        ids = [table[i][0] for i in of if table[i][0] is not None]
        least = min(ids, default=None)
        out += [(table[i][0], len(sets[i][1]), least if sets[i][1] else table[i][0]) for i in of]
    return sorted(out, key=repr)


def chained(dice, n, length=60):
    """Each text is the one before with a word or two replaced: near ones link, far ones don't."""
    own = [f"c{dice.randint(0, 500)}" for _ in range(length)]
    out = []
    for i in range(n):
        for _ in range(dice.randint(1, 2)):
            own[dice.randrange(length)] = f"n{i}x{dice.randint(0, 9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [minhash.BLOCK, 300])
def test_links_against_all_pairs(docs_of, odd, block):
    dice = random.Random(block)
    base = [f"t{i}" for i in range(80)]
    stars = [" ".join(dice.choice(["x", "y", "z"]) + w if dice.random() < 0.06 else w for w in base) for _ in range(60)]
    texts = chained(dice, 40) + stars + [" ".join(f"r{dice.randint(0, 40)}" for _ in range(dice.randint(0, 25))) for _ in range(60)] + ["one", "ONE", "one two", "One  Two\n", "two one", ""]
    table = [*enumerate(texts), *((500 + i, texts[i]) for i in range(0, 60, 7)), *((d, t) for d, t in odd if d is None or d > 3)]
    table = [(d if d is None else d + (1000 if k >= len(texts) + 9 else 0), t) for k, (d, t) in enumerate(table)]
    dice.shuffle(table)
    found = rows(minhash.near_duplicates(docs_of(table), block))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == brute_links(table)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found)


def test_links_of_empty_tables(docs_of):
    assert minhash.near_duplicates(docs_of([])).count() == 0
    found = rows(minhash.near_duplicates(docs_of([(1, None), (2, ""), (1, None), (None, " ")])))
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in found), key=repr) == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, False)]


def test_leaders_go_once_they_have_met_all(docs_of):
    """Many families of texts that share keys but link only within: whoever leads, no family loses a link."""
    dice = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    table = []
    for family in range(12):
        own = [w if dice.random() > 0.25 else f"f{family}{w}" for w in base]
        for k in range(8):
            table.append((family * 10 + k, " ".join(f"v{k}{w}" if dice.random() < 0.03 else w for w in own)))
    found = rows(minhash.near_duplicates(docs_of(table)))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == brute_links(table)
    assert 12 <= len({r["component_id"] for r in found}) < 60


def test_blocks_join_what_leaders_miss(spark):
    """Groups in which each document outside the largest component meets all others, whatever the block."""
    members = spark.createDataFrame([(1, n, 10, 0 if n < 20 else n) for n in range(30)], "key long, node long, size long, comp long")
    for block in (20, 100, 10**6):
        found = rows(minhash.blocked(members, block))
        met = set()
        for x, y, z in {(r["x"], r["y"], r["z"]) for r in found}:
            of = [r for r in found if (r["x"], r["y"], r["z"]) == (x, y, z)]
            met |= {frozenset((h["node"], p["node"])) for h in of if h["role"] == 0 for p in of if p["role"] == 1 and p["comp"] != h["comp"] and (p["main"] or p["node"] < h["node"])}
        assert met == {frozenset((a, b)) for a in range(20, 30) for b in range(30) if a != b}


def test_bayesian_bounds():
    """The posterior as a binomial tail, against the integral; and the miss rate of pairs at the threshold."""
    for n, needed in zip(range(minhash.BATCH, 129, minhash.BATCH), minhash.NEEDED, strict=True):
        s = np.linspace(0, 1, 200_001)
        for m in (needed - 1, needed):
            if m >= 0:
                density = s**m * (1 - s) ** (n - m)
                assert (density[s >= 0.8].sum() / density.sum() >= minhash.MISS) == (m >= needed)
    dice = np.random.default_rng(1)
    held = dice.integers(0, 2**32, (1, 128), dtype=np.uint32)
    probes = np.where(dice.random((20_000, 128)) < 0.8, held, dice.integers(0, 2**32, (20_000, 128), dtype=np.uint32))
    assert len(minhash.likely(held, probes, np.ones((1, 20_000), bool))[0]) >= 19_998
    far = np.where(dice.random((2000, 128)) < 0.4, held, dice.integers(0, 2**32, (2000, 128), dtype=np.uint32))
    assert len(minhash.likely(held, far, np.ones((1, 2000), bool))[0]) == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(table, queries, top=10):
    docs = [(d, TERM.findall(low(t))) for d, t in table]
    n_docs, n_terms = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    asked = defaultdict(list)
    for item, text in queries:
        asked[item] += TERM.findall(low(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, w in docs:
            tf = Counter(w)
            m = 25 + (75 * len(w) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if s[1] else s[2], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def searched(spark, docs_of, table, queries, **more):
    asked = spark.createDataFrame([(i, t, 5) for i, t in queries], "item_id string, text string, doc_id int")
    found = lexical_search.ranked_search(docs_of(table), asked, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"shard": 50, "block_terms": 20}, {"shard": 1, "top": 3}])
def test_search_against_brute_force(spark, docs_of, odd, more):
    dice = random.Random(2)
    common = [f"w{int(dice.paretovariate(0.7))}" for _ in range(4000)]
    table = [(i, " ".join(dice.choice(common) for _ in range(dice.randint(0, 60)))) for i in range(300)]
    table += [(400 + i, "same Words, again-and again w1") for i in range(30)] + odd
    queries = [(f"q{i}", " ".join(dice.choice(common) for _ in range(dice.randint(0, 30)))) for i in range(25)]
    queries += [("ties", "again AND words!"), ("null", None), ("none", "neverseen"), (None, "w1 w2"), ("twice", "w3 w4"), ("twice", "w4 w5"), ("long", dict(odd)[4]), ("é", "ñandú w1")]
    assert searched(spark, docs_of, table, queries, **more) == brute_search(table, queries, more.get("top", 10))


def test_search_of_empty_tables(spark, docs_of):
    assert searched(spark, docs_of, [], [("q", "a b")]) == []
    assert searched(spark, docs_of, [(1, "a b")], []) == []
    assert searched(spark, docs_of, [(1, None), (2, "-- !")], [("q", "a b")]) == []


def test_search_leaves_most_nodes_alone():
    """Bounds cut the search short where few documents are good."""
    dice = np.random.default_rng(4)
    docs = [(i, np.unique(dice.integers(0, 50, 12)).astype(np.uint64), None) for i in range(2000)]
    docs = [(i, t, dice.integers(1, 1000, len(t)) if i % 100 else np.full(len(t), 100_000)) for i, t, _ in docs]
    tree = lexical_search.Tree.of(*lexical_search.shard_of(docs))
    best = lexical_search.Best(5)
    split = lexical_search.search(tree, np.array([1, 2, 3], np.uint64), np.array([1, 1, 1]), best, split=4)
    scores = {i: sum(int(x) for t, x in zip(ts, w, strict=True) if t in (1, 2, 3)) for i, ts, w in docs}
    assert list(zip((-best.scores).tolist(), best.docs.tolist(), strict=True)) == sorted((-s, i) for i, s in scores.items())[:5]
    assert split < 400


def test_shards_can_be_written_and_searched_again(spark, docs_of, tmp_path):
    table = [(i, f"w{i % 7} w{i % 3} w1") for i in range(40)]
    vocabulary = np.sort(lexical_search.word_hashes([b"w1", b"w2", b"w5"]))
    counts = lexical_search.counted(docs_of(table), vocabulary)
    lexical_search.indexed(counts, 40, 120, shard=30).write.parquet(str(tmp_path / "index"))
    again = spark.read.parquet(str(tmp_path / "index"))
    assert again.count() > 1
    query = (np.searchsorted(vocabulary, np.sort(lexical_search.word_hashes([b"w5"]))).astype(np.uint64), np.array([3]))
    found = again.transform(lambda d: lexical_search.searched(d, [query], top=40)).groupBy("doc_id").agg(F.max("score").alias("score"))
    assert sorted(r["doc_id"] for r in rows(found)) == [i for i in range(40) if i % 7 == 5]
