import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from skein.llm import minhash, near_dedup
from skein.llm.common import read


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(table):
    """The groups of row numbers that links of Jaccard >= 4/5 join, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in table], list(range(len(table)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 9 * min(len(a), len(b)) >= 4 * (len(a) + len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(table)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def least(table):
    return sorted(min((table[i][0] is None, table[i][0] or 0) for i in g) for g in groups(table))


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


@pytest.fixture(scope="module")
def copies():
    """Random texts and copies with a few words replaced, some of them around the threshold."""
    dice, out = random.Random(11), []
    for _ in range(40):
        base = [f"w{dice.randrange(5000)}" for _ in range(dice.randint(60, 300))]
        for _ in range(5):
            text = list(base)
            for _ in range(dice.randint(0, max(1, len(base) // 35))):
                text[dice.randrange(len(text))] = f"x{dice.randrange(10**6)}"
            out.append((len(out), " ".join(text)))
    return out


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 200])
def test_groups_of_all_pairs(docs_of, copies, odd, block):
    table = [*copies, *[(d + 1000, t) for d, t in odd if d is not None and d != 7]]
    found = {}
    for r in near_dedup.similar_rows(docs_of(table), block).collect():
        found.setdefault(r.component, []).append(r.x_id)
    assert sorted(map(sorted, found.values())) == sorted(sorted(table[i][0] for i in g) for g in groups(table))


def test_stage_against_all_pairs(spark, docs_of, copies):
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert kept(stage(spark, docs_of(copies), "")) == least(copies)
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    assert kept(stage(spark, docs, "")) == least([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_and_missing_ids(docs_of, copies):
    (_, a), (_, b) = copies[0], copies[10]
    assert kept(near_dedup.drop_similar(docs_of([(7, a), (7, a), (7, b), (8, b), (None, a), (None, "no copy"), (None, "no copy")]))) == [(False, 7), (False, 7), (True, 0)]
    assert near_dedup.drop_similar(docs_of([])).count() == 0


def test_links_share_a_key_of_fingerprints(spark, copies):
    tables = near_dedup.tables_for(16)
    rows = [(i, near_dedup.fingerprint(minhash.shingle_set(t, 5), 16, tables)) for i, t in copies]
    key = {r.node: r.key for r in near_dedup.candidates(spark.createDataFrame(rows, "node long, print binary"), tables).collect()}
    linked = [g for g in groups(copies) if len(g) > 1]
    assert len(linked) > 30 and all(len({key[i] for i in g}) == 1 for g in linked)
    assert len(set(key.values())) >= 40  # texts of different bases aren't candidates


def test_a_large_group_is_not_linked_by_every_table(spark, monkeypatch):
    """Each table linked all of its nodes, under each of their keys."""
    dice, tables, n = random.Random(3), near_dedup.tables_for(16), 120
    base = [f"w{dice.randrange(5000)}" for _ in range(200)]
    texts = [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i, k in ((i, dice.randrange(200)) for i in range(n))]
    rows = [(i, near_dedup.fingerprint(minhash.shingle_set(t, 5), 16, tables)) for i, t in enumerate(texts)]
    made, components = [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda links: made.append(links.count()) or components(links))
    found = near_dedup.candidates(spark.createDataFrame(rows, "node long, print binary"), tables).collect()
    assert sorted(r.node for r in found) == list(range(n)) and {r.key for r in found} == {0}
    assert made[-1] <= 4 * n + n  # 4 partitions, and what the first tables left


def test_crowded_buckets_across_batches(monkeypatch):
    """Of a bucket of any size all nodes are joined, wherever batches end; far prints of a small one aren't."""
    dice = np.random.default_rng(2)
    key = np.concatenate([np.full(3, 1), np.full(3 * near_dedup.CROWDED, 2), np.full(2, 3)])
    node, (p, q) = np.arange(len(key)), dice.integers(-(2**63), 2**63 - 1, (2, len(key)))
    p[-1], q[-1] = p[-2], q[-2] ^ 7
    for gathered in (500, 1 << 17):
        monkeypatch.setattr(near_dedup, "GATHER", gathered)
        batches = (pa.RecordBatch.from_arrays([pa.array(c[i : i + 300]) for c in (key, node, p, q)], names=["key", "node", "p", "q"]) for i in range(0, len(key), 300))
        found = {tuple(sorted((r["a"], r["b"]))) for b in near_dedup.compared(batches) for r in b.to_pylist() if r["a"] != r["b"]}
        assert found == {(3, i) for i in range(4, len(key) - 2)} | {(len(key) - 2, len(key) - 1)}
