import corpus_pipeline
from skein.llm import decontaminate, exact_dedup, quality
from skein.llm.common import read

from .test_near_dedup import least


def test_stages_take_effect(spark, sf):
    docs = read(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, read(spark, sf, "labels"))
    left = {d for d, t in texts.items() if model.score(t) >= 0.5}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    subset = docs.filter(docs.doc_id.isin(*left))
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()} == left
    kept = {r.doc_id for r in exact_dedup.exact_dedup(subset).collect() if r.kept}
    assert {r.doc_id for r in exact_dedup.drop_copies(subset).collect()} == kept
    kept = {d for _, d in least([(d, texts[d]) for d in kept])}
    subset = docs.filter(docs.doc_id.isin(*kept))
    found = decontaminate.digest_contamination(decontaminate.find_contamination(subset, read(spark, sf, "benchmark"))).collect()
    kept = {r.doc_id for r in found if not r.contaminated}
    done = corpus_pipeline.run(spark, sf)
    assert {r.doc_id: r.text for r in done.collect()} == {d: texts[d] for d in kept}
    assert sum(r.taken for r in done.collect()) > 0


def test_empty_documents(spark, sf):
    docs = read(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def through(spark, docs, benchmark, labels, folder):
    """What each stage leaves, by name; the tables beside the documents are written for it."""
    benchmark.write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(folder))
        left[name] = [(r.doc_id, r.text) for r in docs.collect()]
    return left


def test_odd_documents(spark, docs_of, odd, tmp_path):
    """Null ids and texts, repeated rows and ids, very long texts, clashing columns; no labels, so nothing is rejected for its quality."""
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string, x_id int")
    passage = " ".join(f"p{i}" for i in range(12))
    items = spark.createDataFrame([(1, passage, 5), (1, passage, 5), (2, None, 5), (None, "", 5)], "item_id long, text string, doc_id int")
    copies = [(7, "alpha beta"), (3, "gamma  delta"), (7, "gamma delta"), (9, "eps"), (9, "eps"), (10, f"x {passage} y"), (None, f"q r {passage} s t")]
    left = through(spark, docs_of([*odd, *copies]), items, none, tmp_path)
    assert len(left["quality classifier"]) == len(odd) + len(copies)
    exact = left["exact dedup"]
    assert sorted(d for d, t in exact if t in {"alpha beta", "gamma  delta", "gamma delta", "eps"}) == [3, 7, 9]
    assert len(exact) == len({"".join((t or "").split()) for _, t in [*odd, *copies]})
    near = left["SimHash near-dedup"]
    assert sorted(map(str, near)) == sorted(map(str, [r for r in exact if r[0] != 5]))  # 4 and 5 share nearly all shingles
    clean = left["benchmark decontamination"]
    assert sorted(map(str, set(near) - set(clean))) == sorted(map(str, [(10, f"x {passage} y"), (None, f"q r {passage} s t")]))
    assert sorted(map(str, left["mixing sources to target weights"])) == sorted(map(str, clean))


def test_empty_benchmark_and_one_class(spark, docs_of, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    left = through(spark, docs_of([(1, "some words"), (2, "other words here")]), items, labels, tmp_path)
    assert all(sorted(d for d, _ in rows) == [1, 2] for rows in left.values())
