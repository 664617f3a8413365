"""The pipeline against the same steps done plainly."""

import corpus_pipeline
from loomstone.llm import quality_classifier, source_mix
from tests.llm import test_operators as brute

FEW = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in quality_classifier.score_quality(docs, labels).where("predicted = 1").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    out, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
        if name != "source_mix":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
            stages[name] = {r["doc_id"]: r["text"] for r in out.collect()}
    assert stages["quality_classifier"] == {d: rows[d] for d in good}

    left = stages["quality_classifier"]
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := brute.words(t)) else frozenset() for d, t in left.items()}
    root = {d: d for d in left}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(left)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and k >= 0.8 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {d: t for d, t in left.items() if find(d) == d}
    assert stages["ngram_join"] == left

    removed = {d: n for d, _, n, _, _ in brute.covered(sorted(left.items()))}
    after = stages["repeat_removal"]
    assert all(after[d] == t for d, t in left.items() if not removed[d]) and set(after) == {d for d, t in left.items() if not removed[d] or d in after}
    assert all(len(after[d].encode()) <= len(left[d].encode()) - removed[d] for d in after if removed[d])

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {d for d, _, hit, _ in brute.leaks(sorted(after.items()), items) if hit}
    assert stages["decontamination"] == {d: t for d, t in after.items() if d not in dirty}
    assert {r["doc_id"] for r in out.collect()} == set(stages["decontamination"])


def test_pipeline_of_odd_rows(spark, sf):
    docs = spark.createDataFrame(brute.odd_rows(), FEW)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() >= 1


def test_pipeline_of_no_rows(spark, sf):
    docs = spark.createDataFrame([], FEW)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0 and source_mix.WEIGHTS == (3, 1, 2)
