import numpy as np

from panelloom.llm import quality
from tests.llm.data import docs, read


def test_counts_match_brute_force(spark, sf_dir):
    table, labels = read(spark, sf_dir).select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = quality.Model(table, labels)
    ids, roles = quality._roles(labels, quality.MAX_LABELLED)
    target = set(ids[roles == quality.TARGET].tolist())
    grams, raw, good = quality.Grams(), np.zeros(1 << quality.BUCKET_BITS, np.int64), np.zeros(1 << quality.BUCKET_BITS, np.int64)
    rows = [(r.doc_id, (r.text or "").encode()) for r in table.collect()]
    for i, text in rows:
        raw[grams(text)] += 1
        if i in target:
            good[grams(text)] += 1
    ratios = quality.log_ratios(raw, good)
    assert np.array_equal(ratios, model.ratios.value)
    want = {i: ratios[grams(t)].sum(dtype=np.float64) for i, t in rows}
    got = {r.doc_id: r for r in model.classified().collect()}
    assert all(abs(got[i].log_weight - w) < 1e-9 for i, w in want.items())
    keys = sorted((got[i].gumbel_key for i in got), reverse=True)
    assert {i for i in got if got[i].keep} == {i for i in got if got[i].gumbel_key >= keys[model.k - 1]}


def test_held_out_rows(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    model = quality.Model(read(spark, sf_dir), labels)
    ids, roles = quality._roles(labels, quality.MAX_LABELLED)
    held = set(ids[roles >= quality.GOOD].tolist())
    keep = {r.doc_id: r.keep for r in model.classified().collect()}
    kept_good = [keep[i] for i in held if i in keep and good[i]]
    kept_bad = [keep[i] for i in held if i in keep and not good[i]]
    print(sum(kept_good), len(kept_good), sum(kept_bad), len(kept_bad))
    assert sum(kept_good) >= 0.9 * len(kept_good)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, [(1, "good words here"), (2, None), (None, ""), (4, "x" * 300_000), (4, "x")])
    assert len(quality.classify(table, labels).collect()) == 5
    assert quality.classify(docs(spark, []), labels).collect() == []
    assert all(r.keep for r in quality.classify(table, labels.limit(0)).collect())
