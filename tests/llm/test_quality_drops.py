from panelloom.llm import quality
from tests.llm.data import read


def test_bad_rows_go_where_labels_are_many(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = read(spark, sf_dir, "labels")
    model = quality.Model(read(spark, sf_dir), labels)
    ids, roles = quality._roles(labels, quality.MAX_LABELLED)
    held = set(ids[roles >= quality.GOOD].tolist())  # these set the cut, but no ratio
    kind = {r.doc_id: "low" if r.quality == 0 else "toxic" if r.toxic else "good" for r in labels.collect() if r.doc_id in held}
    keep = {"low": [], "toxic": [], "good": []}
    for r in model.classified().collect():
        if r.doc_id in kind:
            keep[kind[r.doc_id]].append(r.keep)
    share = {k: sum(v) / len(v) for k, v in keep.items()}
    print({k: (sum(v), len(v)) for k, v in keep.items()})
    assert share["good"] >= 0.98 and share["toxic"] <= 0.4 and share["low"] <= 0.3
