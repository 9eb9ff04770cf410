import corpus_pipeline
from panelloom.llm import decontam, secrets, simhash


def least_of_each(rows):
    """The least id of each component of texts that share 0.8 of their five-word shingles, by comparing all that share any."""
    sets = {i: frozenset(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for i, r in rows.items()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    def join(i, j):
        i, j = root(i), root(j)
        label[max(i, j)] = min(i, j)

    first, holders = {}, {}
    for i, s in sorted(sets.items()):
        join(i, first.setdefault(s, i))
    for s, i in first.items():
        for h in s:
            holders.setdefault(h, []).append(i)
    pairs = {(at[x], j) for at in holders.values() if len(at) < 300 for x in range(len(at)) for j in at[x + 1 :]}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            join(i, j)
    return {root(i) for i in sets}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and after
        if name == "simhash_near_dedup":
            assert set(after) == least_of_each(before)
        if name == "benchmark_decontamination":
            report = decontam.contamination_report(spark.createDataFrame(list(before.values()), docs.schema), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert set(after) == {r.doc_id for r in report.collect() if not r.contaminated}
        if name == "secret_scans":
            assert set(after) == set(before)
            changed = [i for i in after if after[i].text != before[i].text]
            assert changed and all(secrets.REDACTED in after[i].text for i in changed)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.collect()} == set(before)
