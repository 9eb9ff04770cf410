from collections import Counter

from panelloom.llm import simhash
from tests.llm.data import docs
from tests.llm.test_simhash import components, fingerprint


def test_one_row_of_every_component(spark):
    rows = [(4, "a clean text about rivers"), (4, "something else and quite unlike"), (4, "a clean text about rivers"), (9, "Something else and quite unlike"), (None, "copies without an id"), (None, "Copies without an id"), (None, "alone without an id"), (7, "copied under a kept id"), (3, "copied under a kept id"), (3, "zzz first text of three"), (None, None), (2, "")]
    component = {}
    label = {f: c for _, f, c in components([(n, fingerprint(t)) for n, (_, t) in enumerate(rows)])}
    for _, t in rows:
        component[t] = label[f"{fingerprint(t):016x}"]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_each(docs(spark, rows)).collect()]
    assert Counter(component[t] for _, t in kept) == Counter(set(component.values()))
    least = {}
    for i, t in rows:
        least[component[t]] = min(least.get(component[t], (True, 0)), (i is None, i or 0))
    assert all((i is None, i or 0) == least[component[t]] for i, t in kept)
    assert set(kept) <= set(rows)
