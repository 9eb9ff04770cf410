from collections import Counter
from math import log10

import pytest

from panelloom.llm import ctw
from tests.llm.data import docs


def test_base_is_add_one_smoothing(spark):
    rows = [(i, "the cat sat on the mat" if i % 2 else "a dog ran") for i in range(20)] + [(50, None), (52, "zzzz the")]
    train = Counter()
    for i, t in rows:
        if not ctw.is_held_out(i):
            train.update([*(t or "").encode().split(), None])
    n, v = sum(train.values()), len(train)
    # over the known words and one unknown the smoothed probabilities sum to one
    assert sum((c + 1) / (n + v + 1) for c in [*train.values(), 0]) == pytest.approx(1)
    got = {r.doc_id: r.base_score for r in ctw.score(docs(spark, rows), depth=3).collect()}
    for i, t in rows:
        want = sum(log10((train[w] + 1) / (n + v + 1)) for w in [*(t or "").encode().split(), None])
        assert got[i] == pytest.approx(want, rel=1e-9)
