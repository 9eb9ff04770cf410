from collections import Counter
from math import exp, lgamma, log, log10

import numpy as np
import pytest

from panelloom.llm import ctw
from tests.llm.data import docs, read


class Brute:
    """The same model, by recursion over dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.children = depth, Counter(), {}
        for text in texts:
            for context, node, bit in self.events(text):
                for d in range(depth + 1):
                    self.n[context[:d], node, bit] += 1
                    if d:
                        self.children.setdefault((context[: d - 1], node), set()).add(context[:d])
        self.memo = {}

    def events(self, text):
        s = b"\xff" * self.depth + ctw.normal(text)[1] + b"\xff"
        for k in range(self.depth, len(s)):
            node = 1
            for i in range(7, -1, -1):
                bit = s[k] >> i & 1
                yield s[k - self.depth : k][::-1], node, bit
                node = 2 * node + bit

    def log_e(self, c, node):
        a, b = self.n[c, node, 0], self.n[c, node, 1]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - log(np.pi) - lgamma(a + b + 1)

    def log_w(self, c, node):
        if (c, node) not in self.memo:
            e = self.log_e(c, node)
            if len(c) < self.depth:
                e = np.logaddexp(log(0.5) + e, log(0.5) + sum(self.log_w(x, node) for x in self.children.get((c, node), ())))
            self.memo[c, node] = e
        return self.memo[c, node]

    def p(self, context, node, bit, d=0):
        c = context[:d]
        a, b = self.n[c, node, 0], self.n[c, node, 1]
        kt = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == self.depth:
            return kt
        below = context[: d + 1]
        if not self.n[below, node, 0] + self.n[below, node, 1]:
            return kt
        stop = exp(log(0.5) + self.log_e(c, node) - self.log_w(c, node))
        return stop * kt + (1 - stop) * self.p(context, node, bit, d + 1)

    def score(self, text):
        return sum(log10(self.p(*e)) for e in self.events(text))


def brute_base(rows):
    train = Counter()
    for i, t in rows:
        if not ctw.is_held_out(i):
            train.update([*ctw.normal((t or "").encode())[0], None])
    n, v = sum(train.values()), len(train)
    out = {}
    for i, t in rows:
        tokens = [*ctw.normal((t or "").encode())[0], None]
        out[i] = (ctw.is_held_out(i), len(tokens), sum(train[w] > 0 for w in tokens), n, sum(log10((train[w] + 1) / (n + v + 1)) for w in tokens))
    return out


def compare(spark, rows, depth):
    got = {r.doc_id: r for r in ctw.score(docs(spark, rows), depth=depth).collect()}
    base = brute_base(rows)
    model = Brute([(t or "").encode() for i, t in rows if not ctw.is_held_out(i)], depth)
    assert set(got) == set(base)
    for i, t in rows:
        assert tuple(got[i])[1:5] == base[i][:4]
        assert got[i].base_score == pytest.approx(base[i][4], rel=1e-9)
        assert got[i].score == pytest.approx(model.score((t or "").encode()), rel=1e-5)


def test_small(spark):
    words = "the cat sat on a mat while Dogs ran über hills".split()
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words, 12))) for i in range(40)] + [(50, None), (51, ""), (52, "zzzz 日本"), (53, "a" * 3000)]
    compare(spark, rows, 3)
    compare(spark, rows, 6)


def test_empty_and_untrained(spark):
    assert ctw.score(docs(spark, [])).collect() == []
    held = next(i for i in range(100) if ctw.is_held_out(i))
    row = ctw.score(docs(spark, [(held, "ab")])).first()
    assert row.train_tokens == 0 and row.bits_per_byte == pytest.approx(8)
    rows = ctw.score(docs(spark, [(None, "ab"), (2, "ab"), (2, "ab")])).collect()
    assert len(rows) == 3 and all(r.train_tokens == 6 for r in rows)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    text = bytes(rng.choice(list(b"abcd "), 400).tolist())
    codes = ctw.gram_codes(text, 3)
    context = codes[200] & ~np.uint64(255)
    every = np.concatenate([codes, context + np.arange(256, dtype=np.uint64)])
    counts = np.r_[np.ones(len(codes), np.int64), np.zeros(256, np.int64)]
    every, counts = ctw._merge([every], [counts])
    crown = ctw.Crown(*ctw.top_sums(every, counts, 3))
    p = 10 ** ctw.log10_probabilities(every, counts, 3, crown)
    assert p[(every & ~np.uint64(255)) == context].sum() == pytest.approx(1)


def test_beats_base_on_held_out(spark, sf_dir):
    table = read(spark, sf_dir)
    rows = ctw.score(table).collect()
    assert len(rows) == table.count()
    held = [r for r in rows if r.held_out]
    print(sum(r.score for r in held), sum(r.base_score for r in held))
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
