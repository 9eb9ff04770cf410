import numpy as np

from panelloom.llm import ctw
from tests.llm.data import docs


def test_context_reaches_past_a_word_of_six(spark):
    # the digit that ends a word is settled by the byte seven before it
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["aghijkl1", "bghijkl2"], 300))) for i in range(60)]
    held = [r.bits_per_byte for r in ctw.score(docs(spark, rows)).collect() if r.held_out]
    assert held and max(held) < 0.17  # one bit a word is 0.11, two are 0.22
