"""Every operator on nulls, empties, repeated rows, a long text, clashing columns, and on nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelloom.llm import bpe, chat, ctw, decontam, fingerprints, quality, secrets, sharding, simhash, substrings
from tests.llm.data import docs

NAMES = "doc kind block lane bucket hashes docs counts fp mask value path blob spans chosen n bits row shard role noise place log_weight prices ids pieces a b m root node key_a key_b n_chars edited _noise _blob _spans _hit_runs _row".split()
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [(1, "some plain words of a text"), (1, "some plain words of a text"), (1, "another text under that id"), (None, "a text without an id"), (None, "a text without an id"), (None, None), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG + " end"), (7, "secret = hunter2hunter2"), (8, "é ü 漢字 🙂 " * 30)]


@pytest.fixture(scope="module")
def side(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([("b", "plain words of"), (None, None), ("c", ""), ("b", "plain words of")], "item_id string, text string")
    return labels, benchmark


OPERATORS = {
    "op1": lambda t, labels, benchmark: quality.classify(t, labels),
    "op1 stage": lambda t, labels, benchmark: quality.keep_sampled(t, labels),
    "op2": lambda t, labels, benchmark: decontam.contamination_report(t, benchmark),
    "op2 stage": lambda t, labels, benchmark: decontam.drop_contaminated(t, benchmark, least_share=1),
    "op3": lambda t, labels, benchmark: simhash.near_duplicates(t),
    "op3 stage": lambda t, labels, benchmark: simhash.keep_one_each(t),
    "op4": lambda t, labels, benchmark: secrets.report(t),
    "op4 stage": lambda t, labels, benchmark: secrets.redact(t),
    "op6": lambda t, labels, benchmark: fingerprints.report(t),
    "op7": lambda t, labels, benchmark: sharding.assign(t, limit=1000),
    "op8": lambda t, labels, benchmark: substrings.report(t),
    "op9": lambda t, labels, benchmark: bpe.round_trip(t, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "op9 stage": lambda t, labels, benchmark: bpe.with_tokens(t, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "op10": lambda t, labels, benchmark: ctw.score(t),
}
#: Rows that a stage keeps: near copies, empties among them, leave one.
KEPT = {"op3 stage": 7}


def ordered(rows):
    return sorted(str(sorted(r.asDict().items())) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_clashing_names(spark, side, name):
    plain = docs(spark, ROWS)
    clash = plain.select("*", *[F.lit(f"user {n}").alias(n) for n in NAMES if not (name == "op6" and n == "n_chars")])
    a, b = OPERATORS[name](plain, *side), OPERATORS[name](clash, *side)
    one, two = a.collect(), b.collect()
    assert len(one) == len(two) and len(one) == KEPT.get(name, len(ROWS))
    if "stage" in name:
        assert clash.columns == b.columns[: len(clash.columns)]
        assert all(r[n] == f"user {n}" for r in two for n in NAMES if n in clash.columns and n != "n_chars")
        assert ordered(b.select("doc_id", "text").collect()) == ordered(a.select("doc_id", "text").collect())
    else:
        assert a.columns == b.columns and (name == "op7" or ordered(one) == ordered(two))


@pytest.mark.parametrize("name", OPERATORS)
def test_nothing_gives_nothing(spark, side, name):
    assert OPERATORS[name](docs(spark, []), *side).collect() == []


@pytest.mark.parametrize("name", ["op1", "op2", "op2 stage"])
def test_empty_side_tables(spark, side, name):
    assert len(OPERATORS[name](docs(spark, ROWS), *(t.limit(0) for t in side)).collect()) == len(ROWS)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, None), (None, 3, "assistant", "x"), (2, 0, "assistant", LONG), (3, 0, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    clash = table.select("*", *[F.lit("user").alias(n) for n in ("turns", "target", "formatted", "whole", "loss", "size", "bodies", "heads", "trained")])
    got = {r.conv_id: r for r in chat.report(table).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 0), None: (2, 1), 2: (1, len(LONG)), 3: (1, 0)}
    assert ordered(chat.report(clash).collect()) == ordered(got.values())
    assert chat.report(table.limit(0)).collect() == []
