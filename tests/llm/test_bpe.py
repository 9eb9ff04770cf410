import base64
from hashlib import sha256

import pytest
import tiktoken

from panelloom.llm import bpe
from tests.llm.data import docs, read

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def want(rows):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_against_tiktoken(spark, sf_dir):
    d = read(spark, sf_dir)
    assert rows(bpe.round_trip(d, PATH, P.PATTERN)) == want([(r.doc_id, r.text) for r in d.collect()])


def test_edges(spark):
    t = [(1, None), (2, ""), (3, "\x00\x01 ▁ <unk> <|endoftext|>\r\n\t x"), (4, "日本語 🙂🙂 ağ"), (4, "日本語 🙂🙂 ağ"), (None, "it's  \n\n two"), (6, "a" * 20000 + " 12345" * 4000)]
    d = docs(spark, t).selectExpr("*", "1 as ids", "'x' as n_tokens")
    assert rows(bpe.round_trip(d, PATH, P.PATTERN)) == want(t)
    assert rows(bpe.round_trip(docs(spark, []), PATH, P.PATTERN)) == []
    back = bpe.decode(bpe.encode(d, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((x or "").encode() for _, x in t)
