import pytest

from panelloom.llm import bpe

P = pytest.importorskip("public_tokenizers")


def test_text_that_overfills_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.Codec(bpe.serialise(tokens), tokens, P.PATTERN)
    first = " ".join(f"qx{chr(97 + i % 26)}{chr(97 + i // 26)}zv" for i in range(60))
    second = " ".join(f"wj{chr(97 + i % 26)}{chr(97 + i // 26)}kq" for i in range(60)) + first[-8:]
    for text in (first, second, first):
        assert codec.decode(codec.encode(text)) == text.encode()
