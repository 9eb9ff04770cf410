"""Byte-level BPE by a sentencepiece model made from a rank file.

Each byte is mapped to one letter, so that a token is a piece of letters, and
scored by its negative rank: the model then merges the pair of lowest rank
first.  Normalisation is the identity, and decoding maps the letters back.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.store import bounded_batches, free_name

#: The letter of byte b is FIRST + b, in a range without white space or marks.
FIRST = 0x4E00
CACHE = 200_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from zero without gaps")
    return [ranks[i] for i in range(len(ranks))]


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose id of a token is its rank."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=token.decode("latin-1").translate(_LETTERS), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.pad_id = len(tokens), -1, -1, -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


_LETTERS = {b: FIRST + b for b in range(256)}


class Codec:
    """Encodes pre-tokens, with a bounded cache, and decodes ids."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str) -> None:
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = self.pieces.id_to_piece(list(range(len(tokens))))
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def _coded(self, missing: list[str]) -> dict[str, list[int]]:
        raw = [x.encode() for x in missing]
        out = {x: [self.whole[b]] for x, b in zip(missing, raw, strict=True) if b in self.whole}
        rest = [(x, b) for x, b in zip(missing, raw, strict=True) if b not in self.whole]
        coded = self.pieces.encode([b.decode("latin-1").translate(_LETTERS) for _, b in rest], num_threads=1) if rest else []
        out.update((x, ids) for (x, _), ids in zip(rest, coded, strict=True))
        return out

    def encode(self, text: str) -> list[int]:
        if len(self.cache) > CACHE:  # only between texts, so that none loses what it needs
            self.cache.clear()
        found = self.split(text)
        cache = self.cache
        missing = {x for x in found if x not in cache}
        if missing:
            cache.update(self._coded(list(missing)))
        out: list[int] = []
        for x in found:
            out += cache[x]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The model's pieces, each letter mapped back to its byte.

        A letter's lower half in UTF-16 is its byte, as ``FIRST`` ends in zeros.
        """
        return "".join(map(self.letters.__getitem__, ids)).encode("utf-16-le")[::2]


def _codecs(docs: DataFrame, ranks_path: str, pattern: str):
    """A broadcast of the model: its size is that of one vocabulary file."""
    bounded_batches(docs.sparkSession)
    tokens = read_ranks(ranks_path)
    return docs.sparkSession.sparkContext.broadcast((serialise(tokens), tokens, pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of each row's whole text.

    Null texts count as empty and have no ids.  Rows are neither dropped nor
    merged, ids may be null or repeated, an empty table gives an empty one,
    other columns are left out, whatever their names.  A text of any length is
    coded whole, by one worker.
    """
    shared = _codecs(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            ids = [codec.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``decoded``, the bytes of each row's ``ids`` (null: none)."""
    shared = _codecs(encoded, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            raw = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, decoded binary")


DIGESTS = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each row's ids and of the bytes decoded from them.

    The same as :func:`encode`, then :func:`decode`, in one pass, so that ids
    need not travel.  Null texts count as empty; every row has one result,
    whatever its id; an empty table gives an empty one.
    """
    return with_tokens(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ranks_path, pattern, ids=False).drop("text")


def with_tokens(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", ids: bool = True) -> DataFrame:
    """``docs``, all rows and columns, with what each text's tokens are.

    Added: ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if wanted, the
    ``ids``.  A column of ``docs`` with one of these names stays, and the new
    one gets an underscore more.  Null texts count as empty, and stay null.
    """
    shared = _codecs(docs, ranks_path, pattern)
    at = docs.columns.index(text_col)
    added = DIGESTS | ({"ids": T.ArrayType(T.IntegerType())} if ids else {})
    schema = T.StructType(list(docs.schema))
    for name, kind in added.items():
        schema.add(free_name(docs, name), kind)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        decimal = [str(i) for i in range(len(codec.letters))].__getitem__
        for batch in batches:
            coded, count, of_ids, of_bytes = [], [], [], []
            for text in batch.column(at).to_pylist():
                found = codec.encode(text or "")
                count.append(len(found))
                of_ids.append(sha256(",".join(map(decimal, found)).encode()).hexdigest())
                of_bytes.append(sha256(codec.decode(found)).hexdigest())
                if ids:
                    coded.append(np.array(found, np.int32))
            made = [pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            if ids:
                made.append(pa.array(coded, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    return docs.mapInArrow(run, schema)
