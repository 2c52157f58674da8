"""Byte-level BPE with a sentencepiece model written straight from a rank file.

Each token of the vocabulary becomes one piece: its bytes are mapped to printable characters, its
score is the negative rank, so that the highest-scored merge is the merge of lowest rank. The
normaliser is the identity. Pre-tokens are cut by the public pattern and encoded one by one;
decoding looks ids up and joins their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from tidegauge.llm.common import id_text, map_rows

#: Distinct pre-tokens whose ids a task remembers; beyond it the memory starts anew.
CACHE_SIZE = 1 << 18


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, which must run from 0 without a hole."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    return [ranks[r] for r in range(len(ranks))]


def byte_characters() -> str:
    """One printable character per byte: itself if printable in Latin-1, else one above U+0100."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """sentencepiece ModelProto; piece 0 is the unknown piece, token ``r`` is piece ``r + 1``."""
    chars = byte_characters()
    # fixed values: field numbers and enumerations of the public model format
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(rank)))
               for rank, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(tokens) + 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one task; rebuilt from the serialised model, so a retry loses nothing."""

    def __init__(self, model: bytes, tokens: list[bytes]):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = tokens
        self.table = byte_characters()
        # the pattern's white space is the Unicode property, whatever an engine's \s stands for
        self.pattern = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}")
                                     .replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        codec = self

        class Memory(dict):
            def __missing__(self, piece: str):
                ids = self[piece] = codec.encode_piece(piece)
                return ids
        self.memory = Memory()

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        mapped = piece.encode("utf-8").decode("latin-1").translate(self.table)
        return tuple(i - 1 for i in self.processor.encode(mapped, out_type=int))

    def encode(self, text: str) -> list[int]:
        if len(self.memory) > CACHE_SIZE:
            self.memory.clear()
        return list(chain.from_iterable(map(self.memory.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(docs: DataFrame, vocabulary: str | None):
    # one vocabulary file: its size is fixed and does not depend on the data
    tokens = read_ranks(vocabulary or default_vocabulary())
    return docs.sparkSession.sparkContext.broadcast((serialise_model(tokens), tokens))


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` (array of int) per document of ``doc_id, text``.

    A null text is an empty one and has no ids; repeated rows stay; null ids pass through; other
    columns are ignored; an empty table gives an empty table. No text is cut.
    """
    shared = _codec(docs, vocabulary)

    def start():
        codec = Codec(*shared.value)
        return lambda doc_id, text: [(doc_id, codec.encode(text))]
    return map_rows(id_text(docs), "doc_id long, ids array<int>", start)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give an empty text, bytes that are no UTF-8
    (ids cut within a character) become replacement characters."""
    shared = _codec(encoded, vocabulary)

    def start():
        codec = Codec(*shared.value)
        return lambda doc_id, ids: [(doc_id, codec.decode(ids or []).decode("utf-8", "replace"))]
    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, text string", start)


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, decode what was encoded, digest."""
    shared = _codec(docs, vocabulary)

    def start():
        codec = Codec(*shared.value)

        def one(doc_id, text):
            ids = codec.encode(text)
            return [(doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(codec.decode(ids)).hexdigest())]
        return one
    return map_rows(id_text(docs), "doc_id long, n_tokens long, ids_sha256 string, "
                                   "decoded_sha256 string", start)
