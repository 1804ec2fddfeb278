"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every byte 0-255 is mapped to one letter (U+0100 + byte), so that any byte string is a string of
ordinary letters. The model has one piece for each rank, scored by the negative rank; its
normaliser is the identity. Merging the best-scored pair first is then merging the pair of least
rank first. A text is cut by the tokenizer's pattern, each match is encoded by itself, and ids
are decoded by the inverse mapping of their pieces.

Defined results: a null or empty text has no tokens and decodes to nothing; equal texts have equal
ids; special tokens are never produced, their spelling in a text is ordinary text.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Distinct pre-tokens and chunks, and their characters, that a task remembers before it starts anew.
CACHE_ENTRIES, CACHE_CHARS = 800_000, 20_000_000
FIRST = 0x100
TO_LETTERS = {b: FIRST + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64 and rank in each line), in order of rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks of {path} are not 0 to {len(ranks) - 1}")
    if missing := {bytes([b]) for b in range(256)} - set(ranks.values()):
        raise ValueError(f"{len(missing)} single bytes have no rank in {path}")
    return [ranks[i] for i in range(len(ranks))]


def letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_LETTERS)


def unlettered(piece: str) -> bytes:
    return bytes(ord(c) - FIRST for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message: bytes, an integer or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


# Field numbers and enum values of the public sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND, KIND_UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, MODEL_TYPE_BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NORM_NAME, NORM_DUMMY_PREFIX, NORM_EXTRA_SPACES, NORM_ESCAPE_SPACES = 1, 3, 4, 5


def serialized_model(ranks: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i is ``ranks[i]`` with score -i; the unknown piece, which no text yields, comes last."""
    pieces = [_field(PIECES, _field(PIECE, letters(raw).encode()) + _field(SCORE, -float(i))) for i, raw in enumerate(ranks)]
    unknown = _field(PIECES, _field(PIECE, b"<unk>") + _field(SCORE, 0.0) + _field(KIND, KIND_UNKNOWN))
    trainer = b"".join(_field(k, v) for k, v in ((MODEL_TYPE, MODEL_TYPE_BPE), (VOCAB_SIZE, len(ranks) + 1), (UNK_ID, len(ranks)), (BOS_ID, -1), (EOS_ID, -1), (PAD_ID, -1)))
    normalizer = _field(NORM_NAME, b"identity") + b"".join(_field(k, 0) for k in (NORM_DUMMY_PREFIX, NORM_EXTRA_SPACES, NORM_ESCAPE_SPACES))
    return b"".join(pieces) + unknown + _field(TRAINER, trainer) + _field(NORMALIZER, normalizer)


#: Fixed value: the pattern after which a lone space between two other characters always begins a match, so that a text may be cut there first.
SPACE_FIRST_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space beside other white space; a text with one is cut by the pattern alone.
BESIDE_SPACE = re.compile(r" \s|[^\S ] |[\x00\x1c-\x1f\x85]")


class _Codec:
    """Of a worker: the model, the pattern, and what they gave for the pre-tokens and the chunks that its task has met so far."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_id = [unlettered(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size() - 1)]
        self.cut = regex.compile(pattern).findall
        self.space_first = pattern == SPACE_FIRST_PATTERN
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        """Let go of what was learnt: Spark keeps a worker after its task, beside whatever runs next."""
        self.words, self.chunks, self.held = {}, {}, 0

    def split(self, text: str) -> list[str]:
        """Chunks, each of which the pattern cuts as it does within the text."""
        if not self.space_first or BESIDE_SPACE.search(text):
            return self.cut(text)
        return text.replace(" ", "\0 ").split("\0")

    def learn(self, chunks: list[str]) -> None:
        cuts = [self.cut(c) for c in chunks]
        new = list(set().union(*cuts).difference(self.words))
        for word, ids in zip(new, self.model.encode([letters(w.encode()) for w in new], out_type=int, num_threads=1) if new else [], strict=True):
            self.words[word] = array("I", ids).tobytes()
        for chunk, words in zip(chunks, cuts, strict=True):
            self.chunks[chunk] = b"".join(map(self.words.__getitem__, words))
        self.held += sum(map(len, new)) + sum(map(len, chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        distinct = set().union(*split)
        if len(self.words) + len(self.chunks) > CACHE_ENTRIES or self.held > CACHE_CHARS:  # what is in use now stays
            self.chunks = {c: self.chunks[c] for c in distinct & self.chunks.keys()}
            self.words.clear()
            self.held = sum(map(len, self.chunks))
        if new := list(distinct.difference(self.chunks)):
            self.learn(new)
        return [b"".join(map(self.chunks.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def _codec(model: bytes, pattern: str) -> _Codec:
    return _Codec(model, pattern)


def encode_texts(texts: list[str], model: bytes, pattern: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers; what is new in all of them is encoded at once."""
    return _codec(model, pattern).encode(texts)


def decode_ids(ids: bytes, model: bytes, pattern: str) -> bytes:
    """The bytes that packed ids stand for."""
    return _codec(model, pattern).decode(ids)


def _encoder(model: bytes, pattern: str) -> Callable[[pa.Array], list[pa.Array]]:
    def work(texts: pa.Array) -> list[pa.Array]:
        ids = encode_texts([t or "" for t in texts.to_pylist()], model, pattern)
        decoded = [decode_ids(x, model, pattern) for x in ids]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]

    return work


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_tokens, token_ids (packed little-endian unsigned 32-bit) and decoded (the bytes that the ids give back).

    The rank file is read on the driver; workers get the serialised model (about 1 MB) with the
    task, so no file is needed on them. One narrow stage, no shuffle; a worker holds one slice of
    texts and what it remembers (CACHE_ENTRIES), until its task ends."""
    model = serialized_model(read_ranks(rank_file))
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return map_texts(docs, text_col, list(keep), added, _encoder(model, pattern), limit=4 << 20, after=lambda: _codec(model, pattern).forget())
