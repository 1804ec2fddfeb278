"""Telephony audio columns: companded samples, their expansion, ADPCM blocks and resampled PCM.

A payload is stored losslessly as the 8-bit mu-law samples of a WAV file (format 7, 8 kHz, mono);
the file's ``fact`` chunk holds the number of bytes before padding. What is read back from the
stored bytes is expanded by 256-entry tables (mu-law and A-law), and read as 64-byte IMA ADPCM
blocks that numpy decodes step by step across all blocks of a slice at once. The expansion is
resampled linearly and kept as 16-bit PCM.

Defined results: a null text counts as empty, and an empty payload is one block of zero bytes; equal
texts have equal media, PCM and features; the features are sums of integers, exact on any machine.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, packed, utf8

BLOCK = 64
RATE = 8_000
MULAW_FORMAT, ALAW_FORMAT = 7, 6
# Fixed values of the public IMA ADPCM format: how the step index moves by code, and the quantiser's steps.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
ADPCM_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
STEPS = len(ADPCM_STEPS)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: sign, three exponent and four mantissa bits, all inverted; bias 132."""
    code = ~np.arange(256) & 0xFF
    size = ((code & 0x0F) << 3) + 132 << (code >> 4 & 7)
    return np.where(code & 0x80, 132 - size, size - 132).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; the first two exponents share a step."""
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 0x0F) << 4) + 8
    size = np.where(exponent == 0, size, size + 256 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def wav_header(n_samples: int, n_bytes: int) -> bytes:
    """The bytes before the samples of a mu-law WAV file; ``n_bytes`` of the samples are not padding."""
    fmt = struct.pack("<HHIIHHH", MULAW_FORMAT, 1, RATE, RATE, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n_bytes) + b"data" + struct.pack("<I", n_samples)
    return b"RIFF" + struct.pack("<I", len(body) + n_samples) + body


def read_wav(media: bytes) -> tuple[memoryview, int]:
    """The samples of a stored file and how many of them are not padding."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, count, view = 12, None, memoryview(media)
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fact":
            count = struct.unpack_from("<I", media, at + 8)[0]
        if name == b"data":
            return view[at + 8 : at + 8 + size], size if count is None else count
        at += 8 + size + size % 2
    raise ValueError("the file has no data chunk")


def decode_adpcm(payload: np.ndarray) -> np.ndarray:
    """(blocks, samples) of the 64-byte IMA ADPCM blocks that a payload holds.

    A block: predictor (int16), step index (byte, held to 0-88), a spare byte, 60 bytes of codes, low
    half first. All blocks take each step together, so the work per step is a few vector operations."""
    blocks = payload.reshape(-1, BLOCK)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], STEPS - 1).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * codes.shape[0] + 1, len(blocks)), dtype=np.int16)
    out[0] = value
    for k in range(2 * codes.shape[0]):
        code = codes[k // 2] >> 4 if k % 2 else codes[k // 2] & 0x0F
        step = ADPCM_STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code], 0, STEPS - 1)
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, offsets: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row of ``pcm`` (bounded by offsets) at up/down times its rate, linearly between neighbours; the last sample is held."""
    sizes = np.diff(offsets)
    new = sizes * up // down
    ends = np.concatenate(([0], np.cumsum(new)))
    if down == 1 and up == 2:
        following = np.concatenate((pcm[1:], pcm[-1:]))
        last = offsets[1:][sizes > 0] - 1
        following[last] = pcm[last]
        out = np.empty(2 * len(pcm), dtype=np.int16)
        out[0::2] = pcm
        out[1::2] = pcm.astype(np.int32) + following >> 1
        return out, ends
    at = (np.arange(ends[-1]) - np.repeat(ends[:-1], new)) * down
    left, part = at // up, at % up
    start, final = np.repeat(offsets[:-1], new), np.repeat(offsets[1:] - 1, new)
    x0, x1 = pcm[start + left].astype(np.int64), pcm[np.minimum(start + left + 1, final)].astype(np.int64)
    return (x0 + (x1 - x0) * part // up).astype(np.int16), ends


def store(texts: pa.Array) -> list[bytes]:
    """The WAV file of each text's padded bytes."""
    data, offsets = utf8(texts)
    raw = data.tobytes()
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = max(BLOCK, -(-(b - a) // BLOCK) * BLOCK)
        out.append(b"".join((wav_header(n, b - a), raw[a:b], bytes(n - (b - a)))))
    return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, offsets[:-1])


def features(payload: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Of each payload: absolute sums and sign changes of both expansions, and absolute sum and peak of the ADPCM decoding."""
    columns = []
    for table in (MULAW, ALAW):
        pcm = table[payload]
        columns.append(sums(np.abs(pcm.astype(np.int32)).astype(np.int64), offsets))
        turns = np.concatenate((np.diff(np.signbit(pcm)), [False]))
        turns[offsets[1:] - 1] = False
        columns.append(sums(turns.astype(np.int64), offsets))
    blocks = np.abs(decode_adpcm(payload).astype(np.int32))
    columns.append(sums(blocks.sum(axis=1, dtype=np.int64), offsets // BLOCK))
    columns.append(np.maximum.reduceat(blocks.max(axis=1), (offsets // BLOCK)[:-1]))
    names = ("mulaw_abs", "mulaw_turns", "alaw_abs", "alaw_turns", "adpcm_abs", "adpcm_peak")
    return [";".join(f"{n}={v}" for n, v in zip(names, row, strict=True)) for row in zip(*(c.tolist() for c in columns), strict=True)]


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rate: int = 16_000) -> DataFrame:
    """``keep`` and media (the stored file), payload (its samples, read back), n_bytes, pcm (16-bit, at ``rate``) and feature.

    One narrow stage, no shuffle; a worker holds one slice of texts (SLICE_BYTES) and its decodings."""
    common = np.gcd(rate, RATE)
    up, down = int(rate // common), int(RATE // common)

    def work(texts: pa.Array) -> list[pa.Array]:
        media = store(texts)
        back = [read_wav(m) for m in media]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p, _ in back]))).astype(np.int64)
        payload = np.frombuffer(b"".join(p for p, _ in back), dtype=np.uint8)
        pcm, ends = resample(MULAW[payload], offsets, up, down)
        return [pa.array(media, pa.binary()), packed(payload, offsets), pa.array([n for _, n in back], pa.int64()), packed(pcm, ends), pa.array(features(payload, offsets), pa.string())]

    kinds = {"media": T.BinaryType(), "payload": T.BinaryType(), "n_bytes": T.LongType(), "pcm": T.BinaryType(), "feature": T.StringType()}
    return map_texts(docs, text_col, list(keep), [T.StructField(n, t) for n, t in kinds.items()], work, limit=4 << 20)
