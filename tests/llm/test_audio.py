import hashlib
import zlib

import numpy as np
import pyarrow as pa

from docloom.llm import audio, queries


def expand_mulaw(code):
    code = ~code & 0xFF
    value = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return 0x84 - value if code & 0x80 else value - 0x84


def expand_alaw(code):
    code ^= 0x55
    value, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    value = value + 8 if segment == 0 else (value + 0x108) << (segment - 1)
    return value if code & 0x80 else -value


def adpcm_block(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.ADPCM_STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value + (-move if code & 8 else move)))
            index = max(0, min(88, index + int(audio.INDEX_MOVES[code])))
            out.append(value)
    return out


def test_tables():
    assert audio.MULAW.tolist() == [expand_mulaw(c) for c in range(256)] and audio.ALAW.tolist() == [expand_alaw(c) for c in range(256)]


def test_blocks_together_as_one_by_one():
    payload = np.random.default_rng(1).integers(0, 256, 64 * 9).astype(np.uint8)
    assert audio.decode_adpcm(payload).tolist() == [adpcm_block(bytes(b)) for b in payload.reshape(-1, 64)]


def test_resampling_keeps_rows_apart():
    rng = np.random.default_rng(2)
    pcm, offsets = rng.integers(-30000, 30000, 320).astype(np.int16), np.array([0, 64, 128, 320])
    for up, down in ((2, 1), (3, 2), (1, 2), (441, 80)):
        got, ends = audio.resample(pcm, offsets, up, down)
        want = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            row = pcm[a:b].astype(int)
            want += [int(row[k * down // up] + (row[min(k * down // up + 1, len(row) - 1)] - row[k * down // up]) * (k * down % up) // up) for k in range(len(row) * up // down)]
        assert got.tolist() == want and ends[-1] == len(want)


def test_stored_bytes_come_back():
    texts = ["", "a" * 64, "é" * 33, None]
    for text, media in zip(texts, audio.store(pa.array(texts)), strict=True):
        raw = (text or "").encode()
        payload, n = audio.read_wav(media)
        assert n == len(raw) and bytes(payload) == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def test_query_and_edges(spark, small, tmp_path):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    seen = {}
    for r in queries.op2_media_columns(spark, small).collect():
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 58 and r.pcm_bytes == 4 * len(payload)
        assert seen.setdefault(raw, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)
    edge = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x" * 300_000)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, len(r.payload), len(r.pcm)) for r in audio.encode(edge, rate=8000).collect())
    assert got == [("1", 0, 64, 128), ("2", 0, 64, 128), ("2", 0, 64, 128), ("None", 300_000, 300_032, 600_064)]
    assert audio.encode(edge.limit(0)).count() == 0
