import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from docloom.llm import bpe, queries

RANKS = bpe.read_ranks(P.path(queries.RANK_FILE))
MODEL = bpe.serialized_model(RANKS)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={b: i for i, b in enumerate(RANKS)}, special_tokens={})
ODD = ["", " a", "a ", "a \nb", "a\n b", "a  b", "a   b", "a\t b \tc", "a  b", "\x1c b", "a \x85b", "x  y", " ", "it's a' b'll", "<|endoftext|>", "😀🇩🇪é", "▁x <unk> \x00 y", "a" * 5000, "1234567 12.5%", "аб 中文字"]


def test_as_tiktoken_does():
    for text, ids in zip(ODD, bpe.encode_texts(ODD, MODEL, P.PATTERN), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text), repr(text[:40])
        assert bpe.decode_ids(ids, MODEL, P.PATTERN) == text.encode()


def test_every_piece_is_its_own_token():
    codec = bpe._codec(MODEL, P.PATTERN)
    assert codec.model.encode([bpe.letters(r) for r in RANKS], out_type=int) == [[i] for i in range(len(RANKS))]


def test_memory_is_renewed_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    for texts in (["one two three"], ["two three four five six"], ["one two"]):
        assert [np.frombuffer(i, "<u4").tolist() for i in bpe.encode_texts(texts, MODEL, P.PATTERN)] == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_other_patterns():
    ids = bpe.encode_texts(["ab cd"], MODEL, r"\S|\s")[0]
    assert bpe.decode_ids(ids, MODEL, r"\S|\s") == b"ab cd" and len(ids) == 20


def test_ranks_have_to_be_whole(tmp_path):
    (tmp_path / "r").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "r"))


def test_query_and_edges(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op8_byte_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    edge = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (None, "x", 7)], "doc_id long, text string, n_tokens int")
    got = queries.tokens(edge, keep=("doc_id", "n_tokens")).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded) for r in got) == [("1", 0, b""), ("2", 0, b""), ("2", 0, b""), ("None", 1, b"x")]
    assert queries.tokens(edge.limit(0)).count() == 0


def test_a_worker_remembers_nothing_after_its_task(spark):
    import pyarrow as pa

    path, pattern = P.path(queries.RANK_FILE), P.PATTERN
    docs = spark.range(0, 400, 1, 8).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(id * 50, id * 50 + 49), k -> concat('word', k))) as text")
    assert bpe.encode(docs, path, pattern).where("n_tokens >= 50").count() == 400

    def held(batches):
        codec = bpe._codec(MODEL, pattern)
        yield pa.RecordBatch.from_arrays([pa.array([len(codec.words) + len(codec.chunks) + codec.held])], names=["held"])

    assert {r.held for r in spark.range(0, 8, 1, 8).mapInArrow(held, "held long").collect()} == {0}
