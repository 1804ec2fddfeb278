import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docloom.llm import bpe, packing, queries

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def encoder():
    with open(TOKENIZER, encoding="utf-8") as f:
        return packing._Encoder(f.read(), tuple(bpe.read_ranks(RANKS)))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def texts_of(seed, rows):
    rng = random.Random(seed)
    bits = ["a", "the", " ", "  ", "\n", "\t", " \n", "é", "\xa0", "中文", "'s", "123", "<|endoftext|>", "!!", "\x00", "\x1c", "\x85", "　", "word", "x" * 600, " y", "\r\n", "’", "🙂", "​", "﻿"]
    plain = ["a", "bc", "é", "w1", "a\nb", "\nq", "q\n", "中", "don't", "x" * 700, "", "🙂!"]
    mixed = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(rows)]
    return [None, "", " ", "x", *mixed, *(" ".join(rng.choice(plain) for _ in range(rng.randint(0, 12))) for _ in range(rows))]


def test_ids_as_the_tokenizer_gives_them(tokenizer, encoder):
    for seed in range(3):
        texts = texts_of(seed, 1500)
        ids, bounds = encoder.encode(pa.array(texts, pa.string()), 0)
        for k, text in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == ids_of(tokenizer, text), text
    for texts in ([], [None], [" "], ["a"], ["a b"], ["x" * 5000 + " y"]):
        assert encoder.encode(pa.array(texts, pa.string()), 0)[0].tolist() == [i for t in texts for i in ids_of(tokenizer, t)]


def laid_out(plan):
    """{sequence: [(offset, size)]} and {(length, rank): [(start, size)]} of a plan, row by row."""
    sequences, rests = defaultdict(list), defaultdict(list)
    for length, start, first, last, size, sequence, offset in plan.rows:
        for rank in range(first, last):
            sequences[sequence + rank - first].append((offset, size))
            rests[length, rank].append((start, size))
    return sequences, rests


HISTOGRAMS = {
    "even": np.random.default_rng(1).integers(0, 60, 1024),
    "few": np.random.default_rng(2).integers(0, 2, 1024) * (np.arange(1024) % 37 == 0),
    "one length": np.bincount([700] * 300, minlength=1024),
    "small ones": np.bincount([1] * 5000 + [1023] * 7, minlength=1024),
    "a third alike": np.bincount([300] * 4000 + np.random.default_rng(3).integers(1, 1024, 8000).tolist(), minlength=1024),
    "none": np.zeros(1024, np.int64),
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_a_plan_places_every_token_once_and_pads_nothing(name):
    histogram = HISTOGRAMS[name].astype(np.int64)
    histogram[0] = 0
    plan = packing.plan(histogram)
    sequences, rests = laid_out(plan)
    assert sorted(sequences) == list(range(plan.sequences))
    short = []
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        if at != 1024:
            short.append(at)
    assert all(s & (s - 1) == 0 for s in short) and len(set(short)) == len(short)
    for length in range(1, 1024):
        for rank in range(histogram[length]):
            at = 0
            for start, size in sorted(rests.pop((length, rank))):
                assert start == at
                at += size
            assert at == length
    assert not rests


def test_combinations_are_those_that_fill_the_window():
    lengths = [1, 2, 3, 5, 6, 7, 10]
    want = {tuple(sorted(c, reverse=True)) for a in lengths for b in [0, *lengths] for d in [0, *lengths] if sum(c := (a, b, d)) == 12}
    got = [tuple(c) for c in packing.combinations(lengths, 12).tolist()]
    assert set(got) == want and len(got) == len(want)


def test_least_squares_use_up_a_histogram_that_combinations_make():
    combos = packing.combinations(list(range(1, 64)), 64)
    rng = np.random.default_rng(5)
    x = np.where(rng.random(len(combos)) < 0.1, rng.integers(1, 500, len(combos)), 0)
    histogram = np.bincount(combos.ravel(), np.repeat(x, 3), 64).astype(np.int64)
    histogram[0] = 0
    counts = packing.repeat_counts(combos, histogram)
    used = np.bincount(combos.ravel(), np.repeat(counts, 3), 64)[1:]
    assert (counts >= 0).all() and np.abs(used - histogram[1:]).sum() < 0.01 * histogram.sum()
    whole = packing.rounded(combos, counts, histogram)
    left = histogram - np.bincount(combos.ravel(), np.repeat(whole, 3), 64).astype(np.int64)
    assert (left[1:] >= 0).all() and left[1:].sum() < 0.05 * histogram.sum()


def check(tokenizer, rows, pieces, window):
    """Every id of every row in one piece; sequences without gaps, full but for powers of two."""
    want, got, sequences = defaultdict(int), defaultdict(int), defaultdict(list)
    for doc, text in rows:
        want[doc] += len(ids_of(tokenizer, text))
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == want
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0


def test_query_over_its_table(spark, small, tokenizer):
    pieces = [r.asDict() for r in queries.op12_nnls_packing(spark, small).collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check(tokenizer, docs, pieces, 1024)
    ids = {d: ids_of(tokenizer, t) for d, t in docs}
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    assert sorted({p["sequence_id"] for p in pieces}) == list(range(max(p["sequence_id"] for p in pieces) + 1))


@pytest.mark.parametrize("few", [True, False])
def test_hot_lengths_nulls_repeated_rows_and_clashing_columns(spark, tokenizer, monkeypatch, few):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 10**6 if few else 0)
    rng = random.Random(4)
    rows = [(i, "one two three") for i in range(150)] + [(7, None), (7, None), (None, ""), (None, "a b"), (5000, "w " * 20_000)]
    rows += [(1000 + i, " ".join(rng.choice(["ab", "é", "x"]) for _ in range(rng.randint(0, 300)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as start", "doc_id as RANK", "1 as ids", "2 as lang").repartition(5)
    out = packing.pack(df, TOKENIZER, RANKS, window=64, keep=("doc_id", "start", "RANK", "lang"))
    assert out.columns == ["doc_id", "lang", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    pieces = [r.asDict() for r in out.collect()]
    check(tokenizer, rows, pieces, 64)
    own = b"".join(p["ids"] for p in sorted((p for p in pieces if p["doc_id"] == 5000), key=lambda p: p["start"]))
    assert np.frombuffer(own, "<u4").tolist() == ids_of(tokenizer, rows[154][1])
    assert packing.pack(df.limit(0), TOKENIZER, RANKS).collect() == []
