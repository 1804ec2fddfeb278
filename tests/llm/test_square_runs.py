import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row

from docloom.llm import queries, square_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, exponent=4, least=6):
    """Every stretch at every distance; the least period of equal stretches counts."""
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, planted=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *one, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def stream(seed):
    rng, docs = random.Random(seed), []
    for _ in range(rng.randint(1, 6)):
        n, letters = rng.randint(0, 150), rng.choice([1, 2, 3, 12])
        words = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        docs.append(words)
    return docs


@pytest.mark.parametrize("step", [3, 17, 1 << 20])
@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_of_streams_as_brute_force_finds_them(monkeypatch, step, exponent):
    monkeypatch.setattr(square_runs, "STEP", step)
    for seed in range(120):
        docs = stream(seed)
        bounds = np.cumsum([0, *map(len, docs)])
        document, runs = square_runs.find_runs(np.array([w for d in docs for w in d], np.int64), bounds, exponent, 6)
        got = [[] for _ in docs]
        for k, run in zip(document.tolist(), zip(*runs.tolist(), strict=True), strict=True):
            got[k].append(run)
        assert got == [brute(d, exponent) for d in docs]


def test_words_without_squares_and_words_that_are_all_alike():
    square_free, n = "a", 0
    while len(square_free) < 4000:  # a word without squares, by a substitution
        square_free = "".join({"a": "abc", "b": "ac", "c": "b"}[c] for c in square_free)
    words = np.frombuffer(square_free.encode(), np.uint8).astype(np.int64)
    assert square_runs.find_runs(words, np.array([0, len(words)]), 2, 2)[1].shape[1] == n
    thue_morse = np.array([bin(i).count("1") % 2 for i in range(1 << 14)], np.int64)
    assert square_runs.find_runs(thue_morse, np.array([0, 1 << 14]), 3, 2)[1].shape[1] == 0
    assert square_runs.find_runs(np.zeros(200_000, np.int64), np.array([0, 200_000]))[1].T.tolist() == [[0, 200_000, 1]]
    with pytest.raises(ValueError, match="square"):
        square_runs.Catchers(8, 1)


def test_query_as_brute_force(spark, small):
    got = sorted(tuple(r) for r in queries.op13_square_runs(spark, small).collect())
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) >= 10


def test_nulls_empty_and_long_texts_repeated_rows_and_clashing_columns(spark):
    tied = "x y x y x y x y | p q p q p q p q"
    texts = [None, "", " \t\n", "a a a a a a", "a a a a a", "A a A a A a", tied, "é\x1cb " * 9, "long " + "one two three " * 500, "é　é é　é é　é é　é é　é é　é"]
    rows = [Row(doc_id=i, text=t, runs=7, START=i) for i, t in enumerate(texts)] + [Row(doc_id=3, text=texts[3], runs=7, START=3), Row(doc_id=None, text=texts[3], runs=7, START=4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, START int")
    out = square_runs.runs_of(df, keep=("doc_id", "START", "runs")).collect()
    assert out[0].__fields__ == ["doc_id", "runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed"]
    got = sorted(((r.doc_id, len(r.runs), r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, hashlib.sha256(r.collapsed.encode()).hexdigest()) for r in out), key=str)
    assert got == sorted((expected(r.doc_id, r.text, planted=False) for r in rows), key=str)
    assert next(r for r in out if r.doc_id == 6).collapsed == "x y | p q"
    assert square_runs.runs_of(df.limit(0)).collect() == []
    long = square_runs.runs_of(spark.createDataFrame([(1, "head " + "one two three " * 200_000)], "doc_id long, text string")).first()
    assert (long.start, long.length, long.period, len(long.runs), long.collapsed) == (1, 600_000, 3, 1, "head one two three")


def test_planted_runs_end_in_a_repeated_period(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(400)] + [(None, "a b c")]
    planted = square_runs.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    changed = 0
    for r, (_, text) in zip(sorted(planted, key=lambda r: (r.doc_id is None, r.doc_id)), rows, strict=True):
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        words = text.split()
        if h % 10 or not words:
            assert r.text == text
            continue
        a, n = h // 10 % len(words), len(words)
        p = 1 + (n - a) // (3 + h // 10 % 8)
        assert r.text.split() == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        changed += 1
    assert changed > 20
