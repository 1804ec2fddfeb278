"""The quality classifier and the language identification held against plain Python, number by number."""

import math
import random
import re

import numpy as np
import pytest

from docloom.llm import language_id, queries, rule_ensemble
from docloom.llm.common import held_out


def plain_statistics(text):
    t = text or ""
    chars = max(len(t), 1)
    words = re.split(" +", re.sub(r"[\n\t\r]", " ", t).strip(" "))
    lines = t.split("\n")
    share = lambda pattern: len(re.findall(pattern, t)) / chars
    return {
        "chars": float(len(t)),
        "words": float(len(words)),
        "word_length": chars / len(words),
        "distinct_words": len(set(words)) / len(words),
        "richness": math.log(len(set(words)) + 1) / math.log(len(words) + 1),
        "line_length": chars / len(lines),
        "distinct_lines": len(set(lines)) / len(lines),
        "upper": share("[A-Z]"),
        "digits": share("[0-9]"),
        "symbols": share(r"[#$%&*+/<=>@\\^_`{|}~\[\]]"),
        "marks": share("[!?]"),
        "stops": share("[.,;:]"),
        "spaces": share("[ \t\n\x0b\f\r]"),
    }


def plain_score(model, text):
    s = plain_statistics(text)
    margin = model.intercept + sum(w for rule, w in model.rules if all(low < s[name] <= high for name, low, high in rule))
    return 1 / (1 + math.exp(-margin))


def test_quality_scores_by_hand(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = rule_ensemble.fit(docs, labels)
    assert len(model.rules) > 5 and all(weight for _, weight in model.rules)
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\t"), (-4, "É ü\x0b!?[x] {y}  1,2;3"), (-5, "a" * 100_000)], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").unionAll(more).collect()}
    got = rule_ensemble.score(docs.select("doc_id", "text").unionAll(more), model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]), abs=1e-9) and r.predicted == (r.score >= 0.5)
    query = {r.doc_id: (r.score, r.predicted) for r in queries.op1_rule_ensemble(spark, small).collect()}
    assert all(query[r.doc_id] == (r.score, r.predicted) for r in got if r.doc_id >= 0)


def plain_counts(text):
    counts, codes, mask = {}, [ord(c) for c in text.lower()], 0xFFFFFFFF
    for size in (1, 2, 3):
        for i in range(len(codes) - size + 1):
            h = 0
            for k, code in enumerate(codes[i : i + size]):
                h = ((h ^ code) * int(language_id.ODD[k])) & mask
                h ^= h >> 15
            bucket = (h * int(language_id.ODD[2]) & mask) >> (32 - (language_id.BUCKETS.bit_length() - 1))
            counts[bucket] = counts.get(bucket, 0) + 1
    return counts


def test_grams_are_counted_as_by_hand():
    texts = ["", "a", "Abc abc", "Straße ÄÖÜ 中文 😀😀", "x" * 500, "a\nb\tc"]
    for text, row in zip(texts, language_id.gram_counts(texts), strict=True):
        assert {int(b): int(row[b]) for b in np.flatnonzero(row)} == plain_counts(text)


def test_the_leader_is_followed_as_by_hand(monkeypatch):
    monkeypatch.setattr(language_id, "BUCKETS", 12)
    rng = random.Random(2)
    rows = []
    for _ in range(40):
        at = sorted(rng.sample(range(12), rng.randint(1, 5)))
        rows.append((rng.randrange(3), np.array([*at, 12]), np.array([rng.random() for _ in at] + [1.0])))
    z, n = {}, {}

    def weight(i, c):
        value = z.get((i, c), 0.0)
        if abs(value) <= language_id.L1:
            return 0.0
        return -math.copysign(abs(value) - language_id.L1, value) / ((language_id.BETA + math.sqrt(n.get((i, c), 0.0))) / language_id.ALPHA + language_id.L2)

    for _ in range(language_id.EPOCHS):
        for label, at, x in rows:
            w = {(i, c): weight(i, c) for i in at.tolist() for c in range(3)}
            margins = [sum(v * w[i, c] for i, v in zip(at.tolist(), x, strict=True)) for c in range(3)]
            total = sum(math.exp(m) for m in margins)
            for c in range(3):
                p = math.exp(margins[c]) / total - (c == label)
                for i, v in zip(at.tolist(), x, strict=True):
                    g, before = v * p, n.get((i, c), 0.0)
                    n[i, c] = before + g * g
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(n[i, c]) - math.sqrt(before)) / language_id.ALPHA * w[i, c]
    got = language_id.follow_the_leader(rows, 3)
    assert got == pytest.approx(np.array([[weight(i, c) for c in range(3)] for i in range(13)]), abs=1e-9)


def test_the_temperature_is_the_one_of_least_loss():
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 3, 400)
    margins = rng.normal(size=(400, 3)) + 1.5 * np.eye(3)[labels]
    loss = lambda t: -sum(math.log(math.exp(m[k] / t) / sum(math.exp(v / t) for v in m)) for m, k in zip(margins, labels, strict=True)) / 400
    best = language_id.temperature(margins, labels)
    assert all(loss(best) <= loss(best * f) + 1e-9 for f in (0.5, 0.9, 1.1, 2.0))


def test_predictions_by_hand(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs)
    taught = docs.where(~held_out("doc_id") & docs.lang.isNotNull() & docs.text.isNotNull()).select("text").collect()
    seen = {}
    for r in taught:
        for b in plain_counts(r.text):
            seen[b] = seen.get(b, 0) + 1
    idf = [math.log((1 + len(taught)) / (1 + seen.get(b, 0))) + 1 for b in range(language_id.BUCKETS)]
    assert model.idf == pytest.approx(np.array(idf), abs=1e-9)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op4_language_id(spark, small).collect()}
    for r in docs.select("doc_id", "text").orderBy("doc_id").limit(40).collect():
        x = {b: c * idf[b] for b, c in plain_counts(r.text or "").items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1e-12
        z = [(sum(v / norm * model.weights[b, k] for b, v in x.items()) + model.weights[-1, k]) / model.temperature for k in range(len(model.languages))]
        p = [math.exp(v - max(z)) / sum(math.exp(u - max(z)) for u in z) for v in z]
        if any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id] == (model.languages[p.index(max(p))], pytest.approx(max(p), abs=1e-9))
        else:
            assert got[r.doc_id] == ("und", 0.0)
