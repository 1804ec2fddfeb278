import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from harness import connect, differences

from docloom.llm import queries, stratified_search
from docloom.llm.stratified_search import Queries, Weighted

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    held = [c for c in counts if c]
    total, length, df = len(held), sum(sum(c.values()) for c in held), Counter(t for c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c in zip(docs, counts, strict=True):
            n = sum(c.values())
            m = 75 + 25 * n * total // length if n else 0
            score = 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def collection(seed, rows, words=60):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.9)) % words}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 3, 8, 40])))) for i in range(rows)]
    docs += [(rows + i, docs[5][1]) for i in range(rows // 3)]  # copies: one stratum with a third of all rows
    items = [(f"q{i}", " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(25)]
    return docs, items


def found(spark, docs, items, k, **columns):
    out = stratified_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"), k, **columns)
    assert [f.simpleString() for f in out.schema] == ["item_id:string", "rank:int", "doc_id:bigint", "score:bigint"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize(("k", "block", "probes"), [(20, 4096, 8), (3, 16, 2), (1, 5, 1)])
def test_hits_as_brute_force_finds_them_also_over_many_blocks_of_a_stratum(spark, monkeypatch, k, block, probes):
    monkeypatch.setattr(stratified_search, "BLOCK", block)
    monkeypatch.setattr(stratified_search, "PROBES", probes)
    docs, items = collection(k, 400)
    assert found(spark, docs, items, k) == brute(docs, items, k)


def test_query_against_its_sql(spark, small):
    assert differences(queries.op11_stratified_search(spark, small), connect(small), queries.OP11_SQL) is None


def test_queries_in_turn_give_what_they_give_at_once(spark, monkeypatch):
    docs, items = collection(7, 90)
    monkeypatch.setattr(stratified_search, "CELLS", 60)
    assert len(list(Queries.in_turn(iter(items)))) > 2
    assert found(spark, docs, items, 5) == brute(docs, items, 5)


def test_nulls_ties_repeated_and_empty_rows_other_letters_and_clashing_columns(spark):
    docs = [(4, "Straße ÄPFEL 中文 a_b"), (2, "straße Äpfel"), (9, None), (8, ""), (7, "?!"), (None, "apfel rot"), (3, "apfel rot"), (3, "apfel rot"), (1, "rot " * 40_000 + "apfel"), (6, "x\x00y {z}")]
    items = [("a", "STRAßE, ÄPFEL"), ("a", "apfel apfel"), ("b", None), ("c", "..."), (None, "rot Y z"), ("d", "中文 b")]
    assert found(spark, docs, items, 20) == brute(docs, items, 20)
    other = spark.createDataFrame(docs, "id long, body string").selectExpr("*", "1 as row", "2 as m", "3 as doc_id", "4 as score", "5 as n")
    out = stratified_search.search(other, spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 as rank", "2 as query"), 20, id_col="id", text_col="body")
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs, items, 20)
    assert found(spark, [], items, 20) == [] and found(spark, docs, [], 20) == [] and found(spark, [(1, None)], items, 20) == []


def test_bounds_are_reached_by_no_more_than_they_say_and_blocks_below_the_floor_are_not_visited(spark, monkeypatch, tmp_path):
    docs, items = collection(11, 300)
    asked = Queries.of(items)
    rows = stratified_search.counted(spark.createDataFrame(docs, "doc_id long, text string"), asked.terms, "doc_id", "text").selectExpr("*", "doc_id as row")
    n, length = rows.where("n > 0").selectExpr("count(*)", "sum(n)").first()
    df = np.array([sum(t in r.term for r in rows.collect()) for t in range(len(asked.terms))])
    weighted = Weighted.of(asked, stratified_search.weight(df, n))
    stratified_search.index(rows, n, length).coalesce(1).write.parquet(str(tmp_path / "blocks"))
    batch = spark.read.parquet(str(tmp_path / "blocks")).toArrow().combine_chunks().to_batches()[0]
    blocks = [stratified_search._Block(batch, i) for i in range(batch.num_rows)]
    strata = {m for m in batch.column("m").to_pylist()}
    assert len(blocks) >= len(strata) >= 4
    visits = 0
    for block in blocks:
        bounds = block.bounds(weighted)
        scores = np.array([block.scores(weighted, q) for q in range(len(items))])
        assert (scores.max(axis=1) <= bounds).all()
        visits += scores.size
    seen = []
    monkeypatch.setattr(stratified_search._Block, "scores", lambda self, queries, q, own=stratified_search._Block.scores: seen.append(q) or own(self, queries, q))

    class Shared:
        value = weighted

    best = [sorted((s for b in blocks for s in b.scores(weighted, q).tolist() if s > 0), reverse=True) for q in range(len(items))]
    floor = np.array([b[1] if len(b) > 1 else 0 for b in best])
    seen.clear()
    list(stratified_search._visiting(Shared, 2, floor)(iter([batch])))
    assert 0 < len(seen) < len(items) * len(blocks)
