import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import ngram_join, queries
from docloom.llm.components import components


def word_set(text, size):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute(rows, size, num, den):
    """{row number: (set size, least id reachable)}"""
    sets = [word_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)):
                shared = len(a & b)
                if den * shared >= num * (len(a) + len(b) - shared):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def joined(spark, rows, size, num, den):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, component_id int").repartition(3)
    out = ngram_join.join(df, shingle=size, num=num, den=den)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


def families(seed, groups, copies, length):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length())]
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_same_links_as_brute_force(spark):
    rng = random.Random(5)
    rows = families(1, 30, 9, lambda: rng.choice([3, 8, 11, 14, 25, 60, 150, 400]))
    for size, num, den in ((3, 90, 100), (5, 80, 100)):
        assert joined(spark, rows, size, num, den) == brute(rows, size, num, den)


def test_edges_nulls_and_repeats(spark):
    text = "a b c d e f g h i j k l"
    rows = [(5, None), (6, ""), (7, " \t\n "), (1, "one"), (2, "One"), (3, "one two"), (4, text), (4, text), (None, text), (9, text.upper()), (8, "É"), (10, "é")]
    assert joined(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)
    assert joined(spark, [], 3, 90, 100) == []
    assert joined(spark, [(1, None)], 3, 90, 100) == [(1, 0, 1)]


def test_a_very_long_text_and_its_copy(spark):
    rng = random.Random(2)
    words = [f"x{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:1000], "other", *words[1000:]])), (3, "x")]
    assert [c for _, _, c in joined(spark, rows, 3, 90, 100)] == [1, 1, 3]


def test_large_tiles_are_cut_without_losing_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 4)
    rows = families(3, 6, 30, lambda: 40)
    assert joined(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def shares(a, b, at):
    """Whether two sets share a tile, and the early tiles of its class that both are in are tiles that they share."""
    for x in ngram_join.tile_keys(a, at):
        for y in ngram_join.tile_keys(b, at):
            if shared := set(x.tolist()) & set(y.tolist()):
                assert len({k & 1 for k in [*x.tolist(), *y.tolist()]}) == 1
                return shared
    return set()


def test_every_linked_pair_shares_a_tile():
    rng = np.random.default_rng(4)
    for num, den in ((90, 100), (80, 100)):
        at = ngram_join.Threshold(num, den)
        for n in [*range(1, 40), 100, 333, 1000]:
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for drop in range(0, n // 3 + 1, max(1, n // 50)):
                for add in (0, drop // 2, drop):
                    b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
                    if len(b) and at.linked(len(np.intersect1d(a, b)), len(a), len(b)) and drop + add:
                        assert shares(a, b, at), (n, drop, add)


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(0)
    for rows in (2, 31, 33, 500, 1100):
        values = rng.integers(0, 6, (rows, ngram_join.GROUPS)).astype(np.uint32)
        half = rows // 2
        values[half : 2 * half] = values[:half] + (rng.random((half, ngram_join.GROUPS)) < 0.1)
        sizes, at = values.sum(axis=1).astype(np.int64), ngram_join.Threshold(90, 100)
        got = [p for x, y in ngram_join.CountTree(values, sizes).join(lambda x, y: (x + y) % 3 > 0, at) for p in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)]
        want = set()
        for q in range(rows):
            bound = np.minimum(values, values[q]).sum(axis=1)
            want.update((q, int(r)) for r in np.flatnonzero(bound >= at.least_overlap(sizes + sizes[q])) if r > q and (q + r) % 3)
        assert len(got) == len(set(got)) and set(got) == want and want


def test_points_are_packed_without_loss():
    for most in (3, 300, 70_000):
        counts = np.arange(64) % 7 * most // 6
        assert (ngram_join.unpack_point(ngram_join.pack_point(counts)) == counts).all()


def test_points_of_any_resolution_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n, m in ((40, 55), (3000, 4500), (500, 260), (0, 5)):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**64, max(0, m - n // 2), dtype=np.uint64))))
        x, y = ngram_join.unpack_points([ngram_join.pack_point(ngram_join.point(s)) for s in (a, b)])
        assert len(np.intersect1d(a, b)) <= np.minimum(x, y).sum() and (x.sum(), y.sum()) == (len(a), len(b))


def test_words_of_a_slice():
    texts = pa.array(["Ab ab", None, "", "x\x0by z", "ab"])
    words, first = ngram_join.word_hashes(*ngram_join.utf8(texts))
    assert first.tolist() == [0, 2, 2, 2, 4, 5] and words[0] == words[1] == words[4] and len(set(words)) == 3


def test_components_of_a_chain_and_a_star(spark):
    links = spark.range(60).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    links = links.unionAll(spark.range(101, 200).select("id", F.lit(100).cast("long")))
    links = links.unionAll(spark.sql("select cast(null as bigint), 7L union all select 500L, 500L"))
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 200), 100)}


def test_query_on_its_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op9_ngram_join(spark, small).collect()), key=str)
    assert got == brute(docs, 3, 90, 100)


def test_leaves_give_the_pairs_of_their_trees():
    rng, at = np.random.default_rng(6), ngram_join.Threshold(80, 100)
    tiles, rows = 12, 7
    sets = []
    for _ in range(tiles):
        base = rng.integers(0, 2**64, int(rng.choice([20, 300, 900])), dtype=np.uint64)
        for drop in rng.choice([0, 0.05, 0.15, 0.4], rows):
            sets.append(np.unique(np.concatenate((base[int(drop * len(base)) :], rng.integers(0, 2**64, int(drop * len(base)), dtype=np.uint64)))))
    packed = [ngram_join.pack_point(ngram_join.folded(p, min(ngram_join.GROUPS, len(p)))) for p in map(ngram_join.point, sets)]
    ids, labels, sizes = rng.permutation(len(sets)), rng.integers(0, 30, len(sets)), np.array([len(s) for s in sets])
    starts, matrices = np.arange(0, len(sets), rows), ngram_join.unpack_matrices(pa.array(packed, pa.binary()))
    early = np.zeros((len(sets), ngram_join.EARLY), np.int64)
    for apart, side in ((False, np.zeros(len(sets), int)), (True, np.arange(len(sets)) % 2)):
        want = set()
        for a in starts:
            t = slice(a, a + rows)
            want.update(map(tuple, ngram_join.tile_pairs(0, ids[t], labels[t], sizes[t], ngram_join.unpack_points(packed[t]), early[t], side[t], at).tolist()))
        got = ngram_join.leaf_pairs(starts, rows, np.zeros(len(sets), int), ids, labels, sizes, early, np.full(len(sets), apart), side, matrices, at)
        assert want and set(map(tuple, got.tolist())) == want


def test_a_pair_is_told_by_one_of_its_early_tiles():
    rng = np.random.default_rng(8)
    early = rng.integers(0, 3, (40, ngram_join.EARLY)) * (1 + np.arange(ngram_join.EARLY))
    for x in range(40):
        for y in range(x):
            shared = [int(k) for k, other in zip(early[x], early[y], strict=True) if k and k == other]
            tiles = np.unique([*shared, 99])
            told = ngram_join.told_here(tiles, *(np.broadcast_to(early[k], (len(tiles), ngram_join.EARLY)) for k in (x, y)))
            assert tiles[told].tolist() == (shared[:1] or [99])


def test_ids_that_are_missing_or_repeat(spark):
    rng = random.Random(4)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    near = [[*base[:k], "changed", *base[k + 1 :]] for k in (3, 60, 100)]
    rows = [(None, " ".join(base)), (None, " ".join(base)), (7, " ".join(near[0])), (7, "quite another text of its own"), (None, " ".join(near[1])), (5, " ".join(near[2])), (5, " ".join(near[2]))]
    got = joined(spark, rows, 5, 80, 100)
    assert got == brute(rows, 5, 80, 100) and (7, 116, 5) in got and sum(c == 5 for _, _, c in got) == 6
    alone = joined(spark, [(None, "a b c"), (None, "a b c"), (3, "d e f")], 3, 90, 100)
    assert alone == [(3, 1, 3), (None, 1, None), (None, 1, None)]
