import numpy as np
from pyspark.sql import functions as F

from docloom.llm import multi_index, queries


def brute(rows, least=0.9):
    """{row: (links, least id reachable)}"""
    sound = [i for i, (_, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    lengths = np.array([len(rows[i][1]) for i in sound], dtype=int)
    x = np.zeros((len(sound), int(lengths.max(initial=0))))  # zeros behind a vector change no cosine among those of its length
    for k, i in enumerate(sound):
        x[k, : lengths[k]] = np.array(rows[i][1], dtype=np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = (x @ x.T >= least) & (lengths[:, None] == lengths)
    out = {i: (0, rows[i][0]) for i in range(len(rows))}
    root = list(range(len(sound)))
    changed = True
    while changed:
        new = [min(root[j] for j in np.flatnonzero(hit[i])) for i in range(len(sound))]
        changed, root = new != root, new
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(rows[sound[k]][0])
    for k, i in enumerate(sound):
        out[i] = (int(hit[k].sum()) - 1, min((d for d in groups[root[k]] if d is not None), default=None))
    return sorted(((rows[i][0], *out[i]) for i in range(len(rows))), key=str)


def sample(seed, families, size):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(families):
        centre = rng.normal(size=8)
        rows += [(len(rows) + k, (centre + rng.normal(scale=rng.choice([0.02, 0.2, 0.4]), size=8)).astype(np.float32).tolist()) for k in range(rng.integers(1, size))]
    return rows


def linked(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit(1)).repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in multi_index.link(df).collect()), key=str)


def test_as_brute_force(spark):
    rows = sample(1, 60, 12)
    assert linked(spark, rows) == brute(rows)


def test_cut_cells_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 7)
    rows = sample(2, 4, 80)
    assert linked(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    v = [float(x) for x in range(1, 9)]
    rows = [(1, v), (1, v), (2, [2 * x for x in v]), (3, None), (4, [0.0] * 8), (5, [float("nan"), *v[1:]]), (6, [None, *v[1:]]), (7, v[:3]), (8, [float("inf"), *v[1:]]), (None, v), (9, [-x for x in v])]
    assert linked(spark, rows) == brute(rows)
    assert linked(spark, rows[3:6]) == brute(rows[3:6]) and linked(spark, rows[:1]) == brute(rows[:1])
    assert linked(spark, []) == []


def test_vectors_of_each_length_link_among_themselves(spark):
    mixed = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.1]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.1, 3.0]), (6, [3.0, -1.0, 0.5]), (7, [5.0]), (8, [7.0]), (9, [-2.0]), (10, None), (11, [0.0]), (12, [])]
    assert linked(spark, mixed) == brute(mixed)
    assert linked(spark, mixed[6:9]) == [(7, 1, 7), (8, 1, 7), (9, 0, 9)]


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(0)
    grid = multi_index.Grid(rng.normal(size=(300, 8)), 9)
    x = rng.normal(size=(20, 8))
    whole = multi_index.distances(x[:, :4], grid.words[0])[:, :, None] + multi_index.distances(x[:, 4:], grid.words[1])[:, None, :]
    nearest = np.argsort(whole.reshape(20, -1), axis=1, kind="stable")[:, :30]
    assert (grid.visits(x, 30) == nearest).all()


def test_query_and_recall(spark, small):
    vectors = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/embeddings.parquet")
    out = queries.op7_multi_index(spark, small.replace("sf0.001", "sf0.01"))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == vectors.count()
    near = vectors.unionAll(vectors.select((F.col("vec_id") + 100_000).alias("vec_id"), F.transform("embedding", lambda x: (x * 1.01 + 0.002).cast("float")).alias("embedding"), "label")).select("vec_id", "embedding")
    assert multi_index.recall(near, multi_index.link(near)) >= 0.9


def test_calibration_is_not_outweighed_by_a_hot_group(spark):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    hot = unit(rng.normal(size=16)) + rng.normal(scale=0.02, size=(2500, 16))
    x = unit(rng.normal(size=(2500, 16)))
    across = rng.normal(size=x.shape)
    across = unit(across - (across * x).sum(axis=1, keepdims=True) * x)
    rows = np.concatenate((hot, x, 0.91 * x + np.sqrt(1 - 0.91**2) * across)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(4)
    found = {r.vec_id: r.n_links for r in multi_index.link(df).collect()}
    own = unit(rows.astype(float))
    true = (own @ own.T >= 0.9).sum(axis=1) - 1
    pairs = range(2500, len(rows))
    assert all(found[i] <= true[i] for i in found)
    assert sum(found[i] for i in pairs) >= 0.98 * sum(true[i] for i in pairs)
    assert sum(found[i] for i in range(2500)) >= 0.98 * sum(true[:2500])


def test_visits_go_on_while_the_target_is_not_met(spark):
    met = np.array([[9, 0, 1], [1, 0, 0]])
    assert multi_index._enough(met, np.array([0, 1])) is None and multi_index._enough(met[1:], np.array([0])) == 0


def test_guests_of_a_cell_are_cut_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "PARTY", 16, raising=False)
    meet = multi_index._meet

    def spy(kind, least):
        run, add = meet(kind, least), most.add

        def wrapped(batches):
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "guests")), strict=True))
                guests = [k for k, m in zip(keys, batch.column("member").to_pylist(), strict=True) if m != 2]
                add(max((guests.count(k) for k in set(guests)), default=0))
                yield from run(iter([batch]))

        return wrapped

    most = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(multi_index, "_meet", spy)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=8)
    rows = [(i, (centre + rng.normal(scale=0.02, size=8)).astype(np.float32).tolist()) for i in range(300)] + [(1000 + i, v) for i, v in sample(7, 40, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in multi_index.link(df).collect()), key=str)
    assert got == brute(rows)
    assert 0 < most.value <= 4 * 40  # four partitions, each with parties of about 16 rows
