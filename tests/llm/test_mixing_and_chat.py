import harness
import pytest
from pyspark.sql import functions as F

from docloom.llm import pfair_mixing, preference, queries


@pytest.mark.parametrize("weights", [[1, 1, 1], [0.5, 0.3, 0.15, 0.05], [1, 1000], [3.3, 2.1, 7.7, 0.4, 0.4]])
def test_less_than_a_block_from_the_share(weights):
    frame = 400
    shares = pfair_mixing.frame_shares(weights, frame)
    pattern = pfair_mixing.frame_pattern(shares, frame)
    assert sum(shares) == frame and sorted(s for p in pattern for s in p) == list(range(frame))
    for k, slots in zip(shares, pattern, strict=True):
        assert all(release <= s < deadline for s, (release, deadline) in zip(slots, pfair_mixing.windows(k, frame), strict=True))
        for t in range(frame + 1):
            assert abs(sum(s < t for s in slots) - t * k / frame) < 1


def test_plan_places_every_block_once():
    blocks, weights = {"a": 1500, "b": 40, None: 7, "c": 1}, {"a": 5.0, "b": 1.0, None: 1.0, "c": 0.1}
    taken = set()
    placed = dict.fromkeys(blocks, 0)
    for p in pfair_mixing.plan(blocks, weights, 50):
        for j in range(p.first, p.last):
            own = j - p.first
            slot = p.start + own // len(p.slots) * p.frame + p.slots[own % len(p.slots)]
            assert slot not in taken
            taken.add(slot)
            placed[p.source] += 1
    assert placed == blocks


def test_mixture_keeps_all_rows_and_shares(spark):
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}", "x") for i in range(3000)] + [(1, "hot", "x"), (1, "hot", "x"), (None, "hot", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, Slot string").repartition(4)
    out = pfair_mixing.mix(df, {"hot": 4.0, "s0": 1.0}, block_rows=2)
    got = out.collect()
    assert len(got) == len(rows) and len({(r.slot, r.place) for r in got}) == len(rows) and out.columns == ["doc_id", "source", "block", "slot", "place", "release", "deadline"]
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    ordered = [r.source for r in pfair_mixing.in_order(pfair_mixing.mix(df, {"hot": 4.0, "s0": 1.0}, block_rows=1)).collect()]
    counts = {s: ordered.count(s) for s in set(ordered)}
    first = min(len(ordered) - ordered[::-1].index(s) for s in counts)  # while every source lasts
    shares = {s: (4.0 if s == "hot" else 1.0) / (4.0 + len(counts) - 1) for s in counts}
    for t in range(0, first - 1000, 37):
        for s, share in shares.items():
            assert abs(ordered[:t].count(s) - t * share) < 1 + t * 2e-3
    assert pfair_mixing.mix(df.limit(0)).count() == 0


def test_bad_weights(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    with pytest.raises(ValueError):
        pfair_mixing.mix(df, {"a": 0.0})


def test_mixing_query(spark, small):
    out = queries.op10_pfair_mixing(spark, small)
    assert out.count() == spark.read.parquet(f"{small}/documents.parquet").count() and out.where("slot < release or slot >= deadline").count() == 0


def test_common_prefix_and_masks(spark):
    rows = [(1, False, 0, "user", "hi"), (1, False, 1, "assistant", "good"), (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "bad"), (1, True, 2, "user", None), (2, False, 0, "user", "only"), (3, False, 0, None, None), (3, True, 0, "", "")]
    out = preference.format_pairs(spark.createDataFrame(rows, "pair_id int, rejected boolean, turn int, role string, text string"))
    got = {r.pair_id: r for r in out.collect()}
    one = got[1]
    assert one.common_turns == 1 and one.prompt == "<|user|>\nhi<|end|>\n" and one.chosen == "<|assistant|>\ngood<|end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_mask] == ["good<|end|>\n"] and [one.rejected[s.start : s.end] for s in one.rejected_mask] == ["bad<|end|>\n"]
    assert one.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n"
    assert (got[2].prompt, got[2].rejected, got[2].rejected_mask) == ("", "", []) and (got[3].common_turns, got[3].chosen, got[3].rejected) == (1, "", "")


def test_preference_query_agrees_with_its_sql(spark, small):
    assert harness.differences(queries.op3_preference(spark, small), harness.connect(small), queries.OP3_SQL) is None
    shared = spark.read.parquet(f"{small}/conversations.parquet").withColumn("text", F.when(F.col("turn") < 2, "same").otherwise(F.col("text"))).withColumn("role", F.when(F.col("turn") < 2, "user").otherwise(F.col("role")))
    assert preference.format_pairs(preference.neighbouring_pairs(shared)).where("common_turns >= 2").count() >= 10
    assert preference.format_pairs(preference.neighbouring_pairs(shared.limit(0))).count() == 0


@pytest.mark.parametrize("weights", [[(k + 1) ** 0.5 for k in range(20)], [100_000.0, 1.0], [0.1, 0.2, 0.7]])
def test_one_block_from_the_true_weights_over_hundreds_of_frames(weights):
    slots = 300_000
    blocks = {f"s{k:02}": int(w / sum(weights) * slots) + 2 for k, w in enumerate(weights)}
    target = {s: w for s, w in zip(blocks, weights, strict=True)}
    placed = {}
    for p in pfair_mixing.plan(blocks, target):
        for j in range(p.first, p.last):
            own = j - p.first
            placed[p.start + own // len(p.slots) * p.frame + p.slots[own % len(p.slots)]] = p.source
    done, total = dict.fromkeys(blocks, 0), sum(weights)
    for t in range(slots):
        done[placed[t]] += 1
        assert t % 97 or all(abs(n - (t + 1) * target[s] / total) < 1 + 1e-6 for s, n in done.items())
        if done[placed[t]] == blocks[placed[t]]:
            break
    assert t > 200_000 and sorted(placed) == list(range(sum(blocks.values())))


def test_mixture_is_the_plan(spark, monkeypatch):
    monkeypatch.setattr(pfair_mixing, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(pfair_mixing, "PIECE", 7)
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 10 = 0, null, if(id % 3 = 0, 'a', 'b')) as source")
    weights = {"a": 1.0, "b": 3.3, None: 0.001}
    counts = {r[0]: -(-r[1] // 2) for r in df.groupBy("source").count().collect()}
    want = {(p.source, p.first + i): (p.start + s, p.phase + w[0], p.phase + w[1]) for p in pfair_mixing.plan(counts, weights) for i, (s, w) in enumerate(zip(p.slots, p.windows, strict=True))}
    got = pfair_mixing.mix(df, weights, block_rows=2).collect()
    assert len(got) == 3000 and {(r.source, r.block): (r.slot, r.release, r.deadline) for r in got} == want
