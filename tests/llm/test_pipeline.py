import hashlib

import numpy as np
from test_bpe import TIKTOKEN
from test_ngram_join import brute

import corpus_pipeline
from docloom.llm import pfair_mixing


def test_stages_one_by_one(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "secrets", "mixing", "tokens"]
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "tokens" or docs.columns == columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = texts(inputs["near_duplicates"]), texts(inputs["secrets"])
    groups = {d: c for d, _, c in brute(list(before.items()), 5, 80, 100)}
    assert set(after) == {d for d, c in groups.items() if d == c}
    redacted = texts(inputs["mixing"])
    assert set(redacted) == set(after) and not any('token = "' in t and "[REDACTED]" not in t for t in redacted.values())
    assert texts(inputs["tokens"]) == redacted
    for r in docs.collect():
        ids = TIKTOKEN.encode_ordinary(redacted[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_clean_documents_stay(spark, small):
    small = small.replace("sf0.001", "sf0.01")
    good = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, small)
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.03 * good.count()


def test_result_tells_the_mixture(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(300).unionAll(spark.read.parquet(f"{small}/documents.parquet").where("source is null").limit(3)).cache()
    want = sorted((r.doc_id, r.slot, r.place) for r in pfair_mixing.mix(docs).collect())
    corpus_pipeline.mixing(spark, docs, small).write.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), small).collect()
    assert sorted((r.doc_id, r.slot, r.place) for r in got) == want and len({(r.slot, r.place) for r in got}) == len(want)
    counts = {}
    for r in got:
        counts[r.source] = counts.get(r.source, 0) + 1
    plan = pfair_mixing.plan({s: -(-n // pfair_mixing.BLOCK_ROWS) for s, n in counts.items()}, pfair_mixing.tempered(counts))
    assert {(p.source, p.start + s) for p in plan for s in p.slots} == {(r.source, r.slot) for r in got}


def test_near_duplicates_with_ids_that_are_missing_or_repeat(spark, small):
    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:58], "x", "y"]), "quite another text of its own"
    rows = [(1, text), (1, text), (None, text), (None, text), (5, near), (5, other), (7, None), (7, ""), (None, None), (9, other + " again"), (9, other + " again")]
    docs = spark.createDataFrame([(d, t, "src", k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, own string, same int").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, small)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, text), (5, other), (7, None), (7, ""), (None, None), (9, other + " again")], key=str)
    alone = spark.createDataFrame([(None, text), (None, near)], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, alone, small).count() == 1
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), small).count() == 0


def test_stages_keep_nulls_repeats_and_further_columns(spark, small):
    docs = spark.createDataFrame([(1, None, None, "en", 0, 5), (1, None, None, "en", 0, 5), (None, "a text", "s", None, 6, None), (3, "", "s", None, 0, 1)], "doc_id long, text string, source string, lang string, n_chars long, block int")
    for stage in (corpus_pipeline.secrets, corpus_pipeline.mixing):
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert [r.n_tokens for r in corpus_pipeline.tokens(spark, docs, small).orderBy("doc_id").collect()] == [2, 0, 0, 0]
    assert corpus_pipeline.tokens(spark, docs.limit(0), small).count() == 0


def test_run_is_its_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        docs.cache()
    key = lambda r: (r.doc_id, r.slot, r.place, r.n_tokens, r.ids_sha256, r.decoded_sha256)
    assert sorted(map(key, corpus_pipeline.run(spark, small).collect())) == sorted(map(key, docs.collect()))
    spark.catalog.clearCache()
