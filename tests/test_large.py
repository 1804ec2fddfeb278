"""What keeps a query bounded on large tables: plans without joins that send a large side to all tasks, and steps that grow with their input alone."""

from docloom.operators import retrieval


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_recognition_meets_titles_by_equality_and_sends_no_side_whole(spark):
    titles = [(k, f"customer{k:04d}法") for k in range(300)]  # all share their grams but for the number
    authorities = spark.createDataFrame([*titles, (1000, "ab"), (1001, "民法典"), (1002, "中华人民共和国刑法法")], "authority_id long, title string")
    queries = spark.createDataFrame([(1, "《customer0007法》第1条"), (2, "customer0007法和customer0008法"), (3, "按民法典 customer00070"), (4, "Customer0007法"), (5, "《刑法法》"), (6, None), (7, "ab")], "query_id long, query string")
    out = retrieval.recognized_authority(queries, authorities)
    assert sorted(map(tuple, out.collect())) == [(1, 7), (3, 1001), (5, 1002)]
    assert "gram" not in plan(out) and "Broadcast" not in plan(out)
    assert retrieval.recognized_authority(queries, authorities.limit(0)).count() == 0


def test_an_index_is_made_of_small_rows_in_small_row_groups(spark, tmp_path):
    import glob

    import numpy as np
    import pyarrow.parquet as pq

    from docloom.operators import gram_index

    letters = np.array(list("abcdefghijklmnopqrstuvwxyz     "))
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, "".join(rng.choice(letters, 150_000))) for k in range(40)], "doc_id long, text string").coalesce(1)
    gram_index.publish(docs, ["text"], str(tmp_path / "index"))
    index = gram_index.published(spark, str(tmp_path / "index"), docs)
    sizes = [sum(r.sizes) for r in index.blocks.select("sizes").collect()]
    assert sum(sizes) == 40 * 149_998 and max(sizes) <= (1 << 20) + 150_000
    groups = [pq.ParquetFile(f).metadata.row_group(g).total_byte_size for f in glob.glob(f"{tmp_path}/index/**/blocks/*.parquet", recursive=True) for g in range(pq.ParquetFile(f).num_row_groups)]
    assert max(groups) < 40 << 20


def test_the_window_numbers_lines_as_the_scan_does_and_crowded_keys_are_scanned(spark, monkeypatch):
    import random

    from docloom.operators import extraction

    draw = random.Random(3)
    texts = ["第一条 a", "（一）b", "1.1 c", "1.1.1 d", "一、e", "12. f", "text", "  第二条", "　(3) x", "", "30元"]
    rows = [(job, k % 2 + 1, k, draw.choice(texts)) for job in (1, 2, 3) for k in range(40 * job)]
    units = spark.createDataFrame(rows, "job int, page_number int, unit_order int, unit_text string")
    key = lambda r: (r.job, r.page_number, r.unit_order)
    want = sorted(extraction.outlined(units, "job", partitions=3).collect(), key=key)
    small = extraction.outlined(units, "job")
    assert "MapInArrow" not in plan(small) and small.columns == extraction.outlined(units, "job", partitions=3).columns
    assert sorted(small.collect(), key=key) == want and any(r.parent_number for r in want)
    monkeypatch.setattr(extraction, "CROWD", 60)
    assert sorted(extraction.outlined(units, "job").collect(), key=key) == want


def test_only_texts_that_may_hold_a_match_are_handed_to_python(spark):
    from docloom.operators import extraction

    texts = ["甲方：甲", "签订日期：2026年1月2日", "2026/1/02", "¥5", "5\x1c元", "1,000 万元", "5 ％", "百分之五", "合同编号: A", "见附件 二", "依照第一条", "1.2条", "壹仟元整", "甲\n方", "text", None]
    units = spark.createDataFrame(list(enumerate(texts)), "unit_order int, unit_text string")
    for kind, pattern in extraction.PATTERNS.items():
        every = extraction.matches(units, {kind: f"(?:{pattern})"}, ["unit_order"]).collect()  # another pattern, so no hint is known for it
        assert extraction.matches(units, {kind: pattern}, ["unit_order"]).collect() == every and every
    assert "RLIKE" in plan(extraction.matches(units, extraction.PATTERNS, ["unit_order"])).upper()


def test_addresses_with_one_character_between_them_are_told_as_the_sql_tells_them(spark, tmp_path):
    import harness

    from docloom.plans import registry

    rows = [(1, "10.0.0.1 10.0.0.2 10.0.0.3"), (2, "10.0.0.1\n10.0.0.2"), (3, "10.0.0.1, 10.0.0.2\n"), (4, "1.2.3.4.5"), (5, None), (6, "1.2.3.4")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert harness.differences(registry.queries()["mentions_latin"](spark, str(tmp_path)), con, registry.oracle_sql()["mentions_latin"]) is None


def test_a_record_is_parsed_once(spark):
    from docloom.sources import validation

    text = validation.validated(spark.range(1).selectExpr("cast(id as string) as record"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parse_json(") + text.count("parseJson") <= 2


def test_cosines_are_taken_some_rows_at_a_time(spark, monkeypatch):
    from docloom.operators import retrieval

    rows = [(k, [float(k % 7), float(k % 5) - 2, 1.0]) for k in range(200)]
    vectors = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    asked = vectors.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, retrieval.semantic(asked, vectors, 4).collect()))
    monkeypatch.setattr(retrieval, "CELLS", 32)
    assert sorted(map(tuple, retrieval.semantic(asked, vectors, 4).collect())) == want and len(want) == 16


def test_uncertain_sources_are_found_without_pairs_of_objects(spark):
    from docloom.operators import findings

    cited = spark.createDataFrame([(1, 10, ["a", "b"]), (1, 11, ["c"]), (2, 12, ["a"]), (1, 13, [])], "job_id int, cited_id int, evidence_ids array<string>")
    spans = spark.createDataFrame([(1, 20, ["a"], "NATIVE_TEXT", 0.9), (1, 20, ["z"], "OCR", 0.5), (1, 21, ["c"], "OCR", 0.9), (2, 22, ["b"], "OCR", None)], "job_id int, object_id int, evidence_ids array<string>, source_method string, confidence double")
    out = findings.source_uncertain(cited, spans)
    assert sorted(map(tuple, out.collect())) == [(1, 10, True), (1, 11, False), (1, 13, False), (2, 12, False)]
    assert "object_id" not in plan(out).split("Join")[0]


def test_rules_make_their_rows_once(spark):
    from docloom.operators import rule_set

    jobs = spark.createDataFrame([(1,), (2,), (3,)], "job_id int")
    parties = spark.createDataFrame([(1, "party-1", "甲方", "A"), (1, "party-2", "甲方", "A"), (2, "party-1", "甲方", "A"), (2, "party-2", "甲方", "B")], "job_id int, mention_id string, role_label string, normalized_name string")
    from pyspark.sql import functions as F

    out = rule_set.groups(jobs, parties, "PARTY-ROLE-CONSISTENCY", "role_label", F.col("normalized_name"), F.lit(True))
    assert sorted((r.job_id, r.state, r.reason_code, r.object_ids) for r in out.collect()) == [(1, "PASS", "PARTY_NAMES_MATCH", ["party-1", "party-2"]), (2, "FAIL", "PARTY_NAMES_CONFLICT", ["party-1", "party-2"]), (3, "NOT_APPLICABLE", "NO_PARTY_MENTIONS", [])]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_requests_are_dealt_before_repeats_are_looked_for(spark, monkeypatch):
    from datetime import date

    from docloom.operators import corpus, scan

    asked = spark.createDataFrame([(1, date(2020, 1, 5), 7), (1, date(2020, 1, 5), 7), (1, date(2020, 1, 5), 8), (None, date(2020, 1, 5), 9), (2, None, 10)], "authority_id int, as_of date, query_id int")
    versions = spark.createDataFrame([(1, 4, date(2020, 1, 1), None)], "authority_id int, version_id int, effective_date date, end_date_exclusive date")
    plans, carried = [], scan.carried_scan
    monkeypatch.setattr(scan, "carried_scan", lambda events, *rest: plans.append(plan(events)) or carried(events, *rest))
    got = corpus.resolve_versions(asked, versions, ["query_id"])
    assert sorted((r.query_id, r.state, r.version_id) for r in got.collect()) == [(7, "RESOLVED", 4), (8, "RESOLVED", 4), (9, "NO_APPLICABLE_VERSION", None), (10, "NO_APPLICABLE_VERSION", None)]
    assert "HashAggregate" in plans[0] and "HashAggregate" not in plans[0].split("Exchange")[-1]


def test_a_scan_of_more_rows_has_more_tasks(spark, monkeypatch):
    from datetime import date, timedelta

    from docloom.operators import corpus, scan

    day = date(2020, 1, 1)
    versions = spark.createDataFrame([(k % 3, k, day + timedelta(k), day + timedelta(k + 3)) for k in range(300)], "authority_id int, version_id int, effective_date date, end_date_exclusive date")
    asked = spark.createDataFrame([(k % 3, day + timedelta(k)) for k in range(300)], "authority_id int, as_of date")
    find = lambda: corpus.resolve_versions(asked, versions, ["authority_id", "as_of"])
    want = sorted(map(str, find().collect()))
    monkeypatch.setattr(scan, "ROWS", 45, raising=False)
    out = find()
    assert out.rdd.getNumPartitions() == 20 and sorted(map(str, out.collect())) == want


def test_a_scan_that_is_one_side_of_a_union_carries_its_own_states(spark):
    from datetime import date, timedelta

    from docloom.operators import corpus

    day = date(2020, 1, 1)
    versions = spark.createDataFrame([(1, k, day + timedelta(k), day + timedelta(k + 60)) for k in range(200)], "authority_id int, version_id int, effective_date date, end_date_exclusive date")
    asked = spark.createDataFrame([(1, day + timedelta(k)) for k in range(260)], "authority_id int, as_of date")
    alone = corpus.resolve_versions(asked, versions, ["as_of"], 6)
    want = sorted(map(str, alone.collect() * 2))
    assert sorted(map(str, alone.unionByName(alone).collect())) == want


def test_mentions_meet_small_pages_without_copies_and_large_ones_by_a_sweep(spark, small, monkeypatch):
    from docloom.operators import extraction
    from docloom.plans import contracts

    fields = "job_id int, page_number int, evidence_ids array<string>, char_start long, char_end long"
    containers = [(1, page, [f"e{page % 2}"], 10 * k, 10 * k + 10 + 15 * (k % 3 == 0), f"c{page}-{k}", k) for page in range(4) for k in range(3 * page)]
    mentions = [(1, page, [f"e{k % 2}", None], k, k + 4, f"m{page}-{k}") for page in range(5) for k in range(0, 70, 3)]
    frames = spark.createDataFrame(mentions, f"{fields}, mention_id string"), spark.createDataFrame(containers, f"{fields}, container_id string, container_order int")
    want = {}
    for _, page, ids, s, e, name in mentions:
        hits = [(c[6], c[5]) for c in containers if c[1] == page and set(ids) & set(c[2]) and c[3] <= s and e <= c[4]]
        want[name] = min(hits)[1] if hits else None
    for most in (512, 26, 0):  # all pages are small, some, none
        monkeypatch.setattr(extraction, "PAGE", most)
        assert {r.mention_id: r.container_id for r in extraction.contained(*frames).collect()} == want and None in want.values()
    monkeypatch.undo()

    def refused(df):
        raise AssertionError("a copy of the rows")

    monkeypatch.setattr(extraction, "checkpoint", refused)
    made = plan(contracts.mention_clauses(spark, small))
    assert "MapInArrow" not in made and "SortMergeJoin" not in made
    assert made.count("Exchange hashpartitioning") == made.count("REPARTITION_BY_NUM") > 0  # only orders are shuffled


def test_lines_of_long_pages_have_their_offsets(spark):
    from docloom.operators import ingest

    lines = [" " * (k % 3) + "一😀"[: k % 3] + "　\x1f"[: k % 2] for k in range(1000)]
    text, at, want = "\n".join(lines), 0, []
    for line in lines:
        if line.strip():
            start = at + len(line) - len(line.lstrip())
            want.append((len(want) + 1, line.strip(), start, start + len(line.strip())))
        at += len(line) + 1
    units = ingest.evidence_units(spark.createDataFrame([(1, text), (2, ""), (3, "a"), (4, "\n\nb\n")], "id int, text string"), "id")
    assert "MapInArrow" not in plan(units)
    rows = sorted((r.id, r.unit_order, r.unit_text, r.char_start, r.char_end) for r in units.collect())
    assert rows == [*[(1, *w) for w in want], (3, 1, "a", 0, 1), (4, 1, "b", 2, 3)]


def test_matches_of_the_engine_are_those_of_python(spark):
    import re

    from docloom.operators import extraction

    texts = ["甲方：客户 1 乙方：；丙方: x\n", "甲方：a\r\n乙方\x1c：b\x85c\n\n", "😀" * 30 + "合同总价为１２3,456.5元，预付款30%，尾款 7 ％百分之五十", "合同编号：\x1dHT-1\x1f2，项目编号:😀", "1.2.3条第二条见附件 一、附件　5", "人民币壹仟元整壹元", "¥5￥ 1,000.5万元2026年1月2日2026-1/3", "元" * 50 + "1元" * 60]
    units = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "unit_order int, unit_text string")
    found = extraction.matches(units, extraction.PATTERNS, ["unit_order"])
    assert "MapInArrow" not in plan(found)
    want = []
    for k, t in enumerate(texts):
        for kind, pattern in extraction.PATTERNS.items():
            for m in re.finditer(pattern, t):
                g = m.groupdict()
                want.append((k, kind, m[0], g.get("value") or g.get("value2"), g.get("label"), *m.span(), t[max(0, m.start() - 40) : m.start()]))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr) and len(want) > 70


def test_rules_are_found_without_copies_of_matches_and_without_python(spark, small, monkeypatch):
    from docloom.operators import extraction
    from docloom.plans import contracts

    def refused(df):
        raise AssertionError("a copy of the rows")

    monkeypatch.setattr(extraction, "checkpoint", refused)
    made = plan(contracts.audit_rules(spark, small))
    assert "Python" not in made and "MapInArrow" not in made
    shuffles = [line for line in made.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and all("o_orderkey" in line and "REPARTITION_BY_NUM" in line for line in shuffles)  # orders, never their lines or mentions


def test_numerals_of_the_engine_are_those_of_python(spark):
    import random

    from docloom.functions import text as X

    draw = random.Random(1)
    texts = ["", None, "0012", "12a", "一千零五", "万", "十", "万万", "一万零五", "零", "〇〇", "９", "九" * 30, "九千" * 20, "九千" * 20 + "万" * 4, "9" * 30, "一万\n"]
    texts += ["".join(draw.choice("零〇一二两三九十百千万") for _ in range(draw.randrange(1, 9))) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    numbers = rows.select("t", X.numeral(rows["t"]).alias("n"))
    assert "Python" not in plan(numbers)
    want = [X.chinese_number(t) for t in texts]
    assert sorted(map(repr, (r.n for r in numbers.collect()))) == sorted(repr(w if w is not None and w < 2**63 else None) for w in want)
    assert all(r.n == X.chinese_number(r.t) for r in numbers.where("n is not null").collect())


def test_preambles_are_found_without_a_join_or_a_copy(spark, small, monkeypatch):
    from docloom.operators import extraction
    from docloom.plans import contracts

    def refused(df):
        raise AssertionError("a copy of the rows")

    monkeypatch.setattr(extraction, "checkpoint", refused)
    made = plan(contracts.contract_preambles(spark, small))
    assert "Join" not in made and "MapInArrow" not in made
    assert made.count("Exchange hashpartitioning") == made.count("REPARTITION_BY_NUM") > 0  # orders, never their lines


def test_lines_that_are_no_titles_stay_in_the_block(spark):
    from docloom.operators import extraction

    units = spark.createDataFrame([(1, 1, "题"), (1, 2, "a"), (1, 3, "a"), (1, 4, "第一条 x"), (2, 1, "a"), (None, 1, "n")], "job int, unit_order int, unit_text string")
    titles = spark.createDataFrame([(1, 1, "题"), (1, 1, "题"), (2, 1, "题"), (1, 2, "a"), (None, 1, "n"), (3, 1, "a")], "job int, page_number int, unit_text string")
    blocks = extraction.unnumbered_blocks(extraction.outlined(units, "job"), titles, "job")
    assert sorted(map(repr, ((r.job, r.text) for r in blocks.collect()))) == sorted(map(repr, [(1, "a\na"), (2, "a"), (None, "n")]))


def test_a_query_is_scored_by_all_its_grams(spark, small, monkeypatch):
    from docloom.operators import gram_index
    from docloom.plans import retrieval as plans

    head = "abcdefghijklmnopqrstuvwxyz0123456789"  # 34 grams
    docs = spark.createDataFrame([(1, head), (2, "the tail of it"), (3, head + " the tail of it"), (4, "z qqq")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, head + "thetailofit"), (2, "qqq"), (3, "")], "query_id long, query string")
    index = gram_index.index_for(docs, ["text"], queries)
    found = lambda most: sorted((r.query_id, r.doc_id) for r in gram_index.search(index, queries, 5, {"text": 1.0}, most=most)[0].collect())
    assert found(None) == [(1, 1), (1, 2), (1, 3), (2, 4)]
    assert (1, 2) not in found(32)
    monkeypatch.setattr(gram_index, "BLOCK_GRAMS", 8)
    assert (1, 2) in found(None)
    assert "<= 32" not in plans.BM25_SQL and "<= 32" in plans.RRF_SQL


def test_ranking_counts_documents_however_far_down_they_are(spark, tmp_path, monkeypatch):
    import harness

    from docloom.operators import gram_index
    from docloom.plans import retrieval as plans

    item, filler = "alpha beta gamma", " ".join(f"word{k}" for k in range(900))
    docs = [(k, "alpha beta alpha gamma beta") for k in range(20, 65)] + [(5, f"{filler} {item}"), (70, f"{filler} {item}"), (3, "delta"), (80, "unit test ok"), (81, "unit test ok")]
    docs += [(200 + k, "zeta eta theta iota") for k in range(40)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", [(1, item), (2, "unit test ok"), (3, "nowhere"), (4, "zeta eta theta"), (5, "delta")], "item_id long, text string")):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    got = plans.ranking_metrics(spark, str(tmp_path))
    assert harness.differences(got, harness.connect(str(tmp_path)), plans.RANKING_SQL) is None
    row = got.first()
    assert (row.queries, row.recall_at_k, row.mrr) == (4, 0.75, round((3 + 1 / 86) / 4, 6))  # 85 documents (beta and zeta have grams in common) come before the first that holds the item
    queries = spark.read.parquet(f"{tmp_path}/benchmark.parquet").selectExpr("item_id as query_id", "text as query")
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet").repartition(3)
    monkeypatch.setattr(gram_index, "SLICE", 200)
    monkeypatch.setattr(gram_index, "BLOCK_QUERIES", 2)
    index = gram_index.index_for(documents, ["text"], queries)
    _, gold = gram_index.search(index, queries, 2, {"text": 1.0}, documents)
    assert gold.where("query_id = 4").count() == 40
    assert sorted(map(tuple, gram_index.first_ranks(index, queries, gold, {"text": 1.0}).collect())) == [(1, 5, 86), (2, 80, 1), (4, 200, 1), (5, 3, 1)]
