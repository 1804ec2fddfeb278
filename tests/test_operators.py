"""Small cases whose results are known from the operators' definitions."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import artifacts, batch, corpus, extraction, gram_index, ingest, planning, quality, retrieval, review, rules
from docloom.sources import readers


def units(spark, *lines, job="j"):
    return spark.createDataFrame([(job, i + 1, line) for i, line in enumerate(lines)], "job string, unit_order int, unit_text string")


def found(spark, *lines):
    return extraction.matches(units(spark, *lines), extraction.PATTERNS, ["job", "unit_order", "unit_text"])


def test_purchase_contract_page(spark):
    lines = ["采购合同", "合同编号：HT-2026-001", "甲方：北京甲公司 乙方：上海乙公司", "签订日期：2026年8月15日", "第一条 价款", "合同总价 100,000 元，首付款30%，尾款百分之七十。见附件一，依第一条。", "第二条 生效日期：2026-09-01", "本条无标题"]
    got = found(spark, *lines)
    clauses = extraction.clauses(extraction.outlined(units(spark, *lines), "job"), "job")
    assert [(c.token, c.body_text.count("\n")) for c in clauses.orderBy("clause_id").collect()] == [("第一条", 0), ("第二条", 0)]
    assert [(d.iso_date, d.field_label) for d in extraction.dates(got, "job").orderBy("mention_id").collect()] == [(date(2026, 8, 15), "签订日期"), (date(2026, 9, 1), "生效日期")]
    money = extraction.amounts(got, "job").collect()
    assert [(m.numeric_value, m.unit, m.money_field) for m in money] == [("100000", "元", "合同总价")]
    assert [(p.numeric_value, p.payment_label) for p in extraction.percentages(got, "job").orderBy("mention_id").collect()] == [("30", "首付款"), ("70", "尾款")]
    assert [(p.role_label, p.raw_name) for p in extraction.parties(got, "job").orderBy("mention_id").collect()] == [("甲方", "北京甲公司"), ("乙方", "上海乙公司")]
    assert [i.raw_value for i in extraction.identifiers(got, "job").collect()] == ["HT-2026-001"]
    refs = {(r.kind, r.resolution_state, r.resolved_target_id) for r in extraction.references(got, clauses, "job").collect()}
    assert refs == {("ATTACHMENT", "UNRESOLVED", None), ("ARTICLE", "RESOLVED", "clause-0001")}
    titles = ingest.title_candidates(units(spark, *lines), "job").collect()
    assert [(t.unit_text, t.confidence) for t in titles][:1] == [("采购合同", "HIGH")]


def test_clause_levels_and_parents(spark):
    got = extraction.clauses(extraction.outlined(units(spark, "一、总则", "（一）范围", "1.价款", "1.1 首付", "1.1.1 时间", "30元整"), "job"), "job").orderBy("clause_id").collect()
    assert [(c.level, c.parent_clause_id) for c in got] == [(1, None), (2, "clause-0001"), (1, None), (2, "clause-0003"), (3, "clause-0004")]


def test_bad_date_and_ambiguous_reference(spark):
    assert [(d.iso_date, d.resolution_state) for d in extraction.dates(found(spark, "2026年2月30日"), "job").collect()] == [(None, "UNRESOLVED")]
    lines = ["第一条 甲", "第一条 乙", "依照第一条办理"]
    refs = extraction.references(found(spark, *lines), extraction.clauses(extraction.outlined(units(spark, *lines), "job"), "job"), "job").collect()
    assert [(r.resolution_state, r.resolved_target_id) for r in refs] == [("AMBIGUOUS", None)]


def test_offsets_count_code_points(spark):
    rows = spark.createDataFrame([(1, " 😀a\n\n  b ")], "doc_id int, text string")
    assert [(u.unit_text, u.char_start, u.char_end) for u in ingest.evidence_units(rows, "doc_id").orderBy("unit_order").collect()] == [("😀a", 1, 3), ("b", 7, 8)]
    m = extraction.matches(units(spark, "😀首付款30%"), extraction.PATTERNS, ["job", "unit_order", "unit_text"]).where("kind = 'PERCENT'").first()
    assert (m.start, m.end, m.value) == (4, 7, "30")


@pytest.mark.parametrize("text,number", [("十", 10), ("二十", 20), ("一百零五", 105), ("二〇二一", 2021), ("一万二千", 12000), ("三千零四十", 3040), ("15", 15), ("零", 0), ("x", None), ("", None)])
def test_numerals(text, number):
    assert X.chinese_number(text) == number


def test_page_routes(spark):
    texts = ["", "short", "字" * 40, "�" * 2 + "a" * 50, "-" * 40, None]
    got = ingest.page_routes(spark.createDataFrame(list(enumerate(texts)), "page int, text string")).orderBy("page").collect()
    assert [r.route_reason for r in got] == ["NO_TEXT", "TOO_LITTLE_TEXT", "NATIVE_TEXT_OK", "SUSPICIOUS_CHARACTERS", "LOW_MEANINGFUL_RATIO", "NO_TEXT"]


def test_articles_of_a_snapshot(spark):
    text = "﻿第一编 总则\r\n第一章 测试\r\n第一条　甲事项。\r\n依照第二条办理。\n第二条 乙事项。\n"
    got = ingest.articles(spark.createDataFrame([("a", text)], "authority_id string, text string"), "authority_id").orderBy("article_ordinal").collect()
    assert [(a.article_token, a.article_text) for a in got] == [("第一条", "甲事项。\n依照第二条办理。"), ("第二条", "乙事项。")]
    assert got[0].heading_context == ["第一编 总则", "第一章 测试"] and got[0].problem is None


def test_percent_groups(spark):
    rows = [("a", 1, 30), ("a", 1, 50), ("a", 1, 20), ("b", 1, 30), ("b", 1, 50), ("b", 1, 30), ("c", 1, 100)]
    out = rules.percent_total(spark.createDataFrame(rows, "job string, line int, p int"), ["job"], "line", F.col("p"), F.lit(True), F.lit(False))
    assert {(r.job, r.state, int(r.total), r.instance) for r in out.collect()} == {("a", "PASS", 100, "group-001"), ("b", "FAIL", 110, "group-001")}


def test_group_rules_and_low_confidence(spark):
    rows = [("甲方", "A", False), ("甲方", "A", False), ("乙方", "B", False), ("乙方", "C", False), ("丙方", "D", False), ("丁方", None, True)]
    out = rules.group_consistency(spark.createDataFrame(rows, "role string, name string, open boolean").withColumn("job_id", F.lit("j")), ["job_id"], "role", F.col("name"), F.col("open"))
    assert {r.role: r.state for r in out.collect()} == {"甲方": "PASS", "乙方": "FAIL", "丙方": "NOT_APPLICABLE", "丁方": "REVIEW"}
    low = rules.finalized(out.withColumns({"low_confidence": F.col("role") == "乙方", "severity": F.lit(None).cast("string"), "review_reasons": F.lit(None).cast("array<string>")}))
    got = low.where("role = '乙方'").first()
    assert (got.state, got.deterministic_state, got.review_reasons, got.severity) == ("REVIEW", "FAIL", ["LOW_CONFIDENCE_OCR"], "WARNING")


def test_versions_as_of(spark):
    versions = spark.createDataFrame([("a", "v1", date(2020, 1, 1), date(2022, 1, 1)), ("a", "v2", date(2022, 1, 1), None), ("b", "v1", date(2020, 1, 1), None), ("b", "v2", date(2024, 1, 1), None)], "authority_id string, version_id string, effective_date date, end_date_exclusive date")
    asked = spark.createDataFrame([(a, d) for a, d in [("a", date(2019, 1, 1)), ("a", date(2021, 1, 1)), ("a", date(2022, 1, 1)), ("b", date(2024, 6, 1))]], "authority_id string, as_of date")
    got = {(r.authority_id, r.as_of.year): (r.state, r.version_id, r.candidates) for r in corpus.resolve_versions(asked, versions, ["authority_id", "as_of"]).collect()}
    assert got[("a", 2019)] == ("NO_APPLICABLE_VERSION", None, []) and got[("a", 2021)][:2] == ("RESOLVED", "v1") and got[("a", 2022)][:2] == ("RESOLVED", "v2")
    assert got[("b", 2024)] == ("AMBIGUOUS", None, ["v1", "v2"])
    assert [(r.authority_id, r.version_a, r.version_b) for r in corpus.overlapping(versions).collect()] == [("b", "v1", "v2")]


def test_overlaps_as_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), i, date(2020, 1, 1 + rng.randrange(28)), date(2020, 2, 1 + rng.randrange(20)) if rng.random() < 0.9 else None) for i in range(60)]
    got = {(r.authority_id, r.version_a, r.version_b) for r in corpus.overlapping(spark.createDataFrame(rows, "authority_id int, version_id int, effective_date date, end_date_exclusive date")).collect()}
    end = lambda r: r[3] or date(9999, 12, 31)
    assert got == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < end(b) and b[2] < end(a)}


def test_import_plan(spark, tmp_path):
    new = spark.createDataFrame([("a", "v1", "title", "h1", "x"), ("a", "v2", "title", "h2", "x"), ("b", "v1", "other", "h3", "x"), ("b", "v2", "changed", "h4", "x"), ("b", "v3", "changed", "h5", "x")], "authority_id string, version_id string, identity string, source_sha256 string, articles string")
    stored = spark.createDataFrame([("a", "v1", "h1", "x"), ("b", "v2", "old", "x"), ("b", "v3", "h5", "y")], "authority_id string, version_id string, source_sha256 string, articles string")
    plan = corpus.import_plan(new, spark.createDataFrame([("a", "title"), ("b", "changed")], "authority_id string, identity string"), stored)
    assert {(r.authority_id, r.version_id): (r.outcome, r.conflicts) for r in plan.collect()} == {
        ("a", "v1"): ("NO_CHANGE", []),
        ("a", "v2"): ("NEW", []),
        ("b", "v1"): ("CONFLICT", ["AUTHORITY_IDENTITY_CONFLICT"]),
        ("b", "v2"): ("CONFLICT", ["SOURCE_VERSION_IDENTITY_CONFLICT"]),
        ("b", "v3"): ("CONFLICT", ["ARTICLE_IDENTITY_CONFLICT"]),
    }
    with pytest.raises(ValueError):
        readers.import_records(plan, str(tmp_path / "t"))
    assert readers.import_records(plan.where("authority_id = 'a'"), str(tmp_path / "t")) == 1


def test_official_hosts(spark):
    rows = spark.createDataFrame([([("https://flk.npc.gov.cn/x",)],), ([("https://flk.npc.gov.cn/x",), ("https://example.com",)],), ([],)], "refs array<struct<url:string>>")
    assert [r[0] for r in rows.select(corpus.official(F.col("refs"))).collect()] == [True, False, False]


def test_bm25_as_brute_force(spark):
    import math

    rng = random.Random(1)
    docs = [(i, "".join(rng.choice("abc d") for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    query = "abcab dca"
    grams = list(dict.fromkeys("abcabdca"[i : i + 3] for i in range(6)))
    counts = {d: [t[i : i + 3] for i in range(len(t) - 2)] for d, t in docs}
    mean = sum(max(len(t) - 2, 0) for _, t in docs) / len(docs)
    want = {}
    for g in grams:
        df = sum(g in c for c in counts.values())
        for d, c in counts.items():
            if g in c:
                f = c.count(g)
                want[d] = want.get(d, 0) - max(1e-6, math.log((len(docs) - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(c) / mean))
    got = retrieval.lexical(spark.createDataFrame([(1, query)], "query_id int, query string"), spark.createDataFrame(docs, "doc_id int, text string").repartition(5), {"text": 1.0}, 100)
    assert {r.doc_id: pytest.approx(r.score) for r in got.collect()} == want
    order = sorted(want, key=lambda d: (round(want[d], 9), d))
    best = retrieval.lexical(spark.createDataFrame([(1, query)], "query_id int, query string"), spark.createDataFrame(docs, "doc_id int, text string").repartition(5), {"text": 1.0}, 4)
    assert [(r.doc_id, r["rank"]) for r in best.orderBy("rank").collect()] == [(d, i + 1) for i, d in enumerate(order[:4])]


def test_fusion_and_order(spark):
    rows = [(1, 10, "EXACT", 1, 1.0), (1, 11, "LEXICAL", 1, -3.0), (1, 10, "LEXICAL", 4, -1.0), (1, 12, "SEMANTIC", 1, 0.9)]
    got = retrieval.top(retrieval.fuse(spark.createDataFrame(rows, "query_id int, doc_id int, channel string, rank int, score double")), 5).orderBy("final_rank").collect()
    assert [(r.doc_id, r.exact_hit) for r in got] == [(10, True), (11, False), (12, False)] and got[0].fused_score == pytest.approx(4 / 61 + 1.5 / 64)


def test_retrieval_states(spark):
    rows = [(True, "AMBIGUOUS", False, True, False, True), (True, "RESOLVED", True, True, True, True), (True, "RESOLVED", False, True, True, True), (False, None, False, False, True, False), (False, None, False, True, False, True)]
    df = spark.createDataFrame(rows, "a boolean, r string, x boolean, c boolean, e boolean, i boolean")
    got = [r[0] for r in df.select(retrieval.retrieval_state(*[F.col(c) for c in "arxcei"])).collect()]
    assert got == ["VERSION_AMBIGUOUS", "INSUFFICIENT_CORPUS", "PARTIAL_COVERAGE", "INDEX_NOT_READY", "OK"]


def test_recognized_authority(spark):
    authorities = spark.createDataFrame([("civil", "中华人民共和国民法典"), ("x", "某解释"), ("y", "某解释二")], "authority_id string, title string")
    queries = spark.createDataFrame([(1, "民法典第五百条"), (2, "某解释二"), (3, "无")], "query_id int, query string")
    assert {r.query_id: r.authority_id for r in retrieval.recognized_authority(queries, authorities).collect()} == {1: "civil"}
    assert queries.select(retrieval.article_ordinal(F.col("query"))).first()[0] == 500


def test_packing_as_a_loop(spark):
    rng = random.Random(7)
    sizes = [(i, rng.choice([10, 3000, 9000, 18000, 25000])) for i in range(80)]
    want, chunk, chars, n = {}, 1, 0, 0
    for i, s in sizes:
        if n and (chars + s > 18000 or n >= 24 or chars >= 18000):
            chunk, chars, n = chunk + 1, 0, 0
        want[i], chars, n = chunk, chars + s, n + 1
    got = planning.packed_chunks(spark.createDataFrame(sizes, "i int, s int").withColumn("j", F.lit(1)), ["j"], "i", "s")
    assert {r.i: r.chunk for r in got.collect()} == want


def test_related_and_fallback(spark):
    clauses = spark.createDataFrame([("j", f"c{i}", i, "c1" if i in (2, 3) else None, f"价款支付条款{i}" if i % 2 else "其他") for i in range(1, 6)], "job_id string, clause_id string, clause_number int, parent_clause_id string, text string")
    targets = spark.createDataFrame([("j", "i1", "c2")], "job_id string, issue_id string, clause_id string")
    refs = spark.createDataFrame([("j", "c2", "c5", 1)], "job_id string, clause_id string, resolved_target_id string, reference_order int")
    assert {r.related_id for r in planning.related(targets, clauses, refs).collect()} == {"c1", "c3", "c5"}
    got = planning.fallback_targets(spark.createDataFrame([("j", "i1", "价款支付")], "job_id string, issue_id string, text string"), clauses).orderBy("rank").collect()
    assert [r.clause_id for r in got] == ["c1", "c3", "c5"]


def test_metrics(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (True, True), (False, True), (False, False)], "e boolean, o boolean")
    m = quality.binary_metrics(rows, F.col("e"), F.col("o")).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 1, 1) and m.f1 == pytest.approx(2 / 3)
    s = quality.set_metrics(spark.createDataFrame([(["1", "2"], ["1", "x"]), (["3"], ["3"])], "e array<string>, o array<string>"), F.col("e"), F.col("o")).first()
    assert (s.tp, s.fp, s.fn) == (2, 1, 1)
    gates = spark.createDataFrame([("a", "m", "GTE", 0.9), ("b", "none", "GTE", 0.5), ("c", "m", "EQ", 0.8)], "gate_id string, metric_key string, operator string, threshold double")
    assert {r.gate_id: r.reason for r in quality.evaluate_gates(gates, spark.createDataFrame([("m", 0.8)], "metric_key string, value double")).collect()} == {"a": "THRESHOLD_NOT_MET", "b": "METRIC_MISSING", "c": "PASS"}


def test_benchmark_comparisons(spark):
    observed = {"a": 1, "b": ["x", "y"], "c": "Ａ  b", "d": True, "e": None, "x/y": {"~": [5]}}
    cases = [("EXACT", "/a", "1.0"), ("EXACT", "/a", "2"), ("SET_EQUALS", "/b", '["y","x"]'), ("SET_CONTAINS", "/b", '["z"]'), ("NORMALIZED_TEXT_EQUALS", "/c", '"A b"'), ("NUMERIC_WITHIN", "/d", "1"), ("NUMERIC_WITHIN", "/a", "1.05"), ("EXACT", "/none", "1"), ("EXACT", "/e", "null"), ("EXACT", "/x~1y/~0/0", "5"), ("ONE_OF", "/c", '["q"]'), ("SET_EQUALS", "/a", "[1]"), ("NORMALIZED_TEXT_EQUALS", "/a", '"x"'), ("REGEX", "/a", "1")]
    rows = [("c1", "t", [(str(i), p, m, e, 0.1) for i, (m, p, e) in enumerate(cases)]), ("c2", "t", [("0", "/a", "EXACT", "1", None)])]
    x = "case_id string, task_type string, expectations array<struct<assertion_id:string,pointer:string,comparison:string,expected:string,tolerance:double>>"
    got = quality.evaluate_benchmark(spark.createDataFrame(rows, x), spark.createDataFrame([("c1", json.dumps(observed))], "case_id string, observed string")).collect()
    one = {int(r.assertion_id): r.reason for r in got if r.case_id == "c1"}
    assert [one[i] for i in range(14)] == ["MATCH", "EXACT_MISMATCH", "MATCH", "EXPECTED_SET_NOT_CONTAINED", "MATCH", "NUMERIC_COMPARISON_REQUIRES_NUMBERS", "MATCH", "OBSERVED_POINTER_MISSING", "MATCH", "MATCH", "NOT_IN_ALLOWED_ALTERNATIVES", "SET_COMPARISON_REQUIRES_ARRAYS", "TEXT_COMPARISON_REQUIRES_STRINGS", "UNSUPPORTED_COMPARISON_MODE"]
    assert all(r.passed == (r.reason == "MATCH") for r in got)
    assert [r.reason for r in got if r.case_id == "c2"] == ["MISSING_OBSERVATION"]


def test_priority_is_lexicographic():
    flags = list(batch.FLAGS.values())
    for i, w in enumerate(flags):
        assert w > sum(flags[i + 1 :]) + 1023


def test_validation_of_reviews(spark):
    rows = [("SUPPORTED_FINDING", ["c9"], [], False, "EVIDENCE_FOUND", "SUFFICIENT"), ("SUPPORTED_FINDING", [], [], False, "EVIDENCE_FOUND", "SUFFICIENT"), ("NO_MATERIAL_RISK_FOUND", ["c1"], ["l1"], True, "EVIDENCE_FOUND_WITH_LIMITATIONS", "SUFFICIENT"), ("SUPPORTED_FINDING", ["c1"], ["l1"], True, "EVIDENCE_FOUND_WITH_LIMITATIONS", "SUFFICIENT")]
    df = spark.createDataFrame(rows, "state string, contract_ids array<string>, legal_ids array<string>, legal_conclusion boolean, support_state string, sufficiency string")
    df = df.withColumns({"allowed_contract": F.array(F.lit("c1")), "allowed_legal": F.array(F.lit("l1")), "any_uncertain": F.lit(False)})
    got = [(r.rejected, r.final_state, r.added_reasons) for r in review.validate_primary(df).collect()]
    assert got == [("UNKNOWN_CONTRACT_EVIDENCE", None, []), ("SUPPORTED_WITHOUT_EVIDENCE", None, []), (None, "REVIEW_REQUIRED", ["NO_MATERIAL_RISK_NOT_ALLOWED_WITH_INCOMPLETE_EVIDENCE"]), (None, "SUPPORTED_FINDING", ["PARTIAL_LEGAL_CORPUS"])]


def test_closure_and_one_to_one(spark):
    required = spark.createDataFrame([("j", "a"), ("j", "b"), ("j", "c")], "job_id string, target_id string")
    latest = spark.createDataFrame([("j", "a", "CONFIRMED", "f2"), ("j", "b", "CONFIRMED", "f1")], "job_id string, target_id string, state string, report_fingerprint string")
    got = review.closure(required, latest, spark.createDataFrame([("j", "f2")], "job_id string, fingerprint string")).first()
    assert (got.required, got.resolved, got.outstanding, got.stale_latest) == (3, 1, 2, 1)
    issues = lambda *ids: spark.createDataFrame([("j", i) for i in ids], "job_id string, issue_id string")
    assert {r.issue_id for r in review.one_to_one(issues("1", "2"), issues("1", "2", "2"), issues("1", "2", "3")).collect()} == {"2", "3"}


def test_architecture_and_gate(spark):
    rows = [(["AUDIT_PLAN", "PRIMARY_AUDIT"], [], False, True), ([], ["REVIEW_REPORT"], False, True), ([], [], True, False), ([], [], False, True), (["PRIMARY_AUDIT"], [], False, True)]
    df = spark.createDataFrame(rows, "s array<string>, a array<string>, r boolean, ok boolean")
    assert [x[0] for x in df.select(artifacts.architecture(*[F.col(c) for c in ("s", "a", "r", "ok")])).collect()] == ["CONFLICT", "LEGACY_RC2", "CONFLICT", "ISSUE_V1", "LEGACY_RC2"]
    gate = spark.createDataFrame([(False, "AUTO", False), (False, "REQUIRE_APPROVAL", False), (True, "AUTO", True)], "c boolean, m string, a boolean")
    assert [x[0] for x in gate.select(artifacts.provider_gate(F.col("c"), F.col("m"), F.col("a"))).collect()] == ["ALLOWED", "PAUSE", "CANCEL"]


def test_ocr_blocks(spark):
    pages = spark.createDataFrame([("j", 1, [" a ", "", "b"], [1.4, 0.5, None], [[[1, 2], [5, 2], [5, 9]], [], []])], "job_id string, page_number int, texts array<string>, scores array<double>, polygons array<array<array<int>>>")
    got = ingest.ocr_blocks(pages).orderBy("block_index").collect()
    assert [(b.text, b.bbox, b.evidence_id) for b in got] == [("a", [1, 2, 5, 9], "ocr-j-p0001-b0001"), ("b", None, "ocr-j-p0001-b0002")] and got[0].confidence == 1.0 and not got[0].low_confidence


def test_uploads_and_atomic_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", b"%PDF-1.7"), ("b.png", b"no"), ("c.txt", b"x"), ("d.jpg", b""), ("e.jpeg", b"\xff\xd8\xff\xe0")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.path[-5:].lstrip("/n"): r.verdict for r in readers.uploads(spark, str(tmp_path / "in")).collect()}
    assert sorted(got.values()) == ["ACCEPTED", "ACCEPTED", "CONTENT_MISMATCH", "UNSUPPORTED_TYPE"]
    assert readers.accepted(spark.createDataFrame([("x.pdf", 0, b"")], "path string, length long, content binary")).first().verdict == "EMPTY_FILE"
    target = str(tmp_path / "table")
    readers.publish(spark.range(3), target)
    readers.publish(spark.range(5), target)
    assert readers.published(spark, target).count() == 5
    with pytest.raises(Exception):  # noqa: B017
        readers.publish(spark.range(2).select(F.raise_error(F.lit("no"))), target)
    assert readers.published(spark, target).count() == 5


def test_manifest_and_dataset(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"records": [{"authority": {"authority_id": "a", "title": "t"}, "version_id": "v", "effective_date": "2020-01-01", "source_refs": [{"url": "https://x"}], "expected_article_count": 3}]}))
    got = readers.manifest(spark, str(tmp_path / "m.json")).first()
    assert (got.authority.authority_id, got.effective_date, got.source_refs[0].url, got.expected_article_count) == ("a", date(2020, 1, 1), "https://x", 3)
    (tmp_path / "d.json").write_text(json.dumps({"dataset_id": "d", "cases": [{"case_id": "c", "task_type": "t", "expectations": [{"assertion_id": "1", "pointer": "/a", "comparison": "EXACT", "expected": [1]}]}]}))
    assert readers.dataset(spark, str(tmp_path / "d.json")).first().expectations[0].expected == "[1]"


def test_comparison_of_issues(spark):
    """Six pairs with the state and reasons that they have to get."""
    rows = [
        ("SUPPORTED_FINDING", "SUPPORTED", "COVERED", "HIGH", "HIGH", "CONSISTENT", ["PRIMARY_SECONDARY_CONSISTENT"]),
        ("SUPPORTED_FINDING", "PARTIALLY_SUPPORTED", "COVERED_BUT_QUESTIONABLE", "HIGH", "MEDIUM", "CONSISTENT_WITH_REVIEW", ["SECONDARY_PARTIALLY_SUPPORTED", "SECONDARY_COVERAGE_QUESTIONABLE", "SEVERITY_DISTANCE_MINOR"]),
        ("SUPPORTED_FINDING", "DISAGREED", "COVERED", "HIGH", "HIGH", "MATERIAL_DISAGREEMENT", ["SECONDARY_DISAGREED_WITH_PRIMARY"]),
        ("SUPPORTED_FINDING", "SUPPORTED", "COVERED", "CRITICAL", "LOW", "MATERIAL_DISAGREEMENT", ["SEVERITY_DISTANCE_MATERIAL"]),
        ("NO_MATERIAL_RISK_FOUND", "SUPPORTED", "POSSIBLE_OMISSION", "LOW", "LOW", "POSSIBLE_OMISSION", ["SECONDARY_POSSIBLE_OMISSION"]),
        ("REVIEW_REQUIRED", "SUPPORTED", "INSUFFICIENT_EVIDENCE", "LOW", "LOW", "INSUFFICIENT_EVIDENCE", ["ISSUE_EVIDENCE_INSUFFICIENT"]),
        ("REVIEW_REQUIRED", "SUPPORTED", "COVERED", "LOW", "LOW", "REVIEW_REQUIRED", ["MODEL_REVIEW_REQUIRED"]),
    ]
    df = spark.createDataFrame(rows, "primary_state string, assessment string, coverage_assessment string, primary_severity string, secondary_severity string, want string, why array<string>")
    nothing = F.expr("cast(array() as array<string>)")
    df = df.withColumns({"evidence_sufficiency": F.lit("SUFFICIENT"), "contract_alignment": F.lit("AGREE"), "legal_alignment": F.lit("AGREE"), "primary_reasons": nothing, "secondary_reasons": nothing})
    for r in review.compare_issues(df).collect():
        assert (r.overall_state, r.reasons, r.requires_human_review) == (r.want, r.why, r.want != "CONSISTENT")
    promoted = df.limit(1).withColumns({"evidence_sufficiency": F.lit("PARTIAL_LEGAL_CORPUS"), "legal_alignment": F.lit("DISJOINT"), "secondary_reasons": F.array(F.lit("X"))})
    r = review.compare_issues(promoted).first()
    assert (r.overall_state, r.reasons) == ("CONSISTENT_WITH_REVIEW", ["PRIMARY_SECONDARY_CONSISTENT", "PRIMARY_EVIDENCE_PARTIAL_LEGAL_CORPUS", "LEGAL_EVIDENCE_DISJOINT", "UPSTREAM_REVIEW_REASON_PRESENT", "X"])


def test_findings_of_two_reviewers(spark):
    rows = [("SUPPORTED_FINDING", "SUPPORTED", 0, "DISJOINT", "DISJOINT"), ("NO_FINDING", "SUPPORTED", 2, "AGREE", "AGREE"), ("NO_FINDING", "NOT_SUPPORTED", 1, "DISJOINT", "DISJOINT"), ("REVIEW_REQUIRED", "REVIEW_REQUIRED", 1, "AGREE", "AGREE"), ("NO_FINDING", "REVIEW_REQUIRED", 0, "AGREE", "AGREE"), ("REVIEW_REQUIRED", "INSUFFICIENT_EVIDENCE", 0, "AGREE", "AGREE")]
    df = spark.createDataFrame(rows, "p string, a string, d int, c string, l string").withColumn("risk", review.risk_state(F.col("p"), F.col("a")))
    got = review.finding_state(F.col("risk"), F.col("d"), F.col("c"), F.col("l"))
    assert [(r[0], r[1], r[2]) for r in df.select(got["finding_state"], got["material_reasons"], got["follow_up"]).collect()] == [
        ("MATERIAL_DISAGREEMENT", ["LEGAL_BASIS_DISJOINT", "CONTRACT_EVIDENCE_DISJOINT"], True),
        ("MATERIAL_DISAGREEMENT", ["RISK_EXISTENCE_CONFLICT", "SEVERITY_DISTANCE_GTE_2"], True),
        ("MINOR_DISAGREEMENT", ["SEVERITY_DISTANCE_1"], False),
        ("AGREEMENT_WITH_REVIEW", ["AGREE_REVIEW_REQUIRED"], True),
        ("REQUIRES_MORE_EVIDENCE", ["DISAGREE_EVIDENCE_SUFFICIENCY"], True),
        ("REQUIRES_MORE_EVIDENCE", ["STATE_DIFFERENCE"], True),
    ]


def test_jobs_without_a_pipeline(spark):
    jobs = spark.createDataFrame([(True, None, "ISSUE_V1"), (False, None, None), (True, "RUNNING", "CONFLICT"), (True, "RUNNING", "ISSUE_V1")], "document_ok boolean, pipeline_status string, architecture string").withColumns({"score": F.lit(7), "attention_items": F.lit(0)})
    got = [(r.batch_state, r.priority_rank, r.needs_attention, r.failure) for r in batch.job_states(jobs).collect()]
    assert got == [("PROCESSING", 2500, True, "PIPELINE_NOT_STARTED"), ("INVALID", 500_000, True, "DOCUMENT_METADATA_INVALID"), ("INVALID", 500_000, True, "ARCHITECTURE_CONFLICT"), ("PROCESSING", 0, False, None)]


def test_pointers_of_any_document(spark):
    rows = [('{"k": 5, "a": {"b~/c": [1, "x"]}}', "/a/b~0~1c/1", '"x"'), ("{bad", "/k", None), ('{"k": null}', "/k", "null"), ('{"0": 7}', "/0", "7"), ('{"z": 1, "y": {"q": "é"}}', "", '{"y":{"q":"é"},"z":1}'), ("[1]", "/5", None), (None, "/k", None), ("""{"it's": 3}""", "/it's", "3"), ("{}", """/a'"b""", None)]
    df = spark.createDataFrame(rows, "document string, pointer string, want string")
    for r in df.withColumn("got", quality.resolve_pointer("document", "pointer")).collect():
        assert r.got == r.want, r


def packed_by_hand(sizes, most_chars, most_items):
    out, chunk, chars, items = [], 1, 0, 0
    for s in sizes:
        if items and (chars + s > most_chars or items >= most_items or chars >= most_chars):
            chunk, chars, items = chunk + 1, 0, 0
        chars, items = chars + s, items + 1
        out.append(chunk)
    return out


def test_chunks_do_not_depend_on_where_rows_lie(spark):
    import random

    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, 1, 3, 7, 10, 11, 30])) for g, n in (("a", 400), ("b", 3), (None, 90), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, size long").repartition(7)
    for parts in ("4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r.g, r.i): r.chunk for r in planning.packed_chunks(df, ["g"], "i", "size", 10, 4).collect()}
        for g in ("a", "b", None, "c"):
            own = [(i, s) for x, i, s in rows if x == g]
            assert [got[g, i] for i, _ in own] == packed_by_hand([s for _, s in own], 10, 4)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    packed = planning.packed_chunks(df.where("g is not null"), ["g"], "i", "size", 10, 4)
    assert {(r.g, r.problem) for r in planning.packing_problems(packed, ["g"], "size", 20, 50).collect()} >= {("a", "OBJECT_TOO_LARGE"), ("a", "TOO_MANY_CHUNKS")}
    assert planning.packed_chunks(df.limit(0), ["g"], "i", "size").count() == 0


def test_articles_keep_the_last_four_headings(spark):
    text = "\n".join([*(f"第{n}章 标题{n}" for n in "一二三四五六"), "第一条 甲", "乙", "第七章 后", "第二条 丙"])
    got = ingest.articles(spark.createDataFrame([("s", text)], "source string, text string"), "source").orderBy("article_ordinal").collect()
    assert [(r.article_text, r.heading_context[-1], len(r.heading_context)) for r in got] == [("甲\n乙", "第六章 标题六", 4), ("丙", "第七章 后", 4)]


def test_stored_index_finds_as_a_fresh_one(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "第十条 违约金", "合同违约金过高", "h"), (2, "其他", "a😀bcd and more words", "k"), (3, None, None, None), (4, "其他", "ΑΣ ΑΣΑ oder", "k")], "doc_id int, title string, text string, heading string")
    queries = spark.createDataFrame([(1, "违约金"), (2, "a😀bcd"), (3, "xy"), (4, "ΑΣ"), (5, "违约金过"), (6, "😀bcd a"), (7, "A😀bcd"), (8, None), (9, "ΣΑ od")], "query_id int, query string")
    fields = {"title": 4.0, "heading": 2.0, "text": 1.0}
    path = str(tmp_path / "index")
    gram_index.publish(docs, list(fields), path)
    index = gram_index.published(spark, path, docs)
    key = lambda r: (r.query_id, r.doc_id, r["rank"], round(r.score, 9))
    lexical, exact = retrieval.channels(queries, docs, 9, index, fields)
    got = sorted(map(key, lexical.collect()))
    assert got == sorted(map(key, retrieval.lexical(queries, docs, fields, 9).collect())) and {(1, 1), (2, 2), (5, 1), (6, 2)} <= {(q, d) for q, d, _, _ in got}
    assert sorted((r.query_id, r.doc_id) for r in exact.collect()) == [(1, 1), (2, 2), (5, 1), (6, 2), (9, 4)]
    monkeypatch.setattr(gram_index, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(gram_index, "BROADCAST_GRAMS", 3)
    lexical, exact = retrieval.channels(queries, docs, 9, None, fields)
    assert sorted(map(key, lexical.collect())) == got and exact.count() == 5
    with pytest.raises(ValueError, match="stale"):
        gram_index.published(spark, path, docs.limit(1))
    with pytest.raises(Exception):  # noqa: B017  # a build that breaks leaves the index that there is
        gram_index.publish(docs.withColumn("text", F.raise_error(F.lit("broken")).cast("string")), list(fields), path)
    assert gram_index.published(spark, path, docs).documents == 4


def test_blocks_below_the_bound_are_not_scored(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, "".join(rng.choice("abcde ") for _ in range(rng.randrange(5, 90)))) for i in range(200)] + [(1000 + i, "abcabc" * 9) for i in range(60)]
    queries = [(i, "".join(rng.choice("abcde") for _ in range(12))) for i in range(12)] + [(99, "abcabc")]
    frames = spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    key = lambda r: (r.query_id, r.doc_id, r["rank"], round(r.score, 9))
    whole = sorted(map(key, retrieval.lexical(*frames, {"text": 1.0}, 1000).collect()))
    monkeypatch.setattr(gram_index, "SLICE", 300)
    assert sorted(map(key, retrieval.lexical(*frames, {"text": 1.0}, 1000).collect())) == whole
    assert sorted(map(key, retrieval.lexical(*frames, {"text": 1.0}, 3).collect())) == [r for r in whole if r[2] <= 3]
