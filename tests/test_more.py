"""Functions that no query runs, in small cases whose results follow from their definitions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import artifacts, batch, corpus, extraction, findings, ingest, planning, quality, review, workflow
from docloom.sources import readers


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, X.normalized(F.lit("\n a  \r\nb \t\r c\n"))) == "a\nb\n c"
    assert one(spark, X.snapshot(F.lit("\ufeffa\r\nb  "))) == "a\nb\n"
    assert one(spark, X.join_present(F.lit("a"), F.lit("  "), F.lit("b"))) == "a\nb"
    assert one(spark, X.compact_decimal(F.lit("1200.500000"))) == "1200.5" and one(spark, X.compact_decimal(F.lit("100"))) == "100"
    assert one(spark, X.canonical_json(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")))) == '{"a":1,"b":null}'
    assert X.contract_number("12") is None and X.contract_number("十二") == 12 and X.chinese_number("万") == 10_000 and X.chinese_number("²") is None
    assert one(spark, X.trigrams(F.lit("A😀bcd"))) == ["a😀b", "😀bc", "bcd"]
    assert one(spark, X.packed_trigram(F.lit("a😀b"))) == (97 << 42) | (0x1F600 << 21) | 98


def test_readers_with_handed_in_functions(spark, tmp_path):
    files = spark.createDataFrame([("a/x.PDF", 4, bytearray(b"%PDF")), ("b/y.png", 8, bytearray(b"\x89PNG\r\n\x1a\n")), ("c/z.jpg", 3, bytearray(b"GIF")), ("d/e.txt", 1, bytearray(b"x")), ("f/g.pdf", 0, bytearray(b""))], "path string, length long, content binary")
    got = readers.accepted(files).orderBy("path")
    assert [r.verdict for r in got.collect()] == ["ACCEPTED", "ACCEPTED", "CONTENT_MISMATCH", "UNSUPPORTED_TYPE", "EMPTY_FILE"]
    good = got.where("verdict = 'ACCEPTED'")
    assert [(r.path, r.page_number, r.route) for r in readers.image_pages(good).collect()] == [("b/y.png", 1, "OCR_REQUIRED")]
    pages = readers.pdf_pages(good, lambda content: [content.decode()[1:], None]).orderBy("page_number").collect()
    assert [(r.page_number, r.text) for r in pages] == [(1, "PDF"), (2, None)]
    images = spark.createDataFrame([("j", 1, bytearray(b"ab"))], "job_id string, page_number int, image binary")
    seen = readers.recognized(images, lambda image: ([image.decode()], [0.5], [[[0, 0], [2, 2]]]), parallel=2)
    blocks = ingest.ocr_blocks(seen).collect()
    assert [(b.text, b.bbox, b.low_confidence) for b in blocks] == [("ab", [0, 0, 2, 2], True)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text("one\ntwo\n")
    assert [r.snapshot_text for r in readers.snapshots(spark, str(tmp_path / "s")).collect()] == ["one\ntwo\n"]
    (tmp_path / "s" / "left.tmp").write_text("x")
    assert [r.length for r in readers.residue(spark, str(tmp_path / "s")).collect()] == [1]


def test_versions_are_published_in_one_step(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        readers.published(spark, path)
    readers.publish(spark.range(3), path)
    old = readers.published(spark, path)
    readers.publish(spark.range(5), path)
    assert old.count() == 3 and readers.published(spark, path).count() == 5
    with pytest.raises(Exception, match="no such"):
        readers.publish(spark.range(1).select(F.raise_error(F.lit("no such")).alias("x")), path)
    assert readers.published(spark, path).count() == 5
    readers.publish(spark.range(7), path)
    assert readers.published(spark, path).count() == 7 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) <= 3


def test_corpus_edges(spark):
    requests = spark.createDataFrame([("a", date(2021, 1, 1)), ("zz", date(2021, 1, 1))], "authority_id string, as_of date")
    authorities = spark.createDataFrame([("a", "A")], "authority_id string, title string")
    assert [r.authority_id for r in corpus.unknown_authorities(requests, authorities).collect()] == ["zz"]
    versions = spark.createDataFrame([("a", "v1", "EFFECTIVE", "FULL_TEXT"), ("a", "v2", "REPEALED", "CURATED_EXCERPT")], "authority_id string, version_id string, status string, coverage_type string")
    articles = spark.createDataFrame([("a", "v1", "第一条"), ("a", "v2", "第一条"), ("a", "v2", "第二条")], "authority_id string, version_id string, token string")
    assert tuple(corpus.summary(authorities, versions, articles).first()) == (1, 2, 1, 1, 3)
    assert {(r.version_id, r.token, r.title, r.status) for r in corpus.evidence(articles, versions, authorities).collect()} == {("v1", "第一条", "A", "EFFECTIVE"), ("v2", "第一条", "A", "REPEALED"), ("v2", "第二条", "A", "REPEALED")}


def test_artifacts_of_jobs(spark):
    expected = spark.createDataFrame([("j", "PLAN"), ("j", "REPORT"), ("k", "PLAN"), ("k", "REPORT")], "job_id string, artifact string")
    there = spark.createDataFrame([("j", "PLAN", "j"), ("j", "REPORT", None), ("k", "PLAN", "j")], "job_id string, artifact string, own_job_id string")
    assert [r.state for r in artifacts.integrity(expected, there).orderBy("job_id", "artifact").collect()] == ["READY", "CORRUPT", "MISMATCH", "MISSING"]
    contexts = spark.createDataFrame([("j", "1", "f"), ("j", "2", "g")], "job_id string, issue_id string, context_fingerprint string")
    done = spark.createDataFrame([("j", "1", "f"), ("j", "2", "old")], "job_id string, issue_id string, context_fingerprint string")
    assert [r.issue_id for r in artifacts.remaining(contexts, done).collect()] == ["2"]
    for status, after, may in (("RUNNING", "FAILED", False), ("CANCEL_REQUESTED", "CANCELLED", False), ("COMPLETE", "COMPLETE", False), ("FAILED", "FAILED", True)):
        assert one(spark, artifacts.reconciled(F.lit(status))) == after and one(spark, artifacts.migratable(F.lit(status))) == may
    stages = spark.createDataFrame([("j", "a", True), ("j", "b", True), ("j", "c", False), ("j", "d", True)], "job_id string, stage string, required boolean")
    valid = spark.createDataFrame([("j", "a", True), ("j", "b", False)], "job_id string, stage string, valid boolean")
    assert [r.state for r in artifacts.stage_states(stages, valid).orderBy("stage").collect()] == ["READY", "INVALID", "NOT_REQUIRED", "MISSING"]
    joined = artifacts.read_model(contexts.select("job_id", "issue_id"), done.select("job_id", "issue_id", "context_fingerprint"))
    assert joined.count() == 2
    manifest = artifacts.release_manifest(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "yy")], "path string, content string")).orderBy("size").collect()
    assert [(r.paths, r.size) for r in manifest] == [(["a", "b"], 1), (["c"], 2)]


def test_ingest_edges(spark):
    pages = spark.createDataFrame([("j", 1, "NATIVE_TEXT"), ("j", 2, "OCR_REQUIRED"), ("j", 3, "OCR_REQUIRED")], "job_id string, page_number int, route string")
    native = spark.createDataFrame([("j", 1, 1, "n1"), ("j", 2, 1, "ignored")], "job_id string, page_number int, idx int, text string")
    ocr = spark.createDataFrame([("j", 2, 1, "o1"), ("j", 1, 1, "never")], "job_id string, page_number int, idx int, text string")
    got = ingest.evidence_stream(pages, native, ocr).orderBy("order_index").collect()
    assert [(r.text, r.source_method, r.unit_id) for r in got] == [("n1", "NATIVE_TEXT", "unit-p0001-0001"), ("o1", "OCR", "unit-p0002-0002")]
    assert [r.page_number for r in ingest.missing_ocr(pages, ocr.select("job_id", "page_number")).collect()] == [3]
    rows = [("j", "OCR_COMPLETE", 0.9), ("j", "OCR_FAILED", None), ("k", "OCR_FAILED", None), ("l", "OCR_NO_TEXT", None), ("l", "NATIVE_RETAINED", None), ("m", "OCR_LOW_CONFIDENCE", 0.5), ("n", "OCR_FAILED", None), ("n", "NATIVE_RETAINED", None), ("o", "NATIVE_RETAINED", None)]
    states = spark.createDataFrame(rows, "job_id string, state string, mean_confidence double")
    assert [(r.job_id, r.status) for r in ingest.ocr_summary(states).orderBy("job_id").collect()] == [("j", "partial"), ("k", "failed"), ("l", "partial"), ("m", "complete"), ("n", "partial"), ("o", "complete")]
    units = ingest.evidence_units(spark.createDataFrame([(1, "\u3000 a b \n\n😀c\t"), (2, None)], "id int, text string"), "id").collect()
    assert [(u.unit_order, u.unit_text, u.char_start, u.char_end) for u in units] == [(1, "a b", 2, 5), (2, "😀c", 8, 10)]


def test_clause_helpers(spark):
    table = spark.createDataFrame([("a\tb\t",), ("\t\tx",), ("plain",)], "unit_text string")
    assert [(r.unit_text, r.cells) for r in extraction.table_candidates(table).collect()] == [("a\tb\t", 2)]
    pages = spark.createDataFrame([("j", "p1", "page")], "job_id string, evidence_id string, text string")
    blocks = spark.createDataFrame([("j", "b1", "block")], "job_id string, evidence_id string, text string")
    spans = spark.createDataFrame([("j", "o1", 1, ["p1", "b1"]), ("j", "o2", 2, ["b1"])], "job_id string, object_id string, object_order int, evidence_ids array<string>")
    wanted = spark.createDataFrame([("j", "p1"), ("j", "b1"), ("j", "none")], "job_id string, evidence_id string")
    got = {r.evidence_id: (r.origin, r.first_object, r.found) for r in extraction.resolve_evidence(wanted, pages, blocks, spans).collect()}
    assert got == {"p1": ("PAGE", "o1", True), "b1": ("OCR_BLOCK", "o1", True), "none": (None, None, False)}


def test_planning_helpers(spark):
    sizes = spark.createDataFrame([("j", 60), ("j", 50), ("k", 100)], "job string, n int")
    assert {r.job: r.state for r in planning.within_budget(sizes, ["job"], "n", 100).collect()} == {"j": "OVER_BUDGET", "k": "WITHIN_BUDGET"}
    assert [one(spark, planning.preview_limit(F.lit(n))) for n in (10, 1000, 10_000)] == [180, 36, 24]
    drafts = spark.createDataFrame([("j", 1, " A  b"), ("j", 2, "a B"), ("j", 3, " "), ("j", 4, "x" * 9)], "job string, n int, text string")
    assert [(r.n, r.error) for r in planning.cleaned_drafts(drafts, ["job"], "text", "n", 8).orderBy("n").collect()] == [(1, None), (3, "BLANK"), (4, "TOO_LONG")]
    hints = spark.createDataFrame([("r1", "FAIL", ["a", "b"]), ("r2", "PASS", ["a"]), ("r3", "REVIEW", [])], "rule_id string, state string, object_ids array<string>")
    kept = workflow.rule_hints(hints)
    chunk = F.array(F.lit("b"), F.lit("c"))
    assert {r.rule_id: r.object_ids for r in workflow.restricted_hints(kept, chunk, True).collect()} == {"r1": ["b"], "r3": []}
    assert [r.rule_id for r in workflow.restricted_hints(kept, chunk, False).collect()] == ["r1"]
    kinds = workflow.classification_summary(spark.createDataFrame([("j", "SALE", "HIGH"), ("j", "SALE", "HIGH")], "job string, contract_type string, confidence string"), "job").collect()
    assert [(r.classification, r.local_pass_count) for r in kinds] == [("SALE/HIGH", 2)]


def test_reviews_and_batches(spark):
    for targets, uncertain, support, want in ((0, False, "EVIDENCE_FOUND", "CONTRACT_EVIDENCE_INSUFFICIENT"), (1, True, "EVIDENCE_FOUND", "SOURCE_UNCERTAIN"), (1, False, "VERSION_REVIEW_REQUIRED", "LEGAL_VERSION_UNCERTAIN"), (1, False, "NO_MATCH_IN_LOCAL_CORPUS", "INSUFFICIENT_LEGAL_CORPUS"), (1, False, "EVIDENCE_FOUND_WITH_LIMITATIONS", "PARTIAL_LEGAL_CORPUS"), (1, False, "EVIDENCE_FOUND", "SUFFICIENT")):
        assert one(spark, review.evidence_sufficiency(F.lit(targets), F.lit(uncertain), F.lit(support))) == want
    found = spark.createDataFrame([("j", "f1", True, "DISAGREE_RISK_EXISTS", "AGREE", "AGREE", ["c2", "c1"], ["l"]), ("j", "f2", True, "AGREE_SUPPORTED", "AGREE", "DISJOINT", ["c"], ["l2"]), ("j", "f3", False, "DISAGREE_RISK_EXISTS", "AGREE", "AGREE", ["c"], [])], "job_id string, finding_id string, follow_up boolean, risk_state string, contract_alignment string, legal_alignment string, contract_ids array<string>, legal_ids array<string>")
    none = spark.createDataFrame([], "job_id string, omission_id string, contract_ids array<string>, legal_ids array<string>")
    assert [(r.tool, r.arguments, r.reason, r.rank) for r in review.follow_up_plan(found, none).orderBy("rank").collect()] == [("inspect_contract_evidence", "c2,c1", "f1", 1), ("inspect_legal_evidence", "l2", "f2", 2)]
    omitted = spark.createDataFrame([("j", "o1", ["c9"], ["l9"])], "job_id string, omission_id string, contract_ids array<string>, legal_ids array<string>")
    assert [r.reason for r in review.follow_up_plan(found, omitted).orderBy("rank").collect()] == ["o1", "f1"]
    results = spark.createDataFrame([("j", "SUPPORTED_FINDING", "HIGH"), ("j", "NO_FINDING", "HIGH"), ("j", "SUPPORTED_FINDING", None)], "job string, state string, severity string")
    assert batch.severity_histogram(results, "job").first().high == 1 and batch.severity_histogram(results, "job", finding_only=False).first().high == 2
    jobs = spark.createDataFrame([("b.pdf", 1, 5), ("A.pdf", 2, 5), ("c.pdf", 3, 9)], "filename string, job_id int, priority_rank int")
    assert [r.job_id for r in batch.queue(jobs).collect()] == [3, 2, 1]


def test_quality_helpers(spark):
    rows = spark.createDataFrame([("OCR", "1", "a", True), ("OCR", "1", "b", False), ("X", "2", "a", True)], "task_type string, case_id string, assertion_id string, passed boolean")
    assert tuple(quality.pass_rates(rows).first()) == (0.5, 2 / 3, 2)
    queries = spark.createDataFrame([(1, True), (2, True), (3, False)], "query_id int, hinted boolean")
    hits = spark.createDataFrame([(1, 1, True), (2, 1, False), (2, 2, True)], "query_id int, rank int, exact_hit boolean")
    assert tuple(quality.exact_hit_rate(queries, hits).first()) == (2, 0.5)
    cases, seen = spark.createDataFrame([("1",)], "case_id string"), spark.createDataFrame([("1",), ("9",)], "case_id string")
    assert [r.case_id for r in quality.unused_observations(cases, seen).collect()] == ["9"]
    files = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 2, 5)], "name string, size int, modified int")
    assert quality.first_of_each(files, ["name", "size", "modified"], ["name"]).count() == 2


def test_findings_helpers(spark):
    span = "array<struct<evidence_ids:array<string>,source_method:string,confidence:double>>"
    clauses = spark.createDataFrame([("j", "c1", "text", [(["e1", "e2"], "NATIVE_TEXT", None)])], f"job_id string, clause_id string, text string, spans {span}")
    blocks = spark.createDataFrame([("j", "b1", "other", [(["e2"], "OCR", 0.5), (["e2", "e3"], "OCR", 0.9)])], f"job_id string, block_id string, text string, spans {span}")
    items = findings.contract_items(clauses, blocks)
    assert {r.canonical_object_id: (r.object_type, r.evidence_ids, r.source_uncertain) for r in items.collect()} == {"c1": ("CLAUSE", ["e1", "e2"], False), "b1": ("UNNUMBERED_BLOCK", ["e2", "e3"], True)}
    assert [(r.order_index, r.canonical_object_id, r.text_chars) for r in findings.clause_index(items, "canonical_object_id").orderBy("order_index").collect()] == [(1, "b1", 5), (2, "c1", 4)]
    issues = spark.createDataFrame([("j", "i", ["r2", "r1", "gone"])], "job_id string, issue_id string, rule_result_ids array<string>")
    results = spark.createDataFrame([("j", "r1", "FAIL"), ("j", "r2", "REVIEW")], "job_id string, result_id string, state string")
    assert [(r.result_id, r.state, r.missing) for r in findings.rule_hints(issues, results).orderBy("position").collect()] == [("r2", "REVIEW", False), ("r1", "FAIL", False), ("gone", None, True)]
    contexts = spark.createDataFrame([(0, 10), (1, 200), (1, 10)], "targets int, context_chars int")
    assert [(r.state, r.review_reason) for r in findings.terminal_rows(contexts, 100).collect()] == [("INSUFFICIENT_EVIDENCE", "NO_RELEVANT_CONTRACT_EVIDENCE_SELECTED"), ("REVIEW_REQUIRED", "ISSUE_CONTEXT_BUDGET_EXCEEDED"), (None, None)]
    plan = spark.createDataFrame([("j", "3", "b", "NORMAL"), ("j", "2", "b", "HIGH_ATTENTION"), ("j", "1", "a", "NORMAL")], "job_id string, issue_id string, topic string, priority string")
    assert [r.issue_id for r in findings.plan_order(plan).orderBy("position").collect()] == ["2", "1", "3"]
    hits = spark.createDataFrame([("i", "x", 2, True, 0.5), ("i", "y", 1, False, 0.9), ("i", "z", 1, True, 0.1), ("i", "w", 1, False, 0.9)], "issue string, doc_id string, best_rank int, exact_hit boolean, fused_score double")
    assert [r.doc_id for r in findings.hit_order(hits, "issue").orderBy("position").collect()] == ["z", "w", "y", "x"]
    seen = spark.createDataFrame([("1", True, None, False), ("2", True, "CONFIRMED", True), ("3", True, "CONFIRMED", False), ("4", False, None, False)], "issue_id string, requires_human_review boolean, human_decision_state string, human_decision_stale boolean")
    assert [r.issue_id for r in findings.needs_attention(seen).collect()] == ["1", "2"]
    assert one(spark, findings.indexed_text(F.lit("T"), F.lit("第一条"), F.array(F.lit("A"), F.lit("B")), F.lit("x "))) == "T 第一条 A B x"
