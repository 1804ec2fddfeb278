import hashlib
import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from docloom.operators import workflow as W


def test_baseline(spark):
    got = W.baseline(spark, spark.createDataFrame([("a", "LEASE"), ("b", "OTHER")], "job_id string, contract_type string"))
    assert {r.job_id: r["count"] for r in got.groupBy("job_id").count().collect()} == {"a": 15, "b": 12}
    assert len(W.GENERAL_TOPICS) == 12 and sum(map(len, W.TYPE_TOPICS.values())) == 21


def test_hash_embedding(spark):
    def plain(text):
        flat, v = "".join(text.lower().split()), [0.0] * 32
        for g in [flat[i : i + 2] for i in range(max(1, len(flat) - 1))]:
            d = hashlib.sha256(g.encode()).digest()
            v[int.from_bytes(d[:4], "big") % 32] += 1 if d[4] % 2 == 0 else -1
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]

    texts = ["合同 成立", "a", "", "Payment terms 30%", "aaaa"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", W.hash_embedding(F.col("text")).alias("v")).orderBy("i").collect()
    for t, r in zip(texts, rows, strict=True):
        assert list(r.v) == pytest.approx(plain(t))
    got = W.embedded(spark.createDataFrame([(1, "x")], "i int, text string"), lambda ts: [[1.0, 2.0] for _ in ts], "p", "m", ["i"])
    assert W.usable_vectors(got, "p", "m", 2).count() == 1 and W.usable_vectors(got, "p", "other", 2).count() == 0


def test_hints(spark):
    hints = spark.createDataFrame([("a", ["1", "2"]), ("b", ["3"]), ("c", [])], "hint string, object_ids array<string>")
    keep = lambda g: {r.hint: r.object_ids for r in W.restricted_hints(hints, F.array(F.lit("1")), g).collect()}
    assert keep(True) == {"a": ["1"], "c": []} and keep(False) == {"a": ["1"]}


def test_draft_summary(spark):
    rows = [("Late Fee", 1, 2, ["b", "a"]), ("late fee", 3, 1, ["c"]), ("LATEFEE", 0, 3, ["a", "d"])]
    got = W.draft_summary(spark.createDataFrame(rows, "topic string, priority_rank int, seq int, object_ids array<string>").withColumn("j", F.lit(1)), "j").first()
    assert (got.topic, got.priority_rank, got.occurrences, got.object_ids) == ("late fee", 3, 3, ["c", "b", "a", "d"])


def test_inspected_evidence(spark):
    versions = spark.createDataFrame([("a", "v1", date(2020, 1, 1), date(2022, 1, 1)), ("a", "v2", date(2022, 1, 1), None)], "authority_id string, version_id string, effective_date date, end_date_exclusive date")
    articles = spark.createDataFrame([("e1", "a", "v1"), ("e2", "a", "v2")], "legal_evidence_id string, authority_id string, version_id string")
    cited = spark.createDataFrame([("x", 1, "e2", date(2023, 1, 1)), ("x", 2, "e1", date(2023, 1, 1)), ("x", 3, "e2", date(2023, 1, 1)), ("y", 1, "no", date(2023, 1, 1))], "action_id string, position int, legal_evidence_id string, as_of date")
    got = {(r.action_id, r.position): (r.verdict, r.returned) for r in W.inspected_evidence(cited, articles, versions).collect()}
    assert got == {("x", 1): ("OK", True), ("x", 2): ("NOT_APPLICABLE", False), ("x", 3): ("OK", False), ("y", 1): ("NOT_FOUND", False)}


def test_tools(spark):
    actions = spark.createDataFrame([("1", "get_clause_context"), ("2", "delete_all"), ("3", "request_ocr_retry")], "action_id string, tool string")
    tools = {"get_clause_context": lambda df: df.withColumn("output_ids", F.array(F.lit("b"), F.lit("a"), F.lit("b")))}
    assert {r.action_id: r.state for r in W.run_tools(actions, tools, 0).collect()} == {"1": "COMPLETED", "2": "REJECTED", "3": "UNAVAILABLE"}
    with pytest.raises(ValueError):
        W.run_tools(actions, tools, 2)


def test_second_review(spark):
    rows = [("i", "i", "SUPPORTED", "COVERED", ["c1"], ["l1"], "NO_MATERIAL_RISK_FOUND", True, "EVIDENCE_FOUND", 1), ("i", "k", "SUPPORTED", "COVERED", ["c1"], ["l1"], "SUPPORTED_FINDING", False, "EVIDENCE_FOUND", 1), ("i", "i", "DISAGREED", "COVERED", [], [], "SUPPORTED_FINDING", False, "NO_MATCH_IN_LOCAL_CORPUS", 0), ("i", "i", "DISAGREED", "POSSIBLE_OMISSION", ["c1"], [], "SUPPORTED_FINDING", False, "EVIDENCE_FOUND", 1)]
    df = spark.createDataFrame(rows, "issue_id string, primary_issue_id string, assessment string, coverage_assessment string, contract_ids array<string>, legal_ids array<string>, primary_state string, primary_conclusion boolean, support_state string, targets int")
    df = df.withColumns({"allowed_contract": F.array(F.lit("c1")), "allowed_legal": F.array(F.lit("l1")), "omission_title": F.lit(None).cast("string"), "omission_reasoning": F.lit(None).cast("string")})
    got = [(r.rejected, r.final_coverage, len(r.added_reasons)) for r in W.validate_secondary(df).collect()]
    assert got == [(None, "COVERED", 0), ("ISSUE_MISMATCH", "COVERED", 0), (None, "INSUFFICIENT_EVIDENCE", 1), ("OMISSION_NOT_STATED", "POSSIBLE_OMISSION", 0)]


def test_small_steps(spark):
    got = W.links(spark.createDataFrame([("j", "a", "a", None)], "job_id string, x string, y string, z string"), [("xy", "x", "y"), ("yz", "y", "z")]).collect()
    assert [(r.link, r.state) for r in got] == [("xy", "READY"), ("yz", "MISSING")]
    p = W.progress(spark.createDataFrame([("j", 1, True), ("j", 2, False), ("j", 3, True), ("j", 4, False)], "job_id string, position int, complete boolean")).orderBy("position")
    assert [r.progress for r in p.collect()] == [10, 10, 38, 38]
    assert W.latest_useful_batch(spark.createDataFrame([("a", 1, ["x"]), ("b", 2, [])], "batch_id string, registered_at int, job_ids array<string>")).first()[0] == "a"
    q = spark.createDataFrame([("Late FEE", "HIGH", True, "CONSISTENT"), ("x", "LOW", False, "CONSISTENT")], "title string, severity string, needs_attention boolean, overall_state string")
    assert W.filtered_queue(q, "MEDIUM", True, "CONSISTENT", "fee").count() == 1 and W.filtered_queue(q).count() == 2
    h = W.combined_hash(spark.createDataFrame([("j", 2, "b"), ("j", 1, "a")], "job_id string, pass_number int, response_hash string"), "job_id").first()
    assert h.combined_hash == hashlib.sha256(b"a\nb").hexdigest()
    u = W.token_usage(spark.createDataFrame([("j", None, 1), ("j", None, 2)], "job_id string, input_tokens int, output_tokens int"), "job_id").first()
    assert (u.input_tokens, u.output_tokens) == (None, 3)
    r = W.uppercase_amounts(spark.createDataFrame([("j", "RMB_WORDS", "壹佰元")], "job_id string, kind string, value string"), spark.createDataFrame([("j",), ("k",)], "job_id string"))
    assert {x.job_id: x.state for x in r.collect()} == {"j": "REVIEW", "k": "NOT_APPLICABLE"}
    m = W.migration_snapshot(spark.createDataFrame([("j", "p", b"x")], "job_id string, path string, content binary"), spark.createDataFrame([("j", "p", hashlib.sha256(b"x").hexdigest()), ("j", "q", "0")], "job_id string, path string, sha256 string"))
    assert {x.path: x.state for x in m.collect()} == {"p": "INTACT", "q": "MISSING"}
