"""Queries on reviews, decisions, batches, quality and streams over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts, batch, quality, review
from ..streaming import logs
from .tables import table


def _pick(column, *values):
    """One of the values by a number's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


def _pick_sql(column: str, *values: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][cast({column} % {len(values)} + 1 as integer)]"


def set_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: a user's event types in even and in odd hours."""
    events = table(spark, sf_dir, "events")
    even = F.hour("ts") % 2 == 0
    sets = events.groupBy("user_id").agg(F.collect_set(F.when(even, F.col("event_type"))).alias("a"), F.collect_set(F.when(~even, F.col("event_type"))).alias("b"))
    out = sets.select("user_id", *[c.alias(n) for n, c in review.set_alignment(F.col("a"), F.col("b")).items()])
    return out.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("shared", "primary_only", "secondary_only")], "alignment")


ALIGNMENT_SQL = """
with p as (select user_id, event_type, bool_or(hour(ts) % 2 = 0) as a, bool_or(hour(ts) % 2 = 1) as b from events group by 1, 2),
g as (select user_id, coalesce(string_agg(event_type, ',' order by event_type) filter (a and b), '') as shared, coalesce(string_agg(event_type, ',' order by event_type) filter (a and not b), '') as primary_only,
    coalesce(string_agg(event_type, ',' order by event_type) filter (b and not a), '') as secondary_only, count(*) filter (a) as na, count(*) filter (b) as nb, count(*) filter (a and b) as n from p group by 1)
select user_id, shared, primary_only, secondary_only, case when na = 0 and nb = 0 then 'BOTH_EMPTY' when nb = 0 then 'PRIMARY_ONLY' when na = 0 then 'SECONDARY_ONLY' when n = na and n = nb then 'AGREE' when n = 0 then 'DISJOINT' else 'PARTIAL_OVERLAP' end as alignment from g
"""

PRIMARY = ("SUPPORTED_FINDING", "NO_MATERIAL_RISK_FOUND", "REVIEW_REQUIRED", "INSUFFICIENT_EVIDENCE", "SUPPORTED_FINDING", "NO_MATERIAL_RISK_FOUND", "SUPPORTED_FINDING")
ASSESSMENT = ("SUPPORTED", "PARTIALLY_SUPPORTED", "SUPPORTED", "DISAGREED", "SUPPORTED", "REVIEW_REQUIRED", "SUPPORTED", "INSUFFICIENT_EVIDENCE", "SUPPORTED", "SUPPORTED", "SUPPORTED")
COVERAGE = ("COVERED", "COVERED", "COVERED_BUT_QUESTIONABLE", "COVERED", "POSSIBLE_OMISSION", "COVERED", "COVERED", "INSUFFICIENT_EVIDENCE", "COVERED", "COVERED", "COVERED", "COVERED", "COVERED")
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
SUFFICIENCY = ("SUFFICIENT", "SUFFICIENT", "PARTIAL_LEGAL_CORPUS")
ALIGNMENTS = ("AGREE", "PARTIAL_OVERLAP", "DISJOINT", "BOTH_EMPTY", "AGREE")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewers' results of an order, derived from its keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    empty = F.expr("cast(array() as array<string>)")
    return table(spark, sf_dir, "orders").select(
        k.alias("issue_id"),
        c.alias("job_id"),
        _pick(k, *PRIMARY).alias("primary_state"),
        _pick(k, *ASSESSMENT).alias("assessment"),
        _pick(k, *COVERAGE).alias("coverage_assessment"),
        _pick(c, *SEVERITIES).alias("primary_severity"),
        _pick(F.floor((c * 3 + k % 2) / 3), *SEVERITIES).alias("secondary_severity"),
        _pick(k, *SUFFICIENCY).alias("evidence_sufficiency"),
        _pick(k, *ALIGNMENTS).alias("contract_alignment"),
        _pick(c, *ALIGNMENTS).alias("legal_alignment"),
        F.when(k % 17 == 0, F.array(F.lit("CHECK_SOURCE"))).otherwise(empty).alias("primary_reasons"),
        F.when(k % 19 == 0, F.array(F.lit("CHECK_SOURCE"), F.lit("CHECK_DATE"))).otherwise(empty).alias("secondary_reasons"),
    )


def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN17, FN20: two reviewers' results compared."""
    out = review.compare_issues(_pairs(spark, sf_dir))
    return out.select("issue_id", "severity_distance", "overall_state", "requires_human_review", F.array_join("reasons", ",").alias("reasons"))


PAIRS_SQL = f"""
pairs as (select o_orderkey as k, o_custkey as job_id, {_pick_sql("o_orderkey", *PRIMARY)} as p, {_pick_sql("o_orderkey", *ASSESSMENT)} as a, {_pick_sql("o_orderkey", *COVERAGE)} as c,
    cast(abs(o_custkey % 5 - ((o_custkey * 3 + o_orderkey % 2) // 3) % 5) as integer) as d, {_pick_sql("o_orderkey", *SUFFICIENCY)} as s, {_pick_sql("o_orderkey", *ALIGNMENTS)} as ca, {_pick_sql("o_custkey", *ALIGNMENTS)} as la,
    o_orderkey % 17 = 0 as r1, o_orderkey % 19 = 0 as r2 from orders),
based as (select *, case when c = 'POSSIBLE_OMISSION' then 'POSSIBLE_OMISSION' when p = 'INSUFFICIENT_EVIDENCE' or a = 'INSUFFICIENT_EVIDENCE' or c = 'INSUFFICIENT_EVIDENCE' then 'INSUFFICIENT_EVIDENCE'
    when a = 'DISAGREED' then 'MATERIAL_DISAGREEMENT' when p = 'REVIEW_REQUIRED' or a = 'REVIEW_REQUIRED' then 'REVIEW_REQUIRED' when d >= 2 then 'MATERIAL_DISAGREEMENT'
    when a = 'PARTIALLY_SUPPORTED' or c = 'COVERED_BUT_QUESTIONABLE' or d = 1 then 'CONSISTENT_WITH_REVIEW' else 'CONSISTENT' end as base from pairs),
compared as (select *, case when base = 'CONSISTENT' and (s <> 'SUFFICIENT' or ca = 'DISJOINT' or la = 'DISJOINT' or r1 or r2) then 'CONSISTENT_WITH_REVIEW' else base end as overall_state,
    concat_ws(',', case base when 'POSSIBLE_OMISSION' then 'SECONDARY_POSSIBLE_OMISSION' when 'INSUFFICIENT_EVIDENCE' then 'ISSUE_EVIDENCE_INSUFFICIENT' when 'REVIEW_REQUIRED' then 'MODEL_REVIEW_REQUIRED'
        when 'MATERIAL_DISAGREEMENT' then case when a = 'DISAGREED' then 'SECONDARY_DISAGREED_WITH_PRIMARY' else 'SEVERITY_DISTANCE_MATERIAL' end when 'CONSISTENT' then 'PRIMARY_SECONDARY_CONSISTENT' end,
        case when base = 'CONSISTENT_WITH_REVIEW' and a = 'PARTIALLY_SUPPORTED' then 'SECONDARY_PARTIALLY_SUPPORTED' end, case when base = 'CONSISTENT_WITH_REVIEW' and c = 'COVERED_BUT_QUESTIONABLE' then 'SECONDARY_COVERAGE_QUESTIONABLE' end,
        case when base = 'CONSISTENT_WITH_REVIEW' and d = 1 then 'SEVERITY_DISTANCE_MINOR' end, case when base = 'CONSISTENT' and s <> 'SUFFICIENT' then 'PRIMARY_EVIDENCE_' || s end,
        case when base = 'CONSISTENT' and ca = 'DISJOINT' then 'CONTRACT_EVIDENCE_DISJOINT' end, case when base = 'CONSISTENT' and la = 'DISJOINT' then 'LEGAL_EVIDENCE_DISJOINT' end,
        case when base = 'CONSISTENT' and (r1 or r2) then 'UPSTREAM_REVIEW_REASON_PRESENT' end, case when r1 or r2 then 'CHECK_SOURCE' end, case when r2 then 'CHECK_DATE' end) as reasons from based)
"""
DECISION_SQL = f"with {PAIRS_SQL} select k as issue_id, d as severity_distance, overall_state, overall_state <> 'CONSISTENT' as requires_human_review, reasons from compared"


def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7: comparisons of a customer summed up."""
    out = review.issue_summary(review.compare_issues(_pairs(spark, sf_dir)).withColumn("planning_coverage_complete", F.col("issue_id") % 23 != 0), "job_id")
    return out.withColumn("final_reasons", F.array_join("final_reasons", ","))


ISSUES_SQL = f"""
with {PAIRS_SQL}, g as (select job_id, {", ".join(f"count(*) filter (overall_state = '{s}') as {s.lower()}" for s in review.STATES)}, count(*) filter (overall_state <> 'CONSISTENT') as human_review, bool_or(k % 23 = 0) as unplanned from compared group by 1)
select * exclude (unplanned), concat_ws(',', case when unplanned then 'PLANNING_COVERAGE_INCOMPLETE' end, {", ".join(f"case when {s.lower()} > 0 then '{s}_PRESENT' end" for s in ("POSSIBLE_OMISSION", "MATERIAL_DISAGREEMENT", "INSUFFICIENT_EVIDENCE", "REVIEW_REQUIRED", "CONSISTENT_WITH_REVIEW"))}) as final_reasons,
    case when human_review > 0 or unplanned then 'HUMAN_REVIEW_REQUIRED' else 'NO_MANDATORY_REVIEW' end as final_state from g
"""


def finding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN18, FN19: the older finding-level tables."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _pick(k, "SUPPORTED_FINDING", "NO_FINDING", "REVIEW_REQUIRED", "INSUFFICIENT_EVIDENCE").alias("p"), _pick(F.floor(k / 4), "SUPPORTED", "NOT_SUPPORTED", "REVIEW_REQUIRED", "INSUFFICIENT_EVIDENCE").alias("a"), (k % 3).alias("d"), _pick(k, *ALIGNMENTS).alias("c"), _pick(F.floor(k / 5), *ALIGNMENTS).alias("l"))
    rows = rows.withColumn("risk", review.risk_state(F.col("p"), F.col("a")))
    found = review.finding_state(F.col("risk"), F.col("d"), F.col("c"), F.col("l"))
    return rows.select("o_orderkey", "risk", F.array_join(found["material_reasons"], ",").alias("material_reasons"), found["finding_state"].alias("finding_state"), found["follow_up"].alias("follow_up"))


FINDING_SQL = f"""
with r as (select o_orderkey, {_pick_sql("o_orderkey", "SUPPORTED_FINDING", "NO_FINDING", "REVIEW_REQUIRED", "INSUFFICIENT_EVIDENCE")} as p, {_pick_sql("(o_orderkey // 4)", "SUPPORTED", "NOT_SUPPORTED", "REVIEW_REQUIRED", "INSUFFICIENT_EVIDENCE")} as a,
    o_orderkey % 3 as d, {_pick_sql("o_orderkey", *ALIGNMENTS)} as c, {_pick_sql("(o_orderkey // 5)", *ALIGNMENTS)} as l from orders),
k as (select *, case when p = 'SUPPORTED_FINDING' and a = 'SUPPORTED' then 'AGREE_SUPPORTED' when p = 'NO_FINDING' and a = 'NOT_SUPPORTED' then 'AGREE_NO_FINDING' when p = 'REVIEW_REQUIRED' and a = 'REVIEW_REQUIRED' then 'AGREE_REVIEW_REQUIRED'
    when p = 'INSUFFICIENT_EVIDENCE' and a = 'INSUFFICIENT_EVIDENCE' then 'AGREE_INSUFFICIENT_EVIDENCE' when (p = 'SUPPORTED_FINDING' and a = 'NOT_SUPPORTED') or (p = 'NO_FINDING' and a = 'SUPPORTED') then 'DISAGREE_RISK_EXISTS'
    when (p in ('REVIEW_REQUIRED', 'INSUFFICIENT_EVIDENCE')) <> (a in ('REVIEW_REQUIRED', 'INSUFFICIENT_EVIDENCE')) then 'DISAGREE_EVIDENCE_SUFFICIENCY' else 'STATE_DIFFERENCE' end as risk from r),
m as (select *, concat_ws(',', case when risk = 'DISAGREE_RISK_EXISTS' then 'RISK_EXISTENCE_CONFLICT' end, case when d >= 2 then 'SEVERITY_DISTANCE_GTE_2' end, case when risk = 'AGREE_SUPPORTED' and l = 'DISJOINT' then 'LEGAL_BASIS_DISJOINT' end, case when risk = 'AGREE_SUPPORTED' and c = 'DISJOINT' then 'CONTRACT_EVIDENCE_DISJOINT' end) as material_reasons from k),
s as (select *, case when material_reasons <> '' then 'MATERIAL_DISAGREEMENT' when risk in ('DISAGREE_EVIDENCE_SUFFICIENCY', 'STATE_DIFFERENCE') then 'REQUIRES_MORE_EVIDENCE' when risk in ('AGREE_REVIEW_REQUIRED', 'AGREE_INSUFFICIENT_EVIDENCE') then 'AGREEMENT_WITH_REVIEW' when d = 1 then 'MINOR_DISAGREEMENT' else 'AGREEMENT' end as finding_state from m)
select o_orderkey, risk, case when finding_state in ('REQUIRES_MORE_EVIDENCE', 'AGREEMENT_WITH_REVIEW') then risk when finding_state = 'MINOR_DISAGREEMENT' then 'SEVERITY_DISTANCE_1' else material_reasons end as material_reasons, finding_state, finding_state in ('MATERIAL_DISAGREEMENT', 'REQUIRES_MORE_EVIDENCE', 'AGREEMENT_WITH_REVIEW') as follow_up from s
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN5: the last event of each user as their decision in force."""
    out = review.latest_revision(_log(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "event_id", "event_type")


LATEST_SQL = "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1"


def revision_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN6: a user's events numbered in order."""
    return review.numbered_revisions(_log(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.col("revision").cast("long").alias("revision"))


NUMBERING_SQL = "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as revision from events"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "P", _pick(F.col("o_orderkey"), "FAILED", "CANCELLED", "PAUSED_BEFORE_PROVIDER")).otherwise("COMPLETE")
    level = lambda p: (F.col("o_orderpriority").startswith(p)).cast("int")
    counts = {"human": F.col("o_orderkey") % 7 == 0, "omissions": (F.col("o_orderkey") % 11 == 0).cast("int"), "material": F.lit(0), "critical": level("1"), "high": level("2") * 2, "insufficient": F.lit(0), "medium": level("3"), "low": level("4"), "info": level("5")}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("File"), F.col("o_custkey").cast("string")).alias("filename"), F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 97 != 0).alias("document_ok"), F.when(F.col("o_orderkey") % 89 != 0, status).alias("pipeline_status"), _pick(F.col("o_custkey"), "ISSUE_V1", "LEGACY_RC2", "ISSUE_V1").alias("architecture"), counts["human"].alias("human_review"), (F.col("o_orderkey") % 13 != 0).alias("coverage_complete"), batch.priority_score(counts).alias("score"), counts["critical"].alias("critical"), counts["high"].alias("high"), counts["omissions"].alias("omissions"), counts["material"].alias("material"))
    return batch.job_states(rows.withColumn("attention_items", F.col("critical") + F.col("high") + F.col("omissions")))


JOBS_SQL = """
c as (select *, cast(o_orderkey % 7 = 0 as integer) as human, cast(o_orderkey % 11 = 0 as integer) as omissions, cast(starts_with(o_orderpriority, '1') as integer) as critical, 2 * cast(starts_with(o_orderpriority, '2') as integer) as high,
    cast(starts_with(o_orderpriority, '3') as integer) as medium, cast(starts_with(o_orderpriority, '4') as integer) as low, cast(starts_with(o_orderpriority, '5') as integer) as info,
    case when o_orderkey % 89 <> 0 then case when o_orderstatus = 'O' then 'RUNNING' when o_orderstatus = 'P' then ['FAILED', 'CANCELLED', 'PAUSED_BEFORE_PROVIDER'][cast(o_orderkey % 3 + 1 as integer)] else 'COMPLETE' end end as status from orders),
s as (select *, human * 131072 + omissions * 65536 + critical * 16384 + cast(high > 0 as integer) * 8192 + medium * 2048 + low * 1024 + least(1023, omissions + critical + high + medium + low + info) as score,
    case when o_orderkey % 97 = 0 then 'INVALID' when status is null then 'PROCESSING' when status in ('FAILED', 'CANCELLED') then status when status = 'PAUSED_BEFORE_PROVIDER' then 'WAITING' when status <> 'COMPLETE' then 'PROCESSING' else 'COMPLETE' end as batch_state from c),
jobs as (select *, case when o_orderkey % 97 <> 0 and status is null then 2500 else case batch_state when 'COMPLETE' then score when 'INVALID' then 500000 when 'FAILED' then 4000 when 'WAITING' then 3000 when 'CANCELLED' then 2000 else 0 end end as priority_rank,
    case when o_orderkey % 97 = 0 then 'DOCUMENT_METADATA_INVALID' when status is null then 'PIPELINE_NOT_STARTED' end as failure,
    case when o_orderkey % 97 <> 0 and status is null then true when batch_state = 'COMPLETE' then critical + high + omissions > 0 else batch_state in ('INVALID', 'FAILED', 'WAITING') end as needs_attention from s)
"""


def priority_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN24, FN25, TK7: orders as jobs, with their state and strict rank."""
    return batch.queue(_jobs(spark, sf_dir)).select("job_id", "batch_state", F.col("priority_rank").cast("long").alias("priority_rank"), "needs_attention", "failure")


PRIORITY_SQL = f"with {JOBS_SQL} select o_orderkey as job_id, batch_state, cast(priority_rank as bigint) as priority_rank, needs_attention, failure from jobs"


def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8, AG9: a customer's jobs as a batch."""
    return batch.roll_up(_jobs(spark, sf_dir), "o_custkey")


BATCH_SQL = f"""
with {JOBS_SQL} select o_custkey, count(*) as total_jobs, count(*) filter (batch_state = 'COMPLETE') as complete_jobs, count(*) filter (batch_state = 'WAITING') as waiting_jobs, count(*) filter (batch_state = 'CANCELLED') as cancelled_jobs,
    count(*) filter (batch_state in ('FAILED', 'INVALID')) as failed_jobs, count(*) filter (human = 1 and batch_state = 'COMPLETE') as human_review_required_jobs, count(*) filter (batch_state = 'PROCESSING') as processing_jobs,
    count(*) filter (o_custkey % 3 <> 1) as issue_v1_jobs, count(*) filter (o_custkey % 3 = 1) as legacy_rc2_jobs, count(*) filter (o_orderkey % 13 = 0) as coverage_incomplete_jobs from jobs group by 1
"""


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10: quality labels against a fixed rule on the text."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    out = quality.binary_metrics(rows, F.col("quality") == 1, ~F.col("text").rlike(r"\*\*\*|!!|\|"), "lang")
    return out.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


BINARY_SQL = r"""
with p as (select lang, quality = 1 as e, not regexp_matches("text", '\*\*\*|!!|\|') as o from labels join documents using (doc_id)),
g as (select lang, count(*) filter (e and o) as tp, count(*) filter (not e and o) as fp, count(*) filter (e and not o) as fn, count(*) filter (not e and not o) as tn from p group by 1),
r as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as c from g)
select lang, tp, fp, fn, tn, round(p, 6) as precision, round(c, 6) as recall, round(case when p + c = 0 then 0.0 else 2 * p * c / (p + c) end, 6) as f1 from r
"""


def set_extraction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11: event types of a user in even hours, expected, against those in odd hours, observed."""
    even = F.hour("ts") % 2 == 0
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(even, F.col("event_type"))).alias("a"), F.collect_set(F.when(~even, F.col("event_type"))).alias("b"))
    out = quality.set_metrics(sets, F.col("a"), F.col("b"))
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


SETS_SQL = """
with p as (select user_id, event_type, bool_or(hour(ts) % 2 = 0) as a, bool_or(hour(ts) % 2 = 1) as b from events group by 1, 2),
g as (select count(*) filter (a and b) as tp, count(*) filter (b and not a) as fp, count(*) filter (a and not b) as fn from p), r as (select *, tp / (tp + fp) as p, tp / (tp + fn) as c from g)
select tp, fp, fn, round(p, 6) as precision, round(c, 6) as recall, round(2 * p * c / (p + c), 6) as f1 from r
"""

GATES = [("g1", "mean_value", "GTE", 0.0), ("g2", "distinct_types", "EQ", 4.0), ("g3", "largest_value", "LTE", 1.0), ("g4", "not_measured", "GTE", 0.5)]


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12, FN16: metrics of the events against gates, one of which has no metric."""
    one = table(spark, sf_dir, "events").agg(F.avg("value").alias("mean_value"), F.count_distinct("event_type").cast("double").alias("distinct_types"), F.max("value").alias("largest_value"))
    metrics = one.unpivot([], ["mean_value", "distinct_types", "largest_value"], "metric_key", "value")
    out = quality.evaluate_gates(spark.createDataFrame(GATES, "gate_id string, metric_key string, operator string, threshold double"), metrics)
    return out.select("gate_id", "metric_key", F.round("value", 6).alias("value"), "passed", "reason")


GATES_SQL = f"""
with m as (select 'mean_value' as metric_key, avg(value) as value from events union all select 'distinct_types', count(distinct event_type) from events union all select 'largest_value', max(value) from events),
g(gate_id, metric_key, operator, threshold) as (values {", ".join(map(str, GATES))}),
r as (select g.*, value, coalesce(case operator when 'GTE' then value >= threshold when 'LTE' then value <= threshold else abs(value - threshold) <= 1e-12 end, false) as passed from g left join m on g.metric_key = m.metric_key)
select gate_id, metric_key, round(value, 6) as value, passed, case when value is null then 'METRIC_MISSING' when passed then 'PASS' else 'THRESHOLD_NOT_MET' end as reason from r
"""


def json_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN14, FN15: properties of events by pointer, held against 50 within 25; one mode in seven is none that is known."""
    rows = table(spark, sf_dir, "events").select("event_id", quality.resolve_pointer(F.col("props"), F.when(F.col("event_id") % 5 == 0, "/none").otherwise("/k")).alias("observed"))
    rows = rows.withColumns({"comparison": F.when(F.col("event_id") % 7 == 0, "CONTAINS_TEXT").otherwise("NUMERIC_WITHIN"), "expected": F.lit("50"), "tolerance": F.lit(25.0)})
    return quality.compare(rows).select("event_id", "observed", "passed", "reason")


POINTER_SQL = """
with o as (select event_id, json_extract_string(props, case when event_id % 5 = 0 then '/none' else '/k' end) as observed from events)
select event_id, observed, observed is not null and event_id % 7 <> 0 and abs(cast(observed as double) - 50) <= 25 as passed,
    case when observed is null then 'OBSERVED_POINTER_MISSING' when event_id % 7 = 0 then 'UNSUPPORTED_COMPARISON_MODE' when abs(cast(observed as double) - 50) > 25 then 'OUTSIDE_TOLERANCE' else 'MATCH' end as reason from o
"""


def orphan_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, JN15: documents without a label, and labels by language."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    without = docs.join(labels, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("documents")).withColumn("kind", F.lit("UNLABELLED"))
    having = docs.join(labels, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("documents")).withColumn("kind", F.lit("LABELLED"))
    return without.unionByName(having)


ORPHAN_SQL = "select lang, count(*) as documents, case when doc_id in (select doc_id from labels) then 'LABELLED' else 'UNLABELLED' end as kind from documents group by lang, kind"


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN19: orders' stored numbers of lines against the lines there are."""
    now = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.sha2(F.count("*").cast("string"), 256).alias("fingerprint")).withColumn("artifact", F.lit("lines"))
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("order").alias("artifact"), F.lit("lines").alias("upstream"), F.sha2((F.col("o_orderkey") % 7 + 1).cast("string"), 256).alias("upstream_fingerprint"))
    return artifacts.freshness(stored, now).select("job_id", "state")


FRESH_SQL = """
with n as (select l_orderkey, count(*) as n from lineitem group by 1)
select o_orderkey as job_id, case when n is null then 'MISSING_UPSTREAM' when n = o_orderkey % 7 + 1 then 'READY' else 'STALE' end as state from orders left join n on l_orderkey = o_orderkey
"""


def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type; the same function serves a stream with a watermark."""
    out = logs.tumbling(table(spark, sf_dir, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


TUMBLING_SQL = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by date_trunc('hour', ts), event_type"


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, half a day apart at least."""
    out = logs.sessions(table(spark, sf_dir, "events"), "12 hours")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


SESSION_SQL = """
with b as (select *, case when ts - lag(ts) over w < interval '12 hours' then 0 else 1 end as first from events window w as (partition by user_id order by ts)),
s as (select *, sum(first) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from b)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as events from s group by user_id, k
"""


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG26: line numbers that an order has twice."""
    return quality.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


DUPLICATE_SQL = "select l_orderkey, l_linenumber, count(*) as times from lineitem group by 1, 2 having count(*) > 1"

QUERIES = {
    "set_alignment": (set_alignment, ALIGNMENT_SQL),
    "decision_table": (decision_table, DECISION_SQL),
    "issue_summary": (issue_summary, ISSUES_SQL),
    "finding_table": (finding_table, FINDING_SQL),
    "latest_revision": (latest_revision, LATEST_SQL),
    "revision_numbering": (revision_numbering, NUMBERING_SQL),
    "priority_rank": (priority_rank, PRIORITY_SQL),
    "batch_rollup": (batch_rollup, BATCH_SQL),
    "binary_metrics": (binary_metrics, BINARY_SQL),
    "set_extraction_metrics": (set_extraction_metrics, SETS_SQL),
    "quality_gates": (quality_gates, GATES_SQL),
    "json_pointer": (json_pointer, POINTER_SQL),
    "orphan_detection": (orphan_detection, ORPHAN_SQL),
    "freshness": (freshness, FRESH_SQL),
    "tumbling_events": (tumbling_events, TUMBLING_SQL),
    "session_events": (session_events, SESSION_SQL),
    "duplicate_keys": (duplicate_keys, DUPLICATE_SQL),
}
