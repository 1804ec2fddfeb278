"""Queries on findings, evidence look-ups and workspace states, made from the orders' columns, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings, planning
from . import contracts
from .reviews import _pick, _pick_sql
from .tables import table

STATES = ("SUPPORTED_FINDING", "NO_FINDING", "REVIEW_REQUIRED", "INSUFFICIENT_EVIDENCE", "SUPPORTED_FINDING")
ASSESSMENTS = ("SUPPORTED", "NOT_SUPPORTED", "REVIEW_REQUIRED", "SUPPORTED", "INSUFFICIENT_EVIDENCE", "SUPPORTED", "SUPPORTED")
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def _ids(prefix: str, *numbers: str):
    """An array of ids; the SQL on the other side is a list of the same strings."""
    return F.array(*[F.expr(f"concat('{prefix}', {n})") for n in numbers])


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey as job_id", "o_orderkey as finding_id", "o_orderkey as k")
    k, empty = F.col("k"), F.expr("cast(array() as array<string>)")
    first = orders.where("k % 50 <> 0").select("job_id", "finding_id", _pick(k, *STATES).alias("state"), _pick(k, *SEVERITIES).alias("severity"), _ids("c", "k % 4", "k % 3").alias("contract_ids"), F.when(k % 6 == 0, empty).otherwise(_ids("l", "k % 4")).alias("legal_ids"))
    second = orders.where("k % 51 <> 0").select(
        "job_id", "finding_id", _pick(F.floor(k / 5), *ASSESSMENTS).alias("assessment"), _pick(k + F.when(k % 7 == 0, F.floor(k / 7) % 3).otherwise(0), *SEVERITIES).alias("severity"), _ids("c", "k % 4", "k % 5").alias("contract_ids"), F.when(k % 9 == 0, empty).otherwise(_ids("l", "k % 8")).alias("legal_ids")
    )
    return first, second


def _align_sql(a: str, b: str) -> str:
    return f"""case when len({a}) = 0 and len({b}) = 0 then 'BOTH_EMPTY' when len({b}) = 0 then 'PRIMARY_ONLY' when len({a}) = 0 then 'SECONDARY_ONLY'
        when list_sort(list_distinct({a})) = list_sort(list_distinct({b})) then 'AGREE' when len(list_intersect({a}, {b})) = 0 then 'DISJOINT' else 'PARTIAL_OVERLAP' end"""


BASE = f"""
o as (select o_custkey as job_id, o_orderkey as k from orders),
v as (select *, {_pick_sql("k", *STATES)} as p, {_pick_sql("(k // 5)", *ASSESSMENTS)} as a, abs(k % 5 - (k + case when k % 7 = 0 then (k // 7) % 3 else 0 end) % 5) as d,
    ['c' || k % 4, 'c' || k % 3] as pc, ['c' || k % 4, 'c' || k % 5] as sc, case when k % 6 = 0 then [] else ['l' || k % 4] end as pl, case when k % 9 = 0 then [] else ['l' || k % 8] end as sl from o),
w as (select *, {_align_sql("pc", "sc")} as contract_alignment, {_align_sql("pl", "sl")} as legal_alignment from v where k % 50 <> 0 and k % 51 <> 0),
risks as (select *, case when p = 'SUPPORTED_FINDING' and a = 'SUPPORTED' then 'AGREE_SUPPORTED' when p = 'NO_FINDING' and a = 'NOT_SUPPORTED' then 'AGREE_NO_FINDING' when p = 'REVIEW_REQUIRED' and a = p then 'AGREE_REVIEW_REQUIRED'
    when p = 'INSUFFICIENT_EVIDENCE' and a = p then 'AGREE_INSUFFICIENT_EVIDENCE' when (p = 'SUPPORTED_FINDING' and a = 'NOT_SUPPORTED') or (p = 'NO_FINDING' and a = 'SUPPORTED') then 'DISAGREE_RISK_EXISTS'
    when (p in ('REVIEW_REQUIRED', 'INSUFFICIENT_EVIDENCE')) <> (a in ('REVIEW_REQUIRED', 'INSUFFICIENT_EVIDENCE')) then 'DISAGREE_EVIDENCE_SUFFICIENCY' else 'STATE_DIFFERENCE' end as risk_state from w),
material as (select *, concat_ws(',', case when risk_state = 'DISAGREE_RISK_EXISTS' then 'RISK_EXISTENCE_CONFLICT' end, case when d >= 2 then 'SEVERITY_DISTANCE_GTE_2' end,
    case when risk_state = 'AGREE_SUPPORTED' and legal_alignment = 'DISJOINT' then 'LEGAL_BASIS_DISJOINT' end, case when risk_state = 'AGREE_SUPPORTED' and contract_alignment = 'DISJOINT' then 'CONTRACT_EVIDENCE_DISJOINT' end) as m from risks),
compared as (select *, case when m <> '' then 'MATERIAL_DISAGREEMENT' when risk_state in ('DISAGREE_EVIDENCE_SUFFICIENCY', 'STATE_DIFFERENCE') then 'REQUIRES_MORE_EVIDENCE'
    when risk_state in ('AGREE_REVIEW_REQUIRED', 'AGREE_INSUFFICIENT_EVIDENCE') then 'AGREEMENT_WITH_REVIEW' when d = 1 then 'MINOR_DISAGREEMENT' else 'AGREEMENT' end as finding_state from material),
reasoned as (select *, case when m <> '' then m when finding_state in ('REQUIRES_MORE_EVIDENCE', 'AGREEMENT_WITH_REVIEW') then risk_state when d = 1 then 'SEVERITY_DISTANCE_1' else '' end as reasons,
    finding_state in ('MATERIAL_DISAGREEMENT', 'REQUIRES_MORE_EVIDENCE', 'AGREEMENT_WITH_REVIEW') as follow_up from compared)
"""


def finding_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10: findings that only one of the reviewers has."""
    return findings.aligned(*_reviews(spark, sf_dir)).where("problem is not null").select("job_id", "finding_id", "problem")


ALIGNED_SQL = """select o_custkey as job_id, o_orderkey as finding_id, case when o_orderkey % 51 = 0 then 'MISSING' else 'EXTRA' end as problem from orders where (o_orderkey % 50 = 0) <> (o_orderkey % 51 = 0)"""


def finding_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RM5, FN17-FN19: every finding that both have, compared."""
    out = findings.compared(findings.aligned(*_reviews(spark, sf_dir)))
    return out.select("job_id", "finding_id", "risk_state", "severity_state", "contract_alignment", "legal_alignment", "finding_state", F.array_join("material_reasons", ",").alias("material_reasons"), "follow_up", "comparison_id")


COMPARED_SQL = f"""with {BASE}, t as (select *, case d when 0 then 'AGREE' when 1 then 'MINOR_DISAGREEMENT' else 'MATERIAL_DISAGREEMENT' end as severity_state from reasoned)
select job_id, k as finding_id, risk_state, severity_state, contract_alignment, legal_alignment, finding_state, reasons as material_reasons, follow_up,
    'comparison-' || substr(sha256('{{"contract_alignment":"' || contract_alignment || '","finding_id":' || k || ',"legal_alignment":"' || legal_alignment || '","risk_state":"' || risk_state || '","severity_state":"' || severity_state || '"}}'), 1, 16) as comparison_id from t"""


def report_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24: a customer's findings and omissions as one comparison of two reports."""
    rows = findings.compared(findings.aligned(*_reviews(spark, sf_dir)))
    omissions = table(spark, sf_dir, "orders").where("o_orderkey % 97 = 0").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("omission_id"))
    return findings.overall(rows, omissions).withColumn("follow_up_reasons", F.array_join("follow_up_reasons", ","))


REPORT_SQL = f"""with {BASE},
rows as (select job_id, 0 as part, cast(k as varchar) as id, finding_state as s, follow_up, case when follow_up then k || ':' || replace(reasons, ',', ',' || k || ':') end as why from reasoned
    union all select job_id, 1, cast(k as varchar), 'MATERIAL_DISAGREEMENT', true, k || ':SECONDARY_IDENTIFIED_POSSIBLE_PRIMARY_OMISSION' from o where k % 97 = 0)
select job_id, ['MATERIAL_DISAGREEMENT', 'REQUIRES_MORE_EVIDENCE', 'AGREEMENT_WITH_REVIEW', 'MINOR_DISAGREEMENT', 'AGREEMENT'][min(list_position(['MATERIAL_DISAGREEMENT', 'REQUIRES_MORE_EVIDENCE', 'AGREEMENT_WITH_REVIEW', 'MINOR_DISAGREEMENT', 'AGREEMENT'], s))] as overall_state,
    case when bool_or(follow_up) then 'FOLLOW_UP_REQUIRED' else 'NOT_REQUIRED' end as follow_up, coalesce(string_agg(why, ',' order by part, id), '') as follow_up_reasons from rows group by job_id"""


def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3, ST4: all evidence that either reviewer names for a finding."""
    out = findings.evidence_union(list(_reviews(spark, sf_dir)), "job_id", "finding_id")
    return out.select("job_id", "finding_id", F.array_join("contract_ids", ",").alias("contract_ids"), F.array_join("legal_ids", ",").alias("legal_ids"))


UNION_SQL = f"""with {BASE}, x as (select job_id, k, pc as c, pl as l from v where k % 50 <> 0 union all select job_id, k, sc, sl from v where k % 51 <> 0),
g as (select job_id, k, list_sort(list_distinct(flatten(list(c)))) as c, list_sort(list_distinct(flatten(list(l)))) as l from x group by job_id, k)
select job_id, k as finding_id, array_to_string(c, ',') as contract_ids, array_to_string(l, ',') as legal_ids from g"""


def evidence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN17, RM2, RM8: objects of a customer that share evidence with a finding, and whether the finding's sources are uncertain."""
    first, second = _reviews(spark, sf_dir)
    spans = second.select("job_id", F.col("finding_id").alias("object_id"), F.col("contract_ids").alias("evidence_ids"), _pick(F.col("finding_id"), "NATIVE_TEXT", "OCR", "NATIVE_TEXT").alias("source_method"), F.when(F.col("finding_id") % 4 != 0, F.lit(0.9)).alias("confidence"))
    asked = first.select("job_id", F.col("finding_id").alias("cited_id"), F.col("contract_ids").alias("evidence_ids"))
    met = findings.evidence_lookup(asked.withColumnRenamed("cited_id", "request_id"), spans).groupBy(F.col("request_id").alias("cited_id")).agg(F.count("*").alias("objects"), F.sum(F.size("shared")).alias("shared"))
    return findings.source_uncertain(asked, spans).join(met, "cited_id", "left").na.fill(0, ["objects", "shared"])


LOOKUP_SQL = f"""with {BASE}, s as (select job_id, k, list_distinct(sc) as ids, k % 3 = 1 and k % 4 = 0 as bad from v where k % 51 <> 0),
q as (select job_id, k, list_distinct(pc) as ids from v where k % 50 <> 0),
m as (select q.job_id, q.k, s.bad, len(list_intersect(q.ids, s.ids)) as n from q join s on q.job_id = s.job_id and len(list_intersect(q.ids, s.ids)) > 0)
select q.job_id, q.k as cited_id, coalesce(bool_or(m.bad), false) as source_uncertain, count(m.k) as objects, cast(coalesce(sum(m.n), 0) as bigint) as shared from q left join m on m.job_id = q.job_id and m.k = q.k group by q.job_id, q.k"""


def workspace_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN30: orders as workspaces, their lines as stages."""
    jobs = table(spark, sf_dir, "orders").selectExpr("o_orderkey as job_id", "o_orderkey % 11 <> 0 as source_available", "o_orderkey % 13 <> 0 as has_report", "o_orderkey % 3 <> 0 as coverage_complete", "o_orderkey % 2 as outstanding")
    stage = F.when(F.col("l_tax") >= 0.08, "INVALID").when((F.col("l_discount") >= 0.1) & (F.col("l_quantity") > 25), "STALE").otherwise(_pick(F.col("l_linenumber"), "READY", "NOT_REQUIRED"))
    stages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage"), stage.alias("state"))
    return findings.workspace_state(stages, jobs).select("job_id", "overall_state")


WORKSPACE_SQL = """with s as (select l_orderkey, bool_or(l_tax >= 0.08) as invalid, bool_and(not (l_tax >= 0.08) and not (l_discount >= 0.1 and l_quantity > 25)) as ready from lineitem group by 1)
select o_orderkey as job_id, case when coalesce(invalid, false) then 'INVALID' when o_orderkey % 13 <> 0 and o_orderkey % 11 <> 0 and coalesce(ready, false) then case when o_orderkey % 3 = 0 or o_orderkey % 2 > 0 then 'HUMAN_REVIEW_REQUIRED' else 'COMPLETE' end else 'INCOMPLETE' end as overall_state
from orders left join s on l_orderkey = o_orderkey"""


def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14: parts as cases of benchmark tasks."""
    k = F.col("p_partkey")
    cases = table(spark, sf_dir, "part").select(k.alias("case_id"), _pick(k, *findings.TASKS[:4], *findings.TASKS[5:]).alias("task_type"), (F.col("p_size") > 10).alias("passed"))
    return findings.task_summary(cases)


TASK_SQL = f"""with c as (select {_pick_sql("p_partkey", *findings.TASKS[:4], *findings.TASKS[5:])} as task_type, p_size > 10 as passed from part)
select task_type, count(*) as case_count, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, cast(list_position([{", ".join(repr(t) for t in findings.TASKS)}], task_type) as bigint) as task_order from c group by task_type"""


def clause_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF10, PF17: the fixed topics of contract lines, and the index of the clauses."""
    from ..operators import extraction

    lines = contracts.lines(spark, sf_dir)
    found = planning.topics(lines, planning.topic_table(spark), "unit_text").groupBy("job_id", "topic").agg(F.min("unit_order").alias("first_line"))
    clauses = extraction.clauses(extraction.outlined(lines, "job_id"), "job_id").select("job_id", F.col("clause_id").alias("canonical_object_id"), F.lit("CLAUSE").alias("object_type"), F.col("body_text").alias("text"), F.expr("cast(array() as array<string>)").alias("evidence_ids"))
    index = findings.clause_index(clauses, "canonical_object_id").groupBy("job_id").agg(F.max("order_index").alias("clauses"), F.sum("text_chars").alias("clause_chars"))
    return found.join(index, "job_id")


TOPICS_SQL = f"""with {contracts.BASE}, t as (select job_id, k, p, '违约金' as topic, 12 as first_line from o union all select job_id, k, p, '合同生效', 7 from o)
select job_id, topic, first_line, 2 as clauses, cast(length('合同总价为' || p || '元，预付款30%，尾款70%') + 1 + case when k % 4 = 1 then length('合同总价为' || (p + case when k % 8 = 1 then 1 else 0 end) || '.00元') else 6 end
    + length('违约金按百分之' || ['五', '十', '二十五'][cast(k % 3 + 1 as integer)] || '计，见附件1，依照第一条') + 1 + case when k % 13 = 0 then 10 else 2 end as bigint) as clause_chars from t"""

QUERIES = {
    "finding_alignment": (finding_alignment, ALIGNED_SQL),
    "finding_comparison": (finding_comparison, COMPARED_SQL),
    "report_comparison": (report_comparison, REPORT_SQL),
    "evidence_union": (evidence_union, UNION_SQL),
    "evidence_lookup": (evidence_lookup, LOOKUP_SQL),
    "workspace_state": (workspace_state, WORKSPACE_SQL),
    "task_summary": (task_summary, TASK_SQL),
    "clause_topics": (clause_topics, TOPICS_SQL),
}
