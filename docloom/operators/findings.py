"""Findings of two reviewers side by side, evidence look-ups, workspace states and the rows that planners and reviewers are given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import review

# States of a comparison of two reports, the gravest first; states of a workspace's stages.
OVERALL = ("MATERIAL_DISAGREEMENT", "REQUIRES_MORE_EVIDENCE", "AGREEMENT_WITH_REVIEW", "MINOR_DISAGREEMENT", "AGREEMENT")
DONE = ("READY", "NOT_REQUIRED")
#: Confidence under which a recognised source is uncertain.
SOURCE_THRESHOLD = 0.85
#: Benchmark tasks in the order of a summary.
TASKS = tuple("OCR CANONICAL_STRUCTURE DETERMINISTIC_RULE LEGAL_RETRIEVAL LEGAL_CITATION_VALIDITY CONTRACT_EVIDENCE_LOCALIZATION PRIMARY_AUDIT_FINDING SECONDARY_REVIEW HUMAN_REVIEW_INTEGRITY".split())


def aligned(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Findings (job_id, finding_id, ...) of both reviewers, by id; ``problem`` tells those that only one of them has, which make a comparison an error.

    Columns of the first: state, severity, contract_ids, legal_ids; of the second: assessment, severity, contract_ids, legal_ids."""
    side = lambda df, mark: df.select("job_id", "finding_id", F.lit(True).alias(f"has_{mark}"), *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in ("job_id", "finding_id")])
    both = side(primary, "p").join(side(secondary, "s"), ["job_id", "finding_id"], "full_outer")
    return both.withColumn("problem", F.when(F.col("has_s").isNull(), "MISSING").when(F.col("has_p").isNull(), "EXTRA")).drop("has_p", "has_s")


def compared(pairs: DataFrame) -> DataFrame:
    """Of aligned findings: risk, severity and evidence held against each other, what they come to, and an id that follows from these."""
    c = F.col
    contract, legal = review.set_alignment(c("p_contract_ids"), c("s_contract_ids")), review.set_alignment(c("p_legal_ids"), c("s_legal_ids"))
    out = pairs.where("problem is null").withColumns(
        {
            "risk_state": review.risk_state(c("p_state"), c("s_assessment")),
            "severity_distance": review.severity_distance(c("p_severity"), c("s_severity")),
            "severity_state": review.severity_state(c("p_severity"), c("s_severity")),
            "contract_alignment": contract["alignment"],
            "contract_ids": contract["shared"],
            "legal_alignment": legal["alignment"],
            "legal_ids": legal["shared"],
        }
    )
    final = review.finding_state(c("risk_state"), c("severity_distance"), c("contract_alignment"), c("legal_alignment"))
    told = F.struct("contract_alignment", "finding_id", "legal_alignment", "risk_state", "severity_state")
    return out.withColumns(final).withColumn("comparison_id", X.stable_id("comparison-", X.canonical_json(told)))


def overall(comparisons: DataFrame, omissions: DataFrame) -> DataFrame:
    """Per job: the gravest state of its findings, an omission counting as a material disagreement; whether to follow up, and why, in the order of ids."""
    rank = F.create_map(*[x for i, s in enumerate(OVERALL) for x in (F.lit(s), F.lit(i))])
    reasons = F.transform("material_reasons", lambda r: F.concat_ws(":", F.col("finding_id").cast("string"), r))
    rows = comparisons.select("job_id", rank[F.col("finding_state")].alias("rank"), "follow_up", F.struct(F.lit(0).alias("part"), F.col("finding_id").cast("string").alias("id"), F.when(F.col("follow_up"), reasons).alias("why")).alias("told"))
    why = F.array(F.concat(F.col("omission_id").cast("string"), F.lit(":SECONDARY_IDENTIFIED_POSSIBLE_PRIMARY_OMISSION")))
    more = omissions.select("job_id", F.lit(0).alias("rank"), F.lit(True).alias("follow_up"), F.struct(F.lit(1).alias("part"), F.col("omission_id").cast("string").alias("id"), why.alias("why")).alias("told"))
    out = rows.unionByName(more).groupBy("job_id").agg(F.min("rank").alias("rank"), F.bool_or("follow_up").alias("follow_up"), F.array_sort(F.collect_list("told")).alias("told"))
    reasons = F.flatten(F.filter(F.transform("told", lambda t: t["why"]), lambda w: w.isNotNull()))
    return out.select("job_id", F.get(F.array(*map(F.lit, OVERALL)), F.col("rank")).alias("overall_state"), F.when(F.col("follow_up"), "FOLLOW_UP_REQUIRED").otherwise("NOT_REQUIRED").alias("follow_up"), reasons.alias("follow_up_reasons"))


def evidence_union(parts: list[DataFrame], *keys: str) -> DataFrame:
    """The sorted union of the evidence (contract_ids, legal_ids) that plan, reviewers and comparison name for each key."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.expr("cast(array() as array<string>)"))))))
    rows = reduce(DataFrame.unionByName, [p.select(*keys, "contract_ids", "legal_ids") for p in parts])
    return rows.groupBy(*keys).agg(flat("contract_ids").alias("contract_ids"), flat("legal_ids").alias("legal_ids"))


def evidence_lookup(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """(request_id, object_id) of objects (job_id, object_id, evidence_ids) that share evidence with a request (request_id, job_id, evidence_ids)."""
    asked = requests.select("request_id", "job_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    there = objects.select("job_id", "object_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    return asked.join(there, ["job_id", "evidence_id"]).groupBy("request_id", "object_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("shared"))


def workspace_state(stages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job (job_id, source_available, has_report, coverage_complete, outstanding) and its stages (job_id, stage, state): the workspace's overall state."""
    s = stages.groupBy("job_id").agg(F.bool_or(F.col("state") == "INVALID").alias("invalid"), F.bool_and(F.col("state").isin(*DONE)).alias("ready"))
    out = jobs.join(s, "job_id", "left").na.fill(False, ["invalid", "ready"])
    human = ~F.col("coverage_complete") | (F.col("outstanding") > 0)
    state = F.when(F.col("invalid"), "INVALID").when(F.col("has_report") & F.col("source_available") & F.col("ready"), F.when(human, "HUMAN_REVIEW_REQUIRED").otherwise("COMPLETE")).otherwise("INCOMPLETE")
    return out.withColumn("overall_state", state)


def needs_attention(issues: DataFrame) -> DataFrame:
    """Issues that a reader has to look at: a human is required and has not decided, or decided on an older report."""
    return issues.where("requires_human_review and (human_decision_state is null or human_decision_stale)")


def source_uncertain(cited: DataFrame, spans: DataFrame) -> DataFrame:
    """Per (job_id, cited_id): whether a span of an object that shares evidence with the citation is recognised text of low or unknown confidence.

    cited: job_id, cited_id, evidence_ids; spans: job_id, object_id, evidence_ids, source_method, confidence."""
    objects = spans.groupBy("job_id", "object_id").agg(F.array_distinct(F.flatten(F.collect_list("evidence_ids"))).alias("evidence_ids"), F.bool_or(uncertain()).alias("uncertain"))
    doubted = objects.select("job_id", F.explode("evidence_ids").alias("evidence_id"), "uncertain").groupBy("job_id", "evidence_id").agg(F.bool_or("uncertain").alias("uncertain"))  # of each evidence, not of each pair of objects
    named = cited.select("job_id", "cited_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    return named.join(doubted, ["job_id", "evidence_id"], "left").groupBy("job_id", "cited_id").agg(F.coalesce(F.bool_or("uncertain"), F.lit(False)).alias("source_uncertain"))


def uncertain() -> Column:
    return (F.col("source_method") == "OCR") & (F.col("confidence").isNull() | (F.col("confidence") < SOURCE_THRESHOLD))


def contract_items(clauses: DataFrame, blocks: DataFrame) -> DataFrame:
    """Clauses (job_id, clause_id, text, spans) and blocks (job_id, block_id, text, spans) as one list of items with their evidence; a span tells evidence_ids, source_method and confidence."""
    item = lambda df, key, kind: df.select("job_id", F.col(key).alias("canonical_object_id"), F.lit(kind).alias("object_type"), "text", "spans")
    rows = item(clauses, "clause_id", "CLAUSE").unionByName(item(blocks, "block_id", "UNNUMBERED_BLOCK"))
    doubtful = F.exists("spans", lambda s: (s["source_method"] == "OCR") & (s["confidence"].isNull() | (s["confidence"] < SOURCE_THRESHOLD)))
    return rows.select("job_id", "canonical_object_id", "object_type", "text", F.array_distinct(F.flatten(F.transform("spans", lambda s: s["evidence_ids"]))).alias("evidence_ids"), doubtful.alias("source_uncertain"))


def clause_index(items: DataFrame, order: str) -> DataFrame:
    """A planner's index of a job's items: place, id, type, characters and evidence."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(order))
    return items.select("job_id", place.alias("order_index"), "canonical_object_id", "object_type", F.length("text").alias("text_chars"), "evidence_ids")


def rule_hints(issues: DataFrame, results: DataFrame) -> DataFrame:
    """The rule results that an issue (job_id, issue_id, rule_result_ids) names, in its order; one that is not there has a null state, and the plan is stale."""
    named = issues.select("job_id", "issue_id", F.posexplode("rule_result_ids").alias("position", "result_id"))
    return named.join(results, ["job_id", "result_id"], "left").withColumn("missing", F.col("state").isNull())


def terminal_rows(contexts: DataFrame, most_chars: int, first: bool = True) -> DataFrame:
    """Issues (targets, context_chars) that no model is asked about: without a target, or over the budget; the others have a null state."""
    none, over = ("NO_RELEVANT_CONTRACT_EVIDENCE_SELECTED", "ISSUE_CONTEXT_BUDGET_EXCEEDED") if first else ("NO_RELEVANT_CONTRACT_EVIDENCE_FOR_SECONDARY_REVIEW", "SECONDARY_CONTEXT_BUDGET_EXCEEDED")
    state = F.when(F.col("targets") == 0, "INSUFFICIENT_EVIDENCE").when(F.col("context_chars") > most_chars, "REVIEW_REQUIRED")
    return contexts.withColumn("state", state).withColumn("review_reason", F.when(F.col("targets") == 0, none).when(F.col("context_chars") > most_chars, over))


def plan_order(issues: DataFrame) -> DataFrame:
    """Issues numbered in a plan's order: priority, topic, id."""
    priority = F.create_map(*[F.lit(x) for kv in {"HIGH_ATTENTION": 0, "IMPORTANT": 1, "NORMAL": 2}.items() for x in kv])[F.col("priority")]
    return issues.withColumn("position", F.row_number().over(Window.partitionBy("job_id").orderBy(priority, "topic", "issue_id")))


def hit_order(hits: DataFrame, *keys: str) -> DataFrame:
    """An issue's hits numbered: best rank, exact ones first, fused score, id."""
    return hits.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("best_rank", F.desc("exact_hit"), F.desc("fused_score"), "doc_id")))


def task_summary(results: DataFrame) -> DataFrame:
    """Case results (case_id, task_type, passed) by task, in the tasks' own order; tasks without a case are left out."""
    order = F.array_position(F.array(*map(F.lit, TASKS)), F.col("task_type"))
    out = results.groupBy("task_type").agg(F.count("*").alias("case_count"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return out.withColumn("task_order", F.when(order > 0, order)).orderBy(F.col("task_order").asc_nulls_last())


def indexed_text(title: Column, token: Column, context: Column, text: Column) -> Column:
    """What an article's vector is made from: title, token, headings and text, a blank between."""
    return X.strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(token, F.lit("")), F.lit(" "), F.array_join(context, " "), F.lit(" "), F.coalesce(text, F.lit(""))))
