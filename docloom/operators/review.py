"""Comparing two reviewers, human decisions, and what they come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
STATES = ("CONSISTENT", "CONSISTENT_WITH_REVIEW", "REVIEW_REQUIRED", "INSUFFICIENT_EVIDENCE", "POSSIBLE_OMISSION", "MATERIAL_DISAGREEMENT")


def rank_of(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[severity]


def severity_distance(a: Column, b: Column) -> Column:
    """Ranks apart; null if either is unknown."""
    return F.abs(rank_of(a) - rank_of(b))


def severity_state(a: Column, b: Column) -> Column:
    d = severity_distance(a, b)
    return F.when(d == 0, "AGREE").when(d == 1, "MINOR_DISAGREEMENT").when(d >= 2, "MATERIAL_DISAGREEMENT")


def set_alignment(left: Column, right: Column) -> dict[str, Column]:
    """Shared, left-only and right-only elements, sorted, and how the sets lie to each other."""
    nothing = F.expr("cast(array() as array<string>)")
    a, b = F.coalesce(left, nothing), F.coalesce(right, nothing)
    shared, only_a, only_b = F.array_sort(F.array_intersect(a, b)), F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))
    state = (
        F.when((F.size(a) == 0) & (F.size(b) == 0), "BOTH_EMPTY")
        .when(F.size(b) == 0, "PRIMARY_ONLY")
        .when(F.size(a) == 0, "SECONDARY_ONLY")
        .when((F.size(only_a) == 0) & (F.size(only_b) == 0), "AGREE")
        .when(F.size(shared) == 0, "DISJOINT")
        .otherwise("PARTIAL_OVERLAP")
    )
    return {"shared": shared, "primary_only": only_a, "secondary_only": only_b, "alignment": state}


def _reasons(*parts: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*parts)))


def compare_issues(pairs: DataFrame) -> DataFrame:
    """The comparison's state, reasons and whether a human has to look, by the decision table; the first row that fits decides.

    Columns: primary_state, assessment, coverage_assessment, primary_severity, secondary_severity, evidence_sufficiency,
    contract_alignment, legal_alignment, primary_reasons, secondary_reasons."""
    c, code = F.col, F.lit
    nothing = F.expr("cast(array() as array<string>)")
    d = F.coalesce(severity_distance(c("primary_severity"), c("secondary_severity")), F.lit(0))
    lacking = F.lit(False)
    for column in ("primary_state", "assessment", "coverage_assessment"):
        lacking = lacking | (c(column) == "INSUFFICIENT_EVIDENCE")
    asked = (c("primary_state") == "REVIEW_REQUIRED") | (c("assessment") == "REVIEW_REQUIRED")
    gathered = F.concat(F.coalesce("primary_reasons", nothing), F.coalesce("secondary_reasons", nothing))
    # The decision table's states and reason codes, in the order in which they decide.
    decisive = [
        (c("coverage_assessment") == "POSSIBLE_OMISSION", "POSSIBLE_OMISSION", "SECONDARY_POSSIBLE_OMISSION"),
        (lacking, "INSUFFICIENT_EVIDENCE", "ISSUE_EVIDENCE_INSUFFICIENT"),
        (c("assessment") == "DISAGREED", "MATERIAL_DISAGREEMENT", "SECONDARY_DISAGREED_WITH_PRIMARY"),
        (asked, "REVIEW_REQUIRED", "MODEL_REVIEW_REQUIRED"),
        (d >= 2, "MATERIAL_DISAGREEMENT", "SEVERITY_DISTANCE_MATERIAL"),
    ]
    small = [
        (c("assessment") == "PARTIALLY_SUPPORTED", code("SECONDARY_PARTIALLY_SUPPORTED")),
        (c("coverage_assessment") == "COVERED_BUT_QUESTIONABLE", code("SECONDARY_COVERAGE_QUESTIONABLE")),
        (d == 1, code("SEVERITY_DISTANCE_MINOR")),
    ]
    promoting = [
        (c("evidence_sufficiency") != "SUFFICIENT", F.concat(code("PRIMARY_EVIDENCE_"), "evidence_sufficiency")),
        (c("contract_alignment") == "DISJOINT", code("CONTRACT_EVIDENCE_DISJOINT")),
        (c("legal_alignment") == "DISJOINT", code("LEGAL_EVIDENCE_DISJOINT")),
        (F.size(gathered) > 0, code("UPSTREAM_REVIEW_REASON_PRESENT")),
    ]
    first = F
    for fits, state, reason in decisive:
        first = first.when(F.coalesce(fits, F.lit(False)), F.struct(code(state).alias("state"), code(reason).alias("reason")))
    minor, promoted = (_reasons(*[F.when(fits, reason) for fits, reason in rows]) for rows in (small, promoting))
    out = pairs.withColumns({"severity_distance": d, "__first": first, "__minor": minor, "__promoted": promoted})
    state = F.when(c("__first").isNotNull(), c("__first.state")).when(F.size(c("__minor")) + F.size(c("__promoted")) > 0, "CONSISTENT_WITH_REVIEW").otherwise("CONSISTENT")
    own = F.when(c("__first").isNotNull(), F.array("__first.reason")).when(F.size("__minor") > 0, c("__minor")).otherwise(F.concat(F.array(code("PRIMARY_SECONDARY_CONSISTENT")), "__promoted"))
    out = out.withColumns({"overall_state": state, "reasons": F.array_distinct(F.concat(own, gathered))})
    return out.withColumn("requires_human_review", c("overall_state") != "CONSISTENT").drop("__first", "__minor", "__promoted")


def issue_summary(comparisons: DataFrame, *keys: str) -> DataFrame:
    """Counts by state and the report's final reasons and state. A boolean column planning_coverage_complete, if there is one, is a reason where it is false."""
    planned = F.coalesce(F.bool_and("planning_coverage_complete"), F.lit(True)) if "planning_coverage_complete" in comparisons.columns else F.lit(True)
    counts = {s: F.count_if(F.col("overall_state") == s) for s in STATES}
    out = comparisons.groupBy(*keys).agg(*[c.alias(s.lower()) for s, c in counts.items()], F.count_if("requires_human_review").alias("human_review"), planned.alias("__planned"))
    order = ("POSSIBLE_OMISSION", "MATERIAL_DISAGREEMENT", "INSUFFICIENT_EVIDENCE", "REVIEW_REQUIRED", "CONSISTENT_WITH_REVIEW")
    present = [F.when(F.col(s.lower()) > 0, F.lit(f"{s}_PRESENT")) for s in order]
    out = out.withColumn("final_reasons", F.array_compact(F.array(F.when(~F.col("__planned"), F.lit("PLANNING_COVERAGE_INCOMPLETE")), *present))).drop("__planned")
    return out.withColumn("final_state", F.when(F.size("final_reasons") > 0, "HUMAN_REVIEW_REQUIRED").otherwise("NO_MANDATORY_REVIEW"))


# What both reviewers say of a risk, where they say the same.
AGREED = {
    ("SUPPORTED_FINDING", "SUPPORTED"): "AGREE_SUPPORTED",
    ("NO_FINDING", "NOT_SUPPORTED"): "AGREE_NO_FINDING",
    ("REVIEW_REQUIRED", "REVIEW_REQUIRED"): "AGREE_REVIEW_REQUIRED",
    ("INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE"): "AGREE_INSUFFICIENT_EVIDENCE",
}


def risk_state(primary: Column, assessment: Column) -> Column:
    """Older finding-level table: what both say about a risk."""
    out = F
    for (p, a), state in AGREED.items():
        out = out.when((primary == p) & (assessment == a), state)
    yes_no = F.concat_ws("/", primary, assessment).isin("SUPPORTED_FINDING/NOT_SUPPORTED", "NO_FINDING/SUPPORTED")
    unsure = ("REVIEW_REQUIRED", "INSUFFICIENT_EVIDENCE")
    return out.when(yes_no, "DISAGREE_RISK_EXISTS").when(primary.isin(*unsure) != assessment.isin(*unsure), "DISAGREE_EVIDENCE_SUFFICIENCY").otherwise("STATE_DIFFERENCE")


def finding_state(risk: Column, distance: Column, contract: Column, legal: Column) -> dict[str, Column]:
    """Older finding-level result: reasons, state and whether to follow up."""
    affirm = risk == "AGREE_SUPPORTED"
    # Reason codes and states.
    material = _reasons(
        F.when(risk == "DISAGREE_RISK_EXISTS", F.lit("RISK_EXISTENCE_CONFLICT")),
        F.when(distance >= 2, F.lit("SEVERITY_DISTANCE_GTE_2")),
        F.when(affirm & (legal == "DISJOINT"), F.lit("LEGAL_BASIS_DISJOINT")),
        F.when(affirm & (contract == "DISJOINT"), F.lit("CONTRACT_EVIDENCE_DISJOINT")),
    )
    open_states = {"REQUIRES_MORE_EVIDENCE": ("DISAGREE_EVIDENCE_SUFFICIENCY", "STATE_DIFFERENCE"), "AGREEMENT_WITH_REVIEW": ("AGREE_REVIEW_REQUIRED", "AGREE_INSUFFICIENT_EVIDENCE")}
    state, reasons = F.when(F.size(material) > 0, "MATERIAL_DISAGREEMENT"), F.when(F.size(material) > 0, material)
    for name, risks in open_states.items():
        state, reasons = state.when(risk.isin(*risks), name), reasons.when(risk.isin(*risks), F.array(risk))
    state, reasons = state.when(distance == 1, "MINOR_DISAGREEMENT").otherwise("AGREEMENT"), reasons.when(distance == 1, F.array(F.lit("SEVERITY_DISTANCE_1"))).otherwise(material)
    return {"material_reasons": reasons, "finding_state": state, "follow_up": state.isin("MATERIAL_DISAGREEMENT", *open_states)}


def follow_up_plan(findings: DataFrame, omissions: DataFrame, most: int = 2) -> DataFrame:
    """Bounded follow-up actions per job: sorted by priority, tool and reason, repeated (tool, arguments) dropped, two kept (the feature's limit)."""
    f = findings.where("follow_up")
    contract = f.where("(risk_state = 'DISAGREE_RISK_EXISTS' or contract_alignment = 'DISJOINT') and size(contract_ids) > 0").select("job_id", F.lit(10).alias("priority"), F.lit("inspect_contract_evidence").alias("tool"), F.array_join("contract_ids", ",").alias("arguments"), F.col("finding_id").alias("reason"))
    legal = f.where("legal_alignment = 'DISJOINT' and size(legal_ids) > 0").select("job_id", F.lit(20), F.lit("inspect_legal_evidence"), F.array_join("legal_ids", ","), "finding_id")
    o = lambda at, tool, ids: omissions.where(f"size({ids}) > 0").select("job_id", F.lit(at), F.lit(tool), F.array_join(ids, ","), "omission_id")
    rows = contract.unionAll(legal).unionAll(o(5, "inspect_contract_evidence", "contract_ids")).unionAll(o(15, "inspect_legal_evidence", "legal_ids"))
    once = rows.groupBy("job_id", "tool", "arguments").agg(F.min(F.struct("priority", "reason")).alias("m")).select("job_id", "tool", "arguments", "m.priority", "m.reason")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy("priority", "tool", "reason"))).where(F.col("rank") <= most)


def evidence_sufficiency(targets: Column, uncertain: Column, support: Column) -> Column:
    return (
        F.when(targets == 0, "CONTRACT_EVIDENCE_INSUFFICIENT")
        .when(uncertain, "SOURCE_UNCERTAIN")
        .when(support == "VERSION_REVIEW_REQUIRED", "LEGAL_VERSION_UNCERTAIN")
        .when(support == "NO_MATCH_IN_LOCAL_CORPUS", "INSUFFICIENT_LEGAL_CORPUS")
        .when(support == "EVIDENCE_FOUND_WITH_LIMITATIONS", "PARTIAL_LEGAL_CORPUS")
        .otherwise("SUFFICIENT")
    )


def validate_primary(outputs: DataFrame) -> DataFrame:
    """Reviewer outputs checked against what was supplied (allowed_contract, allowed_legal, support_state, sufficiency, any_uncertain): rejected, downgraded or kept.

    The reference refuses an output with a sentence; ``rejected`` holds a code of our own for it. States and added reasons are fixed values."""
    c = F.col
    has_c, has_l = F.size("contract_ids") > 0, F.size("legal_ids") > 0
    limited = c("support_state").isin("NO_MATCH_IN_LOCAL_CORPUS", "VERSION_REVIEW_REQUIRED")
    found, none_found = c("state") == "SUPPORTED_FINDING", c("state") == "NO_MATERIAL_RISK_FOUND"
    reject = (
        F.when(F.size(F.array_except("contract_ids", "allowed_contract")) > 0, "UNKNOWN_CONTRACT_EVIDENCE")
        .when(F.size(F.array_except("legal_ids", "allowed_legal")) > 0, "UNKNOWN_LEGAL_EVIDENCE")
        .when(found & ~has_c, "SUPPORTED_WITHOUT_EVIDENCE")
        .when(c("legal_conclusion") & (~(found | none_found) | ~has_l | limited), "CONCLUSION_NOT_ALLOWED")
        .when(none_found & ~(has_c & has_l & c("legal_conclusion")), "NO_RISK_WITHOUT_EVIDENCE")
    )
    reason = (
        F.when(none_found & ((c("support_state") != "EVIDENCE_FOUND") | c("any_uncertain")), "NO_MATERIAL_RISK_NOT_ALLOWED_WITH_INCOMPLETE_EVIDENCE")
        .when(found & ((c("sufficiency") == "SOURCE_UNCERTAIN") | (c("support_state") == "VERSION_REVIEW_REQUIRED")), "SUPPORTED_FINDING_REQUIRES_REVIEW_DUE_TO_EVIDENCE_STATE")
        .when(found & c("legal_conclusion") & (c("support_state") == "EVIDENCE_FOUND_WITH_LIMITATIONS"), "PARTIAL_LEGAL_CORPUS")
    )
    out = outputs.withColumn("rejected", reject).withColumn("__reason", F.when(c("rejected").isNull(), reason))
    out = out.withColumn("downgraded", F.coalesce(c("__reason") != "PARTIAL_LEGAL_CORPUS", F.lit(False)))
    out = out.withColumn("final_state", F.when(c("rejected").isNull(), F.when(c("downgraded"), "REVIEW_REQUIRED").otherwise(c("state"))))
    out = out.withColumn("final_conclusion", c("rejected").isNull() & ~c("downgraded") & c("legal_conclusion"))
    return out.withColumn("added_reasons", F.array_compact(F.array("__reason"))).drop("__reason")


def one_to_one(plan: DataFrame, primary: DataFrame, secondary: DataFrame, key: str = "issue_id") -> DataFrame:
    """Issues that are not in all three exactly once: none, if the comparison may go on."""
    tagged = [df.groupBy("job_id", key).agg(F.count("*").alias(name)) for name, df in (("planned", plan), ("first", primary), ("second", secondary))]
    out = tagged[0].join(tagged[1], ["job_id", key], "full_outer").join(tagged[2], ["job_id", key], "full_outer").na.fill(0)
    return out.where("planned <> 1 or first <> 1 or second <> 1")


def latest_revision(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last decision of each target, by its revision; a partial maximum goes before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    ordered = F.struct(*order, *[c for c in rest if c not in order])
    best = log.groupBy(*keys).agg(F.max(ordered).alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def numbered_revisions(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return log.withColumn("revision", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def closure(required: DataFrame, latest: DataFrame, reports: DataFrame) -> DataFrame:
    """Per job: targets that need a human, resolved ones (a decision on the current report), outstanding and stale ones."""
    rows = required.join(latest, ["job_id", "target_id"], "left").join(reports.select("job_id", F.col("fingerprint").alias("current")), "job_id", "left")
    resolved = F.col("state").isNotNull() & (F.col("report_fingerprint") == F.col("current"))
    stale = F.col("state").isNotNull() & ~F.coalesce(F.col("report_fingerprint") == F.col("current"), F.lit(False))
    return rows.groupBy("job_id").agg(F.count("*").alias("required"), F.count_if(resolved).alias("resolved"), F.count_if(~F.coalesce(resolved, F.lit(False))).alias("outstanding"), F.count_if(stale).alias("stale_latest"))
