"""Artifacts of jobs: freshness, links, resumption, architecture, the provider gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages of jobs of the present and of the legacy architecture.
ISSUE_STAGES = ("AUDIT_PLAN", "ISSUE_LEGAL_CONTEXT", "ISSUE_PRIMARY_AUDIT", "ISSUE_SECONDARY_REVIEW", "ISSUE_REVIEW_REPORT")
LEGACY_STAGES = ("PRIMARY_AUDIT", "SECONDARY_REVIEW", "REVIEW_REPORT")


def freshness(artifacts: DataFrame, upstream: DataFrame) -> DataFrame:
    """Artifacts (job_id, artifact, upstream, upstream_fingerprint) against the upstream ones (job_id, artifact, fingerprint) as they are."""
    now = upstream.select("job_id", F.col("artifact").alias("upstream"), F.col("fingerprint").alias("current"))
    rows = artifacts.join(now, ["job_id", "upstream"], "left")
    return rows.withColumn("state", F.when(F.col("current").isNull(), "MISSING_UPSTREAM").when(F.col("current") == F.col("upstream_fingerprint"), "READY").otherwise("STALE"))


def integrity(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected artifacts (job_id, artifact) against found ones (job_id, artifact, own_job_id; null if it cannot be parsed)."""
    rows = expected.join(found.withColumn("present", F.lit(True)), ["job_id", "artifact"], "left")
    return rows.withColumn("state", F.when(F.col("present").isNull(), "MISSING").when(F.col("own_job_id").isNull(), "CORRUPT").when(F.col("own_job_id") != F.col("job_id"), "MISMATCH").otherwise("READY"))


def remaining(contexts: DataFrame, done: DataFrame) -> DataFrame:
    """Issues to work on: those without a result on the same context."""
    return contexts.join(done.select("job_id", "issue_id", "context_fingerprint"), ["job_id", "issue_id", "context_fingerprint"], "left_anti")


def architecture(stages: Column, artifacts: Column, record: Column, snapshot_ok: Column) -> Column:
    """Which architecture a job has; the first row of the table that fits. record: there is a migration record."""
    among = lambda c, names: F.arrays_overlap(c, F.array(*map(F.lit, names)))
    new, old = among(stages, ISSUE_STAGES), among(stages, LEGACY_STAGES)
    new_files, old_files = among(artifacts, ISSUE_STAGES), among(artifacts, LEGACY_STAGES)
    return (
        F.when(new & old, "CONFLICT")
        .when(record & ~snapshot_ok, "CONFLICT")
        .when(record & old, "CONFLICT")
        .when(record | new, "ISSUE_V1")
        .when(old, "LEGACY_RC2")
        .when(new_files & old_files, "CONFLICT")
        .when(new_files, "ISSUE_V1")
        .when(old_files, "LEGACY_RC2")
        .otherwise("ISSUE_V1")
    )


def migratable(status: Column) -> Column:
    return ~status.isin("COMPLETE", "QUEUED", "WAITING_WORKER", "RUNNING", "CANCEL_REQUESTED")


def provider_gate(cancel: Column, mode: Column, approved: Column) -> Column:
    """Whether a stage may call its provider."""
    return F.when(cancel, "CANCEL").when(mode == "LOCAL_ONLY", "PAUSE").when((mode == "REQUIRE_APPROVAL") & ~approved, "PAUSE").otherwise("ALLOWED")


def reconciled(status: Column) -> Column:
    """A job's status after a restart: what was under way has failed, what was being cancelled is."""
    return F.when(status == "CANCEL_REQUESTED", "CANCELLED").when(status.isin("QUEUED", "RUNNING", "WAITING_WORKER"), "FAILED").otherwise(status)


def read_model(plan: DataFrame, *others: DataFrame, keys: tuple[str, ...] = ("job_id", "issue_id")) -> DataFrame:
    """Plan issues with whatever is known of each, all sides optional."""
    for other in others:
        plan = plan.join(other, list(keys), "left")
    return plan


def stage_states(required: DataFrame, found: DataFrame) -> DataFrame:
    """Stages (job_id, stage, required) against their artifacts (job_id, stage, valid)."""
    rows = required.join(found.withColumn("present", F.lit(True)), ["job_id", "stage"], "left")
    return rows.withColumn("state", F.when(F.col("present") & F.col("valid"), "READY").when(F.col("present"), "INVALID").when(F.col("required"), "MISSING").otherwise("NOT_REQUIRED"))


def release_manifest(files: DataFrame) -> DataFrame:
    """Files (path, content) with their hashes, equal contents told once with all their paths."""
    return files.withColumn("sha256", F.sha2("content", 256)).groupBy("sha256").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.first(F.length("content")).alias("size"))
