"""Batches of jobs: strict priority, state mapping, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One bit for each class, so that a class above outranks all below it together.
FLAGS = {"human": 131072, "omissions": 65536, "material": 32768, "critical": 16384, "high": 8192, "insufficient": 4096, "medium": 2048, "low": 1024}
STATE_RANKS = {"INVALID": 500_000, "FAILED": 4000, "WAITING": 3000, "CANCELLED": 2000}
NOT_STARTED_RANK = 2500
WAITING = ("WAITING_CONFIGURATION", "WAITING_OPTIONAL_COMPONENT", "PAUSED_BEFORE_PROVIDER")


def priority_score(counts: dict[str, Column]) -> Column:
    """Bits of the classes that occur, and below them the number of items, at most 1023. counts: FLAGS' names and info; human is a boolean."""
    bits = sum((F.when(counts[n], w).otherwise(0) if n == "human" else F.when(counts[n] > 0, w).otherwise(0) for n, w in FLAGS.items()), F.lit(0))
    return bits + F.least(F.lit(1023), sum((counts[n] for n in [*FLAGS, "info"] if n != "human"), F.lit(0)))


def job_states(jobs: DataFrame) -> DataFrame:
    """Batch state, priority rank, attention and failure code of jobs (document_ok, pipeline_status, architecture, score, attention_items).

    A job that no pipeline has taken up counts as being processed, but asks for attention at a rank of its own."""
    c = F.col
    state = (
        F.when(~c("document_ok"), "INVALID")
        .when(c("pipeline_status").isNull(), "PROCESSING")
        .when(c("architecture").isNull() | (c("architecture") == "CONFLICT"), "INVALID")
        .when(c("pipeline_status") == "FAILED", "FAILED")
        .when(c("pipeline_status") == "CANCELLED", "CANCELLED")
        .when(c("pipeline_status").isin(*WAITING), "WAITING")
        .when(c("pipeline_status") != "COMPLETE", "PROCESSING")
        .otherwise("COMPLETE")
    )
    rank = F.create_map(*[F.lit(x) for kv in STATE_RANKS.items() for x in kv])[c("batch_state")]
    idle, conflict = c("document_ok") & c("pipeline_status").isNull(), c("architecture") == "CONFLICT"
    out = jobs.withColumn("batch_state", state)
    out = out.withColumn("priority_rank", F.when(idle, NOT_STARTED_RANK).when(c("batch_state") == "COMPLETE", c("score")).otherwise(F.coalesce(rank, F.lit(0))))
    out = out.withColumn("needs_attention", F.when(idle, True).when(c("batch_state") == "COMPLETE", c("attention_items") > 0).otherwise(c("batch_state").isin("INVALID", "FAILED", "WAITING")))
    why = F.when(~c("document_ok"), "DOCUMENT_METADATA_INVALID").when(idle, "PIPELINE_NOT_STARTED").when(c("architecture").isNull(), "ARCHITECTURE_UNRESOLVED").when(conflict, "ARCHITECTURE_CONFLICT")
    return out.withColumn("failure", why)


def queue(jobs: DataFrame) -> DataFrame:
    """Jobs in the order of work: highest rank, then file name, then id."""
    return jobs.orderBy(F.desc("priority_rank"), F.lower("filename"), "job_id")


def roll_up(jobs: DataFrame, *keys: str) -> DataFrame:
    """The counters of a batch. Invalid jobs count as failed; optional columns human_review, architecture and coverage_complete give three more."""
    has = lambda name, test: F.count_if(test) if name in jobs.columns else F.lit(0).cast("long")
    in_state = lambda *states: F.count_if(F.col("batch_state").isin(*states))
    return jobs.groupBy(*keys).agg(
        F.count("*").alias("total_jobs"),
        in_state("COMPLETE").alias("complete_jobs"),
        in_state("WAITING").alias("waiting_jobs"),
        in_state("CANCELLED").alias("cancelled_jobs"),
        in_state("FAILED", "INVALID").alias("failed_jobs"),
        has("human_review", F.col("human_review") & (F.col("batch_state") == "COMPLETE")).alias("human_review_required_jobs"),
        in_state("PROCESSING").alias("processing_jobs"),
        has("architecture", F.col("architecture") == "ISSUE_V1").alias("issue_v1_jobs"),
        has("architecture", F.col("architecture") == "LEGACY_RC2").alias("legacy_rc2_jobs"),
        has("coverage_complete", ~F.col("coverage_complete")).alias("coverage_incomplete_jobs"),
    )


def severity_histogram(results: DataFrame, *keys: str, finding_only: bool = True) -> DataFrame:
    rows = results.where("state = 'SUPPORTED_FINDING' and severity is not null") if finding_only else results
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")])
