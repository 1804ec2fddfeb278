"""Logs as streams: decisions with revision numbers, job states, event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What a job may do next.
TRANSITIONS = {
    "QUEUED": ("RUNNING", "CANCELLED"),
    "RUNNING": ("COMPLETE", "FAILED", "WAITING_CONFIGURATION", "WAITING_OPTIONAL_COMPONENT", "PAUSED_BEFORE_PROVIDER", "CANCEL_REQUESTED"),
    "CANCEL_REQUESTED": ("CANCELLED", "FAILED"),
    "WAITING_CONFIGURATION": ("QUEUED", "CANCELLED"),
    "WAITING_OPTIONAL_COMPONENT": ("QUEUED", "CANCELLED"),
    "PAUSED_BEFORE_PROVIDER": ("QUEUED", "CANCELLED"),
    "FAILED": ("QUEUED",),
    "CANCELLED": ("QUEUED",),
    "COMPLETE": (),
}


def read(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def revisions(decisions: DataFrame) -> DataFrame:
    """Decisions (job_id, target_id, decision_id, state, decided_at) numbered per target; the state kept is one number."""

    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["decided_at", "decision_id"])
        rows["revision"] = range(last + 1, last + 1 + len(rows))
        state.update((last + len(rows),))
        yield rows[["job_id", "target_id", "decision_id", "state", "revision"]]

    out = "job_id string, target_id string, decision_id string, state string, revision long"
    return decisions.groupBy("job_id", "target_id").applyInPandasWithState(number, out, "last long", "append", GroupStateTimeout.NoTimeout)


def job_states(requests: DataFrame) -> DataFrame:
    """Requests (job_id, seq, wanted) applied in order: each row tells the state before and after and whether it was allowed."""

    def apply(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.get[0] if state.exists else None, []
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            allowed = row.wanted == "QUEUED" if now is None else row.wanted in TRANSITIONS.get(now, ())
            out.append((row.job_id, row.seq, now, row.wanted if allowed else now, allowed))
            now = row.wanted if allowed else now
        state.update((now,))
        yield pd.DataFrame(out, columns=["job_id", "seq", "before", "after", "allowed"])

    return requests.groupBy("job_id").applyInPandasWithState(apply, "job_id string, seq long, before string, after string, allowed boolean", "now string", "append", GroupStateTimeout.NoTimeout)


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a time with a zone; times without one are read in the session's."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and values by type in windows of fixed width; on a stream, ``late`` is how late an event may come."""
    rows = event_time(events)
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    rows = event_time(events)
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), "events")


def registered_once(registrations: DataFrame, late: str = "1 day") -> DataFrame:
    """Registrations (batch_id, job_id, ts) without repeated ones, within the watermark."""
    return event_time(registrations).withWatermark("ts", late).dropDuplicatesWithinWatermark(["batch_id", "job_id"])
