from pyspark.sql import functions as F

from docloom.streaming import logs


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_revisions_go_on_across_batches(spark, tmp_path):
    schema = "job_id string, target_id string, decision_id string, state string, decided_at timestamp"
    rows = lambda *r: spark.createDataFrame(r, "job_id string, target_id string, decision_id string, state string, decided_at string").withColumn("decided_at", F.col("decided_at").cast("timestamp"))
    rows(("j", "t", "d1", "CONFIRMED", "2026-01-01"), ("j", "u", "d2", "REJECTED", "2026-01-01")).write.mode("append").parquet(str(tmp_path / "in"))
    start = lambda: logs.revisions(logs.read(spark, str(tmp_path / "in"), schema)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    drained(start())
    rows(("j", "t", "d3", "REJECTED", "2026-01-02"), ("j", "t", "d4", "CONFIRMED", "2026-01-03")).write.mode("append").parquet(str(tmp_path / "in"))
    drained(start())
    got = {(r.decision_id, r.revision) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("d1", 1), ("d2", 1), ("d3", 2), ("d4", 3)}


def test_job_states(spark, tmp_path):
    rows = [("j", 1, "QUEUED"), ("j", 2, "RUNNING"), ("j", 3, "QUEUED"), ("j", 4, "COMPLETE"), ("k", 1, "RUNNING")]
    spark.createDataFrame(rows, "job_id string, seq long, wanted string").write.parquet(str(tmp_path / "in"))
    query = logs.job_states(logs.read(spark, str(tmp_path / "in"), "job_id string, seq long, wanted string")).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    drained(query)
    got = {(r.job_id, r.seq): (r.after, r.allowed) for r in spark.table("states").collect()}
    assert got == {("j", 1): ("QUEUED", True), ("j", 2): ("RUNNING", True), ("j", 3): ("RUNNING", False), ("j", 4): ("COMPLETE", True), ("k", 1): (None, False)}


def test_windows_on_a_stream(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = logs.tumbling(stream, "1 hour", "2 hours").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    drained(query)
    assert spark.table("windows").agg(F.sum("events")).first()[0] == events.count()
