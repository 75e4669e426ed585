"""Streaming twins of batch steps, run to completion over the event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions.canonical import canonical_hash
from claimweave.plans.bindings import EVENT_FINDINGS_SQL, EVENTS_SQL, classified_events, classify_sql, enriched, table, text_id
from claimweave.plans.registry import query
from claimweave.plans.workflow import CHAIN_FOLD_SQL, tasks_of, tasks_sql
from claimweave.session import materialize, scratch_path
from claimweave.streaming import stream_decisions, stream_ingest, stream_outbox
from claimweave.streaming.jobs import stored, stream_decision_log


def _run(spark: SparkSession, sf_dir: str, start, output: T.StructType, name: str, *arguments, **options) -> DataFrame:
    """Drain the event files through a streaming job and read its table."""
    place = scratch_path(spark, name)
    schema = table(spark, sf_dir, "events").schema
    job = start(
        spark,
        f"{sf_dir}/events*.parquet",
        schema,
        *arguments,
        table=f"{place}/table",
        checkpoint=f"{place}/checkpoint",
        **options,
    )
    job.awaitTermination()
    return stored(spark, f"{place}/table", output)


def _evidence(batch: DataFrame) -> DataFrame:
    return enriched(batch).select("user_id", "event_type", "whole", "event_id")


@query(
    "stream_ingest",
    f"""WITH {EVENTS_SQL} SELECT user_id, event_type, whole, min(event_id) AS event_id FROM ev GROUP BY user_id, event_type, whole""",
)
def stream_ingest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _evidence(table(spark, sf_dir, "events")).schema
    return _run(
        spark,
        sf_dir,
        lambda *a, **o: stream_ingest(*a, _evidence, output, ["user_id", "event_type", "whole"], [F.asc("event_id")], **o),
        output,
        "stream-ingest",
    )


def _tasks(batch: DataFrame) -> DataFrame:
    """Route tasks of a batch; the classified batch is stored, as it is read for checks and tasks."""
    return tasks_of(materialize(classified_events(batch), "classified"))


@query(
    "stream_outbox",
    f"""WITH {EVENT_FINDINGS_SQL}, {classify_sql("event_findings", "items")}, {tasks_sql("items")}
    SELECT route_id, automation_id, queue, action FROM tasks""",
)
def stream_outbox_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _tasks(table(spark, sf_dir, "events").limit(0)).schema
    rows = _run(spark, sf_dir, lambda *a, **o: stream_outbox(*a, _tasks, output, **o), output, "stream-outbox")
    return rows.select("route_id", "automation_id", "queue", "action")


def _requests(batch: DataFrame) -> DataFrame:
    return enriched(batch).select(
        F.col("user_id").alias("packet_id"),
        text_id("", "event_type", "whole").alias("finding_id"),
        F.col("event_id").alias("sequence"),
        canonical_hash(event_id=F.col("event_id"), event_type=F.col("event_type")).alias("content_hash"),
    )


@query(
    "stream_decisions",
    f"""WITH {EVENTS_SQL}, firsts AS (SELECT user_id, event_type, whole, min(event_id) AS event_id FROM ev GROUP BY ALL),
    contents AS (SELECT user_id, count(*) AS decisions,
        list(sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}') ORDER BY event_id) AS contents
      FROM firsts GROUP BY user_id)
    SELECT user_id AS packet_id, decisions, {CHAIN_FOLD_SQL} AS last_hash FROM contents""",
)
def stream_decisions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _requests(table(spark, sf_dir, "events")).schema
    text = T.StringType()
    output = T.StructType([*base.fields, T.StructField("previous_hash", text), T.StructField("record_hash", text)])
    rows = _run(spark, sf_dir, lambda *a, **o: stream_decisions(*a, _requests, output, **o), output, "stream-decisions")
    return rows.groupBy("packet_id").agg(
        F.count(F.lit(1)).alias("decisions"), F.max_by("record_hash", "sequence").alias("last_hash")
    )


@query(
    "stream_decision_log",
    f"""WITH {EVENTS_SQL}, parts AS (SELECT *, event_id % 3 AS part FROM ev),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, whole ORDER BY part, event_id) AS rn FROM parts),
    sums AS (SELECT user_id, count(*) FILTER (rn = 1) AS accepted, count(*) FILTER (rn = 1 AND part = 0 AND user_id % 2 = 0) AS replayed,
        count(*) + count(*) FILTER (part = 0 AND user_id % 2 = 0) AS requests FROM ranked GROUP BY user_id),
    contents AS (SELECT user_id, list(sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}') ORDER BY part, event_id)
        AS contents FROM ranked WHERE rn = 1 GROUP BY user_id)
    SELECT user_id AS packet_id, accepted, replayed, requests - accepted - replayed AS terminal, {CHAIN_FOLD_SQL} AS last_hash
    FROM contents JOIN sums USING (user_id)""",
)
def stream_decision_log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in three deliveries, the later ones with late and replayed rows; the stream is restarted for each."""
    place = scratch_path(spark, "decision-log")
    source = table(spark, sf_dir, "events")
    part = F.col("event_id") % 3
    again = source.filter((part == 0) & (F.col("user_id") % 2 == 0))
    for delivery in (source.filter(part == 0), source.filter(part == 1), source.filter(part == 2).unionByName(again)):
        delivery.write.mode("append").parquet(f"{place}/in")
        requests = lambda df: _requests(df).withColumn("expected_previous", F.lit(None).cast("string"))
        job = stream_decision_log(spark, f"{place}/in", source.schema, requests, table=f"{place}/table", checkpoint=f"{place}/checkpoint")
        job.awaitTermination()
    log = spark.read.parquet(f"{place}/table")
    return log.groupBy(F.col("packet_id").cast("bigint").alias("packet_id")).agg(
        *[F.count_if(F.col("status") == name).alias(name) for name in ("accepted", "replayed", "terminal")],
        F.max_by("record_hash", "position").alias("last_hash"),
    )
