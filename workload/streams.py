"""Streams over the given files, drained and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.session import scratch_path
from claimloom.streaming import streams
from workload import fixtures as fx
from workload.aggregates import PROGRESS
from workload.registry import Tables, query


def table_stream(spark, sf, name):
    schema = getattr(Tables(spark, sf), name).schema
    # a pattern, so that the table may be one file or a folder of files
    rows = streams.file_stream(spark, f"{sf.rstrip('/')}/{name}.parque[t]", schema)
    return rows.withColumn("ts", fx.instant("ts")) if "ts" in rows.columns else rows


@query("j01_arriving_triage", f"""
WITH s AS (SELECT doc_id, least({fx.sql_score('text')}, 4) AS sc, text FROM documents),
p AS (SELECT doc_id, CASE WHEN text = '' THEN 0.05::DOUBLE ELSE [0.08, 0.48, 0.72, 0.88, 0.94]::DOUBLE[][sc + 1] END AS p FROM s)
SELECT doc_id, p AS relevant_probability, CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.3 THEN 'intermediate' ELSE 'low' END AS tier, CASE WHEN p >= 0.3 THEN 'first_pass' ELSE 'backlog' END AS sink FROM p
""".replace("[0.08, 0.48, 0.72, 0.88, 0.94]::DOUBLE[][sc + 1]", "list_extract([0.08, 0.48, 0.72, 0.88, 0.94]::DOUBLE[], sc + 1)"))
def arriving_triage(spark, sf):
    docs = table_stream(spark, sf, "documents").select("doc_id", (F.col("doc_id") + 1000000).cast("string").alias("pmid"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    path = scratch_path(spark, "triage")
    rows = streams.triage_stream(docs, fx.WORDS).select("doc_id", "relevant_probability", "tier")
    streams.drain(rows.writeStream.outputMode("append").foreachBatch(streams.route_tiers(f"{path}/first", f"{path}/backlog")), f"{path}/checkpoint")
    read = lambda side: spark.read.schema(rows.schema).parquet(f"{path}/{side}/batch=*")
    return read("first").withColumn("sink", F.lit("first_pass")).unionByName(read("backlog").withColumn("sink", F.lit("backlog")))


@query("j02_content_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def content_dedupe(spark, sf):
    ev = table_stream(spark, sf, "events").select("user_id", "event_type", "ts")
    unique = streams.dedupe_content(ev, "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type")
    return streams.to_table(unique, "append", scratch_path(spark, "dedupe"))


@query("j03_inbox_completion", """
SELECT v.event_id AS request_id, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS arrived, 'complete' AS status FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 DAY
UNION ALL SELECT v.event_id, NULL, 'pending' FROM events v WHERE v.event_type = 'view'
  AND v.ts + INTERVAL 1 DAY < (SELECT least(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type = 'purchase')) - INTERVAL 1 DAY FROM events)
  AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 DAY)
""")
def inbox_completion(spark, sf):
    requests = table_stream(spark, sf, "events").filter("event_type = 'view'").select("user_id", F.col("event_id").alias("request_id"), F.col("ts").alias("requested_at"))
    arrivals = table_stream(spark, sf, "events").filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("arrived_at"))
    done = streams.inbox_completion(requests, arrivals, "user_id", "1 day", "1 DAY")
    rows = streams.to_table(done, "append", scratch_path(spark, "inbox"))
    # a pending request comes out once the watermark, a day behind the slower stream, has passed its range
    return rows.select("request_id", fx.utc_text("arrived_at", "yyyy-MM-dd HH:mm:ss").alias("arrived"), "status")


@query("j04_progress_state", f"WITH {PROGRESS} SELECT job, channel, round(value, 6) AS value, status FROM last")
def progress_state(spark, sf):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").otherwise("running")
    ev = table_stream(spark, sf, "events").select(
        F.col("user_id").alias("job"), F.when(F.col("event_type").isin("click", "purchase", "error"), "batch").otherwise("current").alias("channel"), "ts",
        F.col("event_id").alias("seq"), (F.col("value") / 50 - 0.1).alias("value"), status.alias("status"))
    rows = streams.to_table(streams.live_progress(ev), "update", scratch_path(spark, "progress"), ["job", "channel"])
    return rows.select("job", "channel", fx.r6("value").alias("value"), "status")


@query("j05_attempt_counters", """
SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS attempts, strftime(min(ts), '%H:%M:%S') AS first_at, strftime(max(ts), '%H:%M:%S') AS last_at FROM events GROUP BY 1, 2
""")
def attempt_counters(spark, sf):
    rows = streams.to_table(streams.attempt_counters(table_stream(spark, sf, "events"), "user_id"), "update", scratch_path(spark, "attempts"), ["user_id", "window_start"])
    return rows.select("user_id", fx.utc_text("window_start", "yyyy-MM-dd").alias("day"), "attempts", fx.utc_text("first_at", "HH:mm:ss").alias("first_at"), fx.utc_text("last_at", "HH:mm:ss").alias("last_at"))


@query("j06_activity_windows", """
SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS start, count(*) AS n_events, round(sum(value), 2) AS total_value FROM events GROUP BY 1, 2
""")
def activity_windows(spark, sf):
    ev = table_stream(spark, sf, "events").select("ts", "event_type", "value")
    rows = streams.to_table(streams.activity_windows(ev, ["event_type"], size="6 hours"), "update", scratch_path(spark, "windows"), ["window_start", "event_type"])
    return rows.select("event_type", fx.utc_text("window_start", "yyyy-MM-dd HH").alias("start"), "n_events", F.round("total_value", 2).alias("total_value"))


@query("j06_sliding_windows", """
WITH w AS (SELECT *, unnest([0, 6]) AS back FROM events)
SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts) - to_hours(back), '%Y-%m-%d %H') AS start, count(*) AS n_events, round(sum(value), 2) AS total_value FROM w GROUP BY 1, 2
""")
def sliding_windows(spark, sf):
    ev = table_stream(spark, sf, "events").select("ts", "event_type", "value")
    rows = streams.to_table(streams.activity_windows(ev, ["event_type"], size="12 hours", slide="6 hours"), "update", scratch_path(spark, "sliding"), ["window_start", "event_type"])
    return rows.select("event_type", fx.utc_text("window_start", "yyyy-MM-dd HH").alias("start"), "n_events", F.round("total_value", 2).alias("total_value"))


@query("j06_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n_events, round(sum(value), 2) AS total_value FROM s GROUP BY user_id, sid
""")
def sessions(spark, sf):
    ev = table_stream(spark, sf, "events").select("ts", "user_id", "value")
    rows = streams.to_table(streams.sessions(ev, "user_id"), "complete", scratch_path(spark, "sessions"))
    return rows.select("user_id", fx.utc_text("session_start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n_events", F.round("total_value", 2).alias("total_value"))


@query("j06_closed_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n_events, round(sum(value), 2) AS total_value FROM s GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
""")
def closed_sessions(spark, sf):
    # the sessions that the watermark, a day behind the newest event, has passed; those still open stay in the state
    ev = table_stream(spark, sf, "events").select("ts", "user_id", "value")
    rows = streams.to_table(streams.sessions(ev, "user_id"), "append", scratch_path(spark, "closed"))
    return rows.select("user_id", fx.utc_text("session_start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n_events", F.round("total_value", 2).alias("total_value"))
