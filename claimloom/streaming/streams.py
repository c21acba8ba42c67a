"""Arriving data: triage, content dedupe, inbox completion, progress, attempts, activity windows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from claimloom import config
from claimloom.functions.numbers import clip01
from claimloom.functions.text import finite
from claimloom.operators import keyed, triage


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def triage_stream(articles: DataFrame, keywords: Sequence[str] = tuple(config.MODEL_KEYWORDS)) -> DataFrame:
    """Row-local triage; no state."""
    return triage.triage(articles, keywords)


def route_tiers(first_pass_path: str, backlog_path: str):
    """A foreachBatch sink: first-pass rows and the low backlog go to two tables.

    Each batch writes its own folder and overwrites only that, so a replayed
    batch leaves the same rows as the first try.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        early = F.col("tier").isin(*config.FIRST_PASS_TIERS)
        batch.filter(early).write.mode("overwrite").parquet(f"{first_pass_path}/batch={batch_id}")
        batch.filter(~early).write.mode("overwrite").parquet(f"{backlog_path}/batch={batch_id}")

    return sink


def dedupe_content(documents: DataFrame, ts: str, keys: Sequence[str], delay: str = "30 days") -> DataFrame:
    """The same content is passed on once within the watermark."""
    return documents.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def inbox_completion(requests: DataFrame, arrivals: DataFrame, key: str, delay: str = "1 day", within: str = "7 days") -> DataFrame:
    """Requests with the time their file arrived; still pending ones come out when the watermark has passed.

    requests: (key, requested_at); arrivals: (key, arrived_at).  State is bounded by the time range.
    """
    r = requests.withWatermark("requested_at", delay)
    a = arrivals.select(F.col(key).alias("_key"), "arrived_at").withWatermark("arrived_at", delay)
    within_range = F.expr(f"arrived_at >= requested_at AND arrived_at <= requested_at + INTERVAL {within}")
    joined = r.join(a, (F.col(key) == F.col("_key")) & within_range, "leftOuter")
    return joined.withColumn(
        "status", F.when(F.col("arrived_at").isNull(), F.lit("pending")).otherwise(F.lit("complete"))
    ).drop("_key")


def progress_state(events: DataFrame) -> DataFrame:
    """Latest state per (job, channel): value clipped to 0..1; non-finite values count as 0.

    events: (job, channel, ts, seq, value, status).
    """
    value = clip01(F.coalesce(finite(F.col("value")), F.lit(0.0)))
    state = F.struct("ts", "seq", value.alias("value"), "status")
    last = events.groupBy("job", "channel").agg(F.max(state).alias("s"))
    return last.select("job", "channel", F.col("s.ts").alias("ts"), F.col("s.value").alias("value"),
                       F.col("s.status").alias("status"))


def live_progress(events: DataFrame, delay: str = "1 day", idle: timedelta = timedelta(days=7), linger: timedelta = timedelta(hours=1),
                  buckets: int = 1024) -> DataFrame:
    """The latest state per (job, channel) as a stream of changes whose state leaves again.

    events: (job, channel, ts timestamp, seq, value, status).  A channel's state goes
    when the watermark, ``delay`` behind the newest event, has passed its last event
    by ``linger`` if that was terminal, else by ``idle``.  An event of a channel that
    has left starts it anew; later than the watermark it is dropped, so a row that
    comes out is never older than one before.  Values as in :func:`progress_state`;
    of one time the greatest ``seq`` counts.  A batch gives one row for each channel
    that changed.

    A call of Python and its state cost far more than a row, so a state row holds the
    channels of one of ``buckets`` hashes, as JSON; each channel leaves by itself.
    """
    # Times travel as microseconds, which no session time zone shifts; a row without a time says nothing.
    slim = events.filter(F.col("ts").isNotNull()).select(
        F.pmod(F.xxhash64("job", "channel"), F.lit(buckets)).alias("bucket"), F.col("job").cast("string").alias("job"), F.col("channel").cast("string").alias("channel"),
        "ts", F.unix_micros("ts").alias("at"), F.col("seq").isNotNull().alias("known"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"),
        clip01(F.coalesce(finite(F.col("value")), F.lit(0.0))).alias("value"), F.col("status").cast("string").alias("status"))
    columns, order = ["job", "channel", "at", "seq", "value", "status"], ["at", "known", "seq"]
    terminal, waits = frozenset(config.TERMINAL_PROGRESS), (int(idle.total_seconds() * 1000), int(linger.total_seconds() * 1000))

    def rank(row: tuple) -> tuple:
        return row[0], row[1] is not None, row[1] or 0

    def until(row: tuple) -> int:
        return row[0] // 1000 + waits[row[3] in terminal]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(r[0], r[1]): tuple(r[2:]) for r in json.loads(state.get[0])} if state.exists else {}
        now, touched, changed = state.getCurrentWatermarkMs(), set(), {}
        for part in () if state.hasTimedOut else parts:
            newest = part.sort_values(order).drop_duplicates(["job", "channel"], keep="last")
            texts = [[x if isinstance(x, str) else None for x in newest[c]] for c in ("job", "channel", "status")]
            for job, channel, status, at, known, seq, value in zip(*texts, *(newest[c].tolist() for c in (*order, "value"))):
                name, row = (job, channel), (at, seq if known else None, value, status)
                touched.add(name)
                if name not in held or rank(row) > rank(held[name]):
                    held[name] = changed[name] = row
        held = {name: row for name, row in held.items() if name in touched or until(row) >= now}
        if held:
            state.update((json.dumps([[*name, *row] for name, row in held.items()]),))
            state.setTimeoutTimestamp(max(min(map(until, held.values())), now + 1))
        elif state.exists:
            state.remove()
        if changed:
            yield pd.DataFrame([(*name, *row) for name, row in changed.items()], columns=columns).astype({"seq": "Int64"})

    changes = slim.withWatermark("ts", delay).groupBy("bucket").applyInPandasWithState(
        fold, "job string, channel string, at long, seq long, value double, status string", "channels string", "update", "EventTimeTimeout")
    types = {c: events.schema[c].dataType for c in ("job", "channel")}
    return changes.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()], F.timestamp_micros("at").alias("ts"), *columns[3:])


def close_running(states: DataFrame) -> DataFrame:
    """One row per job: a terminal batch state closes an article that still runs."""
    def pick(channel: str, field: str):
        return F.max(F.when(F.col("channel") == channel, F.col(field)))

    both = states.groupBy("job").agg(
        pick("batch", "value").alias("batch_value"), pick("batch", "status").alias("batch_status"),
        pick("current", "value").alias("current_value"), pick("current", "status").alias("current_status"),
    )
    closed = F.col("batch_status").isin(*config.TERMINAL_PROGRESS) & (F.col("current_status") == "running")
    return both.withColumn("current_status", F.when(closed, F.col("batch_status")).otherwise(
        F.coalesce("current_status", F.lit("idle"))))


def attempt_counters(attempts: DataFrame, key: str, ts: str = "ts", window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Attempts per id and window with first and last time; late attempts count until the watermark passes."""
    return attempts.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), key).agg(
        F.count("*").alias("attempts"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at")
    ).select(key, F.col("w.start").alias("window_start"), "attempts", "first_at", "last_at")


def activity_windows(events: DataFrame, keys: Sequence[str], ts: str = "ts", size: str = "1 day", slide: str | None = None,
                     delay: str = "1 day") -> DataFrame:
    """Tumbling windows, or sliding ones when ``slide`` is given."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(
        F.count("*").alias("n_events"), F.sum("value").alias("total_value")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n_events", "total_value")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "2 hours", delay: str = "1 day") -> DataFrame:
    """Activity per key without a pause of ``gap``.

    In append mode a session comes out, and its state goes, once the watermark has
    passed its end; in complete mode all of them stay.
    """
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(
        F.count("*").alias("n_events"), F.sum("value").alias("total_value")
    ).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total_value")


def drain(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Run a stream over everything that is there now, however long it takes, then stop; the ended query tells its progress."""
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def to_table(df: DataFrame, mode: str, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Drain a stream into a table and read it back.

    Every batch writes its own folder (a replay overwrites the same folder).
    In complete mode each batch holds the whole result, so only the newest
    folder is read; in append mode all folders are.  In update mode a batch holds
    the rows that changed, and the newest row of each of ``keys`` counts: nothing
    is written twice without need, and a watermark can free the state.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    drain(df.writeStream.outputMode(mode).foreachBatch(sink), f"{path}/checkpoint")
    rows = df.sparkSession.read.schema(df.schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if mode == "update":
        return keyed.newest(rows, list(keys), F.col("batch"), [c for c in df.columns if c not in keys]).select(*df.columns)
    if mode != "complete":
        return rows.drop("batch")
    newest = rows.agg(F.max("batch").alias("b")).first()["b"]
    return rows.filter(F.col("batch") == newest).drop("batch")
