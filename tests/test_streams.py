from pyspark.sql import functions as F

from claimloom.session import scratch_path
from claimloom.streaming import streams


def test_progress_channels(spark):
    rows = [("j", "batch", 1, 1, 0.2, "running"), ("j", "batch", 2, 2, 0.375, "running"), ("j", "current", 1, 3, 0.4, "running"), ("k", "batch", 1, 4, 7.0, "done"), ("k", "current", 1, 5, float("nan"), "running")]
    s = streams.close_running(streams.progress_state(spark.createDataFrame(rows, "job string, channel string, ts int, seq int, value double, status string")))
    got = {r["job"]: tuple(r)[1:] for r in s.collect()}
    assert got == {"j": (0.375, "running", 0.4, "running"), "k": (1.0, "done", 0.0, "done")}


def test_stream_equals_batch_over_several_files(spark):
    path = scratch_path(spark, "src")
    ev = spark.range(600).select((F.col("id") % 7).alias("user"), F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 600).alias("ts"), F.col("id").cast("double").alias("value"))
    ev.repartition(6).write.parquet(path)
    src = streams.file_stream(spark, path, ev.schema, files_per_trigger=2)
    out = streams.to_table(streams.activity_windows(src, ["user"], size="6 hours"), "complete", scratch_path(spark, "w"))
    want = streams.activity_windows(spark.read.parquet(path), ["user"], size="6 hours")
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_pending_requests_come_out_when_the_watermark_passes(spark):
    path = scratch_path(spark, "inbox")
    at = lambda h: F.timestamp_seconds(F.lit(1700000000 + h * 3600))
    for n, h in enumerate([0, 1, 200]):
        spark.range(1).select(F.lit(n).cast("string").alias("pmid"), at(h).alias("requested_at")).write.mode("append").parquet(path + "/r")
    spark.range(1).select(F.lit("1").alias("pmid"), at(2).alias("arrived_at")).write.parquet(path + "/a")
    spark.range(1).select(F.lit("9").alias("pmid"), at(200).alias("arrived_at")).write.mode("append").parquet(path + "/a")
    r = streams.file_stream(spark, path + "/r", "pmid string, requested_at timestamp", 1)
    a = streams.file_stream(spark, path + "/a", "pmid string, arrived_at timestamp", 1)
    out = streams.to_table(streams.inbox_completion(r, a, "pmid", "1 hour", "1 DAY"), "append", scratch_path(spark, "out"))
    assert {(x["pmid"], x["status"]) for x in out.collect()} == {("0", "pending"), ("1", "complete")}


def _hourly(spark, batches, schema):
    """A stream of one file a batch; the rows give their time in hours."""
    path = scratch_path(spark, "hours")
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("h") * 3600)).drop("h").coalesce(1).write.mode("append").parquet(path)
    return streams.file_stream(spark, path, spark.read.parquet(path).schema, 1)


def _drained(df, mode):
    """The rows of every batch and the number of state rows after each."""
    path, batches = scratch_path(df.sparkSession, "drained"), []
    done = streams.drain(df.writeStream.outputMode(mode).foreachBatch(lambda rows, n: batches.append([tuple(r) for r in rows.collect()])), path)
    return batches, [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress]


def test_progress_leaves_the_state_after_its_end(spark):
    schema = "job string, channel string, h int, seq int, value double, status string"
    source = _hourly(spark, [
        [("a", "batch", 0, 1, 0.2, "running"), ("a", "batch", 0, 2, 1.7, "done"), ("b", "batch", 0, 3, float("nan"), "running"), ("n", None, 0, None, None, None)],
        [("b", "batch", 9, 4, 0.5, "running"), ("b", "batch", 8, 5, 0.4, "running")],
        [("c", "batch", 200, 6, 0.1, "running"), ("b", "batch", 199, 8, 0.6, "running")],
        [("a", "batch", 1, 7, 0.3, "running"), ("c", "batch", 200, 5, 0.9, "error")],
    ], schema)
    batches, state = _drained(streams.live_progress(source, "2 hours"), "update")
    seen = [{(r[0], r[4], r[5]) for r in rows} for rows in batches if rows]
    assert seen == [{("a", 1.0, "done"), ("b", 0.0, "running"), ("n", 0.0, None)}, {("b", 0.5, "running")}, {("c", 0.1, "running"), ("b", 0.6, "running")}]
    assert max(state) >= 3 and state[-1] == 2


def test_channels_of_one_state_row_leave_by_themselves(spark):
    rows = [[(j, "batch", 0, j, 0.25, "done" if j % 2 else "running") for j in range(40)], [(50, "batch", 30, 99, 0.5, "running")], [(2, "batch", 31, 100, 0.75, "running"), (50, "batch", 30, 7, 0.1, "done")],
            [(51, "batch", 400, 101, 0.1, "running")]]
    source = _hourly(spark, rows, "job long, channel string, h int, seq int, value double, status string")
    batches, state = _drained(streams.live_progress(source, "2 hours", buckets=1), "update")
    assert [sorted((r[0], r[4]) for r in x) for x in batches if x] == [[(j, 0.25) for j in range(40)], [(50, 0.5)], [(2, 0.75)], [(51, 0.1)]]
    assert max(state) == 1 and type(batches[0][0][0]) is int


def test_closed_sessions_leave_the_state(spark):
    source = _hourly(spark, [[("u", 0, 1.0), ("u", 1, 1.0), ("v", 0, 5.0)], [("u", 30, 1.0)], [("u", 60, 1.0)]], "user string, h int, value double")
    batches, state = _drained(streams.sessions(source, "user", delay="3 hours"), "append")
    assert sorted((r[0], r[3], r[4]) for rows in batches for r in rows) == [("u", 1, 1.0), ("u", 2, 2.0), ("v", 1, 5.0)]
    assert state[-1] == 1
