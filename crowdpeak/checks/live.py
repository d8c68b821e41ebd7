"""Streaming queries: the events file is read as a stream, run to its end, and the sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdpeak.checks import views as v
from crowdpeak.checks.feeds import fresh
from crowdpeak.checks.intervals import STAGE_1
from crowdpeak.checks.registry import query
from crowdpeak.checks.views import with_sql
from crowdpeak.functions.numbers import rounded
from crowdpeak.streaming import live


def event_stream(spark, path, files: str = "events.parque[t]"):
    """Chat of all recordings in time order: a day of `events` is played in one hour, one after the other."""
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    # A pattern instead of a plain path: it stands for a single file as well as for a folder of files.
    raw = spark.readStream.schema(schema).parquet(f"{path}/{files}")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    micros = F.floor((day * 86_400_000_000 + v.micros_of_day()) / 24).cast("long")
    return raw.select(
        F.date_format("ts", "yyyy-MM-dd").alias("video_id"), F.timestamp_micros(micros).alias("ts"),
        F.timestamp_micros(day * 3_600_000_000).alias("begin"), F.col("value").alias("joy_pct"), "event_type")


def run(stream, folder: str):
    """Run a stream over all input and read what it wrote. The sink is a file table, so no result sits in memory."""
    done = stream.option("checkpointLocation", f"{folder}_state").trigger(availableNow=True).start()
    done.awaitTermination()


LIVE = """live AS (
  SELECT strftime(ts, '%Y-%m-%d') AS video_id, CAST(epoch_us(ts) AS BIGINT) // 24 AS us,
    CAST(epoch_us(ts) AS BIGINT) // 86400000000 * 3600000000 AS begin_us, value AS joy_pct FROM events),
slots AS (
  SELECT *, unnest(range(us // 5000000 - 6, us // 5000000 + 1)) AS k FROM live),
live_windows AS (
  SELECT video_id, k * 5000000 AS start_us, count(*) AS chat_count, avg(joy_pct) AS avg_joy, max(joy_pct) AS max_joy
  FROM slots WHERE us >= k * 5000000 AND us <= k * 5000000 + 30000000 AND k * 5000000 >= begin_us
  GROUP BY ALL)"""


@query("str_1_live_windows", with_sql(LIVE, select="""
SELECT video_id, start_us, chat_count, round(avg_joy * 0.7::DOUBLE + max_joy * 0.3::DOUBLE + 1e-9, 6) AS chat_score
FROM live_windows
WHERE start_us + 30000001 <= ((SELECT max(us) FROM live) // 1000 - 30000) * 1000"""))
def live_windows(spark, path):
    folder = fresh(spark, "live_windows")
    out = live.live_windows(event_stream(spark, path), start="begin")
    run(out.writeStream.outputMode("append").format("parquet").option("path", folder), folder)
    return spark.read.parquet(folder).select(
        "video_id", F.unix_micros("window_start").alias("start_us"), "chat_count",
        rounded(F.col("chat_score"), 6).alias("chat_score"))


@query("str_1_broadcast_end", with_sql(LIVE.split(",\nslots AS")[0], """ends AS (
  SELECT video_id, begin_us, round((max(us) - begin_us) / 1e6 + 30 + 1e-9, 2) AS d FROM live GROUP BY video_id, begin_us)""", """grid AS (
  SELECT video_id, begin_us, k, least(5.0::DOUBLE * k + 30, d) AS end_sec FROM ends, range(0, 100000) r(k) WHERE 5 * k + 30 <= d + 5 AND 5 * k < d)""",
select="""
SELECT g.video_id, g.k, 5.0::DOUBLE * g.k AS start_sec, g.end_sec, count(us) AS chat_count,
  round(coalesce(avg(joy_pct) * 0.7::DOUBLE + max(joy_pct) * 0.3::DOUBLE, 0.0::DOUBLE) + 1e-9, 6) AS chat_score
FROM grid g LEFT JOIN live l ON l.video_id = g.video_id AND us - g.begin_us >= g.k * 5000000 AND us - g.begin_us <= g.k * 5000000 + 30000000
GROUP BY ALL"""))
def broadcast_end(spark, path):
    # After all events one comes two days later, so that the last broadcast of the table is silent for long enough.
    folder = fresh(spark, "ends")
    events = v.table(spark, path, "events")
    last = events.agg(F.max("ts").alias("ts")).select(F.date_add(F.col("ts").cast("date"), 2).cast("timestamp_ntz").alias("ts"))
    live.use_keyed_state(spark)
    try:
        for arrived in (events, last.select(*[F.col("ts").cast(events.schema["ts"].dataType).alias("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])):
            arrived.write.mode("append").parquet(f"{folder}_in/events.parquet")
            out = live.broadcast_windows(event_stream(spark, f"{folder}_in"))
            run(out.writeStream.outputMode("append").format("parquet").option("path", folder), folder)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(folder).select("video_id", "k", "start_sec", "end_sec", "chat_count", rounded(F.col("chat_score"), 6).alias("chat_score"))


@query("str_2_late_rows_are_dropped", with_sql(LIVE.split(",\nslots AS")[0].replace(
    "value AS joy_pct", "value AS joy_pct, event_type = 'error' AS late"), """closed AS (
  SELECT (max(us) // 1000 - 30000) * 1000 AS first_mark FROM live WHERE NOT late),
slots AS (SELECT *, unnest(range(us // 5000000 - 6, us // 5000000 + 1)) AS k FROM live)""", select="""
SELECT video_id, k * 5000000 AS start_us, count(*) AS chat_count FROM slots, closed
WHERE us >= k * 5000000 AND us <= k * 5000000 + 30000000 AND k * 5000000 >= begin_us
  AND (NOT late OR k * 5000000 + 30000001 > first_mark)
  AND k * 5000000 + 30000001 <= ((SELECT max(us) FROM live) // 1000 - 30000) * 1000
GROUP BY ALL"""))
def late_rows(spark, path):
    # Events of one type arrive after all others. The stream stops in between and goes on from its checkpoint; windows
    # that were closed by then do not count them.
    folder = fresh(spark, "late")
    events = v.table(spark, path, "events")
    for arrived in (F.col("event_type") != "error", F.col("event_type") == "error"):
        events.filter(arrived).write.mode("append").parquet(f"{folder}_in/events.parquet")
        out = live.live_windows(event_stream(spark, f"{folder}_in"), start="begin")
        run(out.writeStream.outputMode("append").format("parquet").option("path", folder), folder)
    return spark.read.parquet(folder).select(
        "video_id", F.unix_micros("window_start").alias("start_us"), "chat_count")


@query("str_3_live_dedup", """
SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS video_id, CAST(epoch_us(ts) AS BIGINT) % 86400000000 // 14400000000 * 600000
  AS time_ms, event_type AS chat_message FROM events""")
def live_dedup(spark, path):
    folder = fresh(spark, "live_dedup")
    # Messages carry a time in whole minutes, so that repeats occur.
    since = F.unix_micros("ts") - F.unix_micros("begin")
    stream = event_stream(spark, path).select(
        "video_id", "ts", (F.floor(since / 600_000_000) * 600_000).cast("long").alias("time_ms"),
        F.col("event_type").alias("chat_message"))
    out = live.without_replays(stream)
    run(out.writeStream.outputMode("append").format("parquet").option("path", folder), folder)
    return spark.read.parquet(folder).select("video_id", "time_ms", "chat_message")


STATS_FROM_CHATS = """stats AS (
  SELECT video_id, round(max(t) + 30 + 1e-9, 2) AS duration_sec,
    round(avg(joy_pct) + 0.5 * stddev_pop(joy_pct) + 1e-9, 2) AS calculated_threshold FROM chats GROUP BY video_id)"""

#: Recordings of days divisible by 4 last 20 seconds and hold only the scores 0 and 10: together they have no candidate,
#: but those that came first, all of score 10, have one.
CALM = """chats AS (
  SELECT video_id, CASE WHEN calm THEN t / 180 ELSE t END AS t, CASE WHEN calm THEN event_id % 2 * 10.0::DOUBLE ELSE joy_pct END AS joy_pct
  FROM (SELECT *, CAST(right(video_id, 2) AS INTEGER) % 4 = 0 AS calm FROM all_chats))"""


def batches_of(spark, path: str, parts: int):
    """Chat rows in `parts` batches: of calm recordings the scores of 10 come first."""
    c = v.chats(spark, path).select("video_id", "t", "joy_pct", "event_id")
    calm = F.substring("video_id", 9, 2).cast("int") % 4 == 0
    odd = F.col("event_id") % 2
    return c.select(
        "video_id", F.when(calm, F.col("t") / 180).otherwise(F.col("t")).alias("t"),
        F.when(calm, odd * 10.0).otherwise(F.col("joy_pct")).alias("joy_pct"),
        F.when(calm, F.when(odd == 1, 0).otherwise(1 + F.col("event_id") / 2 % (parts - 1))).otherwise(F.col("event_id") % parts)
        .cast("int").alias("part"))


@query("str_4_candidate_refresh", with_sql(v.CHATS.replace("chats AS", "all_chats AS", 1), CALM, STATS_FROM_CHATS, *STAGE_1[2:], select="""
SELECT video_id, start_time, end_time, window_score, chat_count FROM stage_1"""))
def candidate_refresh(spark, path):
    folder = fresh(spark, "refresh")
    rows, schema = batches_of(spark, path, 3), "video_id string, t double, joy_pct double"
    refresh = live.candidate_refresh(live.SlotState(spark, f"{folder}/slots", buckets=4), folder)
    for part in range(3):  # three batches; the stream goes on from its checkpoint
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}_in")
        run(spark.readStream.schema(schema).parquet(f"{folder}_in").writeStream.foreachBatch(refresh), folder)
    read = spark.read.option("recursiveFileLookup", "true")
    return live.latest_candidates(read.parquet(f"{folder}/candidates"), read.parquet(f"{folder}/touched")).select(
        "video_id", "start_time", "end_time", "window_score", "chat_count")
