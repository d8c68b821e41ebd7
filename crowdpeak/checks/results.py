"""Queries on the result view, joins with intervals, signals, and job history."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdpeak import fixed_values as fv
from crowdpeak.checks import views as v
from crowdpeak.checks.feeds import fresh
from crowdpeak.checks.intervals import HIGHLIGHTS, highlights
from crowdpeak.checks.registry import query
from crowdpeak.checks.views import JOBS, with_sql
from crowdpeak.functions.numbers import rounded
from crowdpeak.operators import buckets, jobs, report, signals
from crowdpeak.plans import analysis
from crowdpeak.session import cut_lineage
from crowdpeak.sources.job_log import JobLog

def found_highlights(spark, path):
    """The highlights, written once: the operators below read them several times."""
    return cut_lineage(highlights(spark, path))


VIEW_Z = """lengths AS (
  SELECT video_id, greatest(max(t), (SELECT max(end_time) FROM highlights h WHERE h.video_id = chats.video_id)) AS len
  FROM chats GROUP BY video_id),
view_windows AS (
  SELECT l.video_id, k, 5.0::DOUBLE * k AS s, least(5.0::DOUBLE * k + 30, len) AS e, avg(c.joy_pct) AS joy
  FROM lengths l JOIN range(0, 100000) r(k) ON 5 * k + 30 <= len + 5 AND (k = 0 OR 5 * k < len)
    JOIN chats c ON c.video_id = l.video_id AND c.t >= 5.0::DOUBLE * k AND c.t <= least(5.0::DOUBLE * k + 30, len)
  GROUP BY ALL),
moments AS (SELECT video_id, avg(joy) AS mu, stddev_pop(joy) AS sd FROM view_windows GROUP BY video_id),
zs AS (
  SELECT h.video_id, h.start_time, h.end_time, avg(w.joy) AS mean_joy, any_value(mu) AS mu, any_value(sd) AS sd,
    (avg(w.joy) - any_value(mu)) / any_value(sd) AS z
  FROM highlights h JOIN view_windows w ON w.video_id = h.video_id AND w.s >= h.start_time AND w.e <= h.end_time
    JOIN moments m ON m.video_id = h.video_id
  GROUP BY h.video_id, h.start_time, h.end_time),
mean_z AS (SELECT video_id, avg(z) AS z FROM zs GROUP BY video_id),
scores AS (
  SELECT video_id, z, (CASE WHEN z >= 0 THEN (1 + erf) / 2 ELSE (1 - erf) / 2 END) * 100 AS score FROM (
    SELECT *, 1 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t
      - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x) AS erf FROM (
      SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM (
        SELECT video_id, z, abs(z) / sqrt(2.0::DOUBLE) AS x FROM mean_z))))"""
PEAKS = """peaks AS (
  SELECT video_id, t AS peak_t, joy_pct AS peak_joy, chat_text AS peak_text FROM chats
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY joy_pct DESC, t, event_id) = 1)"""
TOTALS = """totals AS (
  SELECT s.video_id, coalesce(n, 0) AS highlight_count, coalesce(sec, 0.0::DOUBLE) AS highlight_sec,
    greatest(coalesce(greatest(last_t, last_e), 0.0::DOUBLE), 1.0::DOUBLE) AS timeline_sec
  FROM stats s LEFT JOIN (SELECT video_id, count(*) AS n, sum(end_time - start_time) AS sec, max(end_time) AS last_e
      FROM highlights GROUP BY ALL) h USING (video_id)
    LEFT JOIN (SELECT video_id, max(t) AS last_t FROM chats GROUP BY ALL) USING (video_id))"""
MEANS = """means AS (
  SELECT video_id, [""" + ", ".join(f"round(avg({f}), 9)" for f in fv.EMOTION_FIELDS[:-1]) + """] AS m FROM chats c
  WHERE EXISTS (SELECT 1 FROM highlights h WHERE h.video_id = c.video_id AND c.t >= h.start_time AND c.t <= h.end_time)
  GROUP BY video_id),
dominant AS (
  SELECT s.video_id, """ + str(fv.EMOTIONS[:-1]) + """[list_position(m, list_max(m))] AS dominant_emotion
  FROM stats s LEFT JOIN means USING (video_id))"""


@query("agg_11_highlight_z", with_sql(*HIGHLIGHTS, VIEW_Z, recursive=True, select="""
SELECT video_id, start_time, end_time, round(mean_joy + 1e-9, 6) AS mean_joy, round(mu + 1e-9, 6) AS mu,
  round(sd + 1e-9, 6) AS sd, round(z + 1e-9, 6) AS z FROM zs"""))
def highlight_z(spark, path):
    z = report.highlight_z(v.chats(spark, path), found_highlights(spark, path))
    return z.select("video_id", "start_time", "end_time",
                    *[rounded(F.col(c), 6).alias(c) for c in ("mean_joy", "mu", "sd", "z")])


@query("agg_12_reaction_score", with_sql(*HIGHLIGHTS, VIEW_Z, recursive=True, select="""
SELECT video_id, round(z + 1e-9, 6) AS mean_z, round(score + 1e-9, 5) AS score FROM scores"""))
def reaction_score(spark, path):
    out = report.reaction_score(v.chats(spark, path), found_highlights(spark, path), v.stats(spark, path))
    return out.select("video_id", rounded(F.col("mean_z"), 6).alias("mean_z"),
                      rounded(F.col("score"), 5).alias("score"))


@query("agg_13_peak", with_sql(v.CHATS, PEAKS, select="SELECT * FROM peaks"))
def peak(spark, path):
    return report.peak_points(v.chats(spark, path), tie="event_id")


@query("agg_14_dominant_emotion", with_sql(*HIGHLIGHTS, MEANS, recursive=True, select="SELECT * FROM dominant"))
def dominant_emotion(spark, path):
    return report.dominant_emotion(v.chats(spark, path), highlights(spark, path), v.stats(spark, path))


@query("agg_15_highlight_totals", with_sql(*HIGHLIGHTS, TOTALS, recursive=True, select="SELECT * FROM totals"))
def highlight_totals(spark, path):
    return report.highlight_totals(v.chats(spark, path), found_highlights(spark, path), v.stats(spark, path))


@query("view_recording_report", with_sql(*HIGHLIGHTS, VIEW_Z, PEAKS, TOTALS, MEANS, recursive=True, select="""
SELECT t.*, round(score + 1e-9, 5) AS score, peak_t, peak_joy, peak_text, dominant_emotion
FROM totals t JOIN scores USING (video_id) JOIN peaks USING (video_id) JOIN dominant USING (video_id)"""))
def recording_report(spark, path):
    found = found_highlights(spark, path)
    out = analysis.video_report(v.chats(spark, path), found, v.stats(spark, path), tie="event_id")
    return out.withColumn("score", rounded(F.col("score"), 5))


@query("join_3_chats_in_highlights", with_sql(*HIGHLIGHTS, recursive=True, select="""
SELECT c.event_id, h.video_id, h.rank, c.t FROM chats c
  JOIN highlights h ON h.video_id = c.video_id AND c.t >= h.start_time AND c.t <= h.end_time"""))
def chats_in_highlights(spark, path):
    found = highlights(spark, path).select("video_id", "rank", "start_time", "end_time")
    return buckets.interval_join(v.chats(spark, path), found).select("event_id", "video_id", "rank", "t")


@query("flt_7_chat_log", with_sql(*HIGHLIGHTS, recursive=True, select="""
SELECT h.video_id, h.rank, count(*) AS points, count(*) FILTER (WHERE chat_text <> 'view') AS log_lines
FROM (SELECT * FROM chats) c
  JOIN highlights h ON h.video_id = c.video_id AND c.t >= h.start_time AND c.t <= h.end_time GROUP BY ALL"""))
def chat_log(spark, path):
    found = highlights(spark, path).select("video_id", "rank", "start_time", "end_time")
    chats = v.chats(spark, path).withColumn("chat_text", F.when(F.col("chat_text") != "view", F.col("chat_text")))
    inside = buckets.interval_join(chats, found)
    return inside.groupBy("video_id", "rank").agg(
        F.count("*").alias("points"), F.count_if(F.length("chat_text") > 0).alias("log_lines"))


POSITIONS = """positions AS (
  SELECT strftime(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER), '%Y-%m-%d') AS video_id, o_orderkey,
    (o_custkey * 37 + o_orderkey) % 36000 / 10.0::DOUBLE AS cur
  FROM orders)"""


@query("join_5_asof_last_chat", with_sql(v.CHATS, POSITIONS, select="""
SELECT p.o_orderkey, p.video_id, p.cur, (SELECT arg_max(event_id, (t, event_id)) FROM chats c
  WHERE c.video_id = p.video_id AND c.t <= p.cur) AS last_event FROM positions p"""))
def asof_last_chat(spark, path):
    at = v.table(spark, path, "orders").select(
        "o_orderkey", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")),
                                    "yyyy-MM-dd").alias("video_id"),
        ((F.col("o_custkey") * 37 + F.col("o_orderkey")) % 36000 / 10.0).alias("cur"))
    chats = v.chats(spark, path).select("video_id", "t", "event_id")
    out = buckets.asof_last(at, chats, "event_id", left_t="cur", tie="event_id", out="last_event")
    return out.drop("last_event_t")


@query("join_9_clip_links", with_sql(*HIGHLIGHTS, recursive=True, select="""
SELECT h.video_id, h.rank, CASE WHEN h.rank - 1 < 1 + CAST(right(h.video_id, 2) AS INTEGER) % 12
  THEN '/files/' || h.video_id || '_highlight_' || h.rank || '.mp4' END AS clip_url FROM highlights h"""))
def clip_links(spark, path):
    made = v.stats(spark, path).select("video_id", F.explode(F.sequence(
        F.lit(0), F.substring("video_id", 9, 2).cast("int") % 12)).alias("clip_no")).withColumn(
        "path", F.format_string("clip_%d.mp4", "clip_no"))
    return report.with_clip_links(highlights(spark, path), made).select("video_id", "rank", "clip_url")


STATES = """states AS (
  SELECT * FROM jobs QUALIFY row_number() OVER (
    PARTITION BY video_id ORDER BY (status = 'cancelled') DESC, updated_at DESC) = 1)"""


@query("join_10_result_view", with_sql(JOBS, STATES, """points AS (
  SELECT o_custkey AS video_id, count(*) AS points FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
found AS (SELECT o_custkey AS video_id, count(*) AS highlights FROM orders GROUP BY ALL),
progress AS (SELECT c_custkey AS video_id, c_nationkey % 5 + 1 AS step FROM customer)""", select="""
SELECT s.video_id, status, points, highlights, step,
  CASE WHEN status = 'done' AND highlights > 0 THEN '/files/' || s.video_id || '_highlight.mp4' END AS final_video_url
FROM states s LEFT JOIN points USING (video_id) LEFT JOIN found USING (video_id) LEFT JOIN progress USING (video_id)"""))
def result_view(spark, path):
    orders = v.table(spark, path, "orders")
    series = v.table(spark, path, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("video_id"))
    found = orders.select(F.col("o_custkey").alias("video_id"))
    progress = v.table(spark, path, "customer").select(
        F.col("c_custkey").alias("video_id"), (F.col("c_nationkey") % 5 + 1).alias("step"))
    states = jobs.current_states(v.jobs(spark, path)).select("video_id", "status")
    return report.result_view(states, series, found, progress)


@query("join_11_history_state", with_sql(JOBS, STATES, select="""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey AS video_id,
  CASE WHEN host <> '3' THEN status ELSE 'unreachable' END AS status
FROM lineitem l JOIN states s ON s.video_id = l.l_partkey"""))
def history_state(spark, path):
    states = jobs.current_states(v.jobs(spark, path)).select(
        "video_id", "status", (F.col("host") != "3").alias("reachable"))
    history = v.table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("video_id"))
    return report.history_with_state(history, states)


@query("top_7_recent_history", with_sql(JOBS, select="""
SELECT host, video_id, event_no, position FROM (SELECT *, row_number() OVER (
  PARTITION BY host ORDER BY updated_at DESC, event_no DESC) AS position FROM jobs) WHERE position <= 30"""))
def recent_history(spark, path):
    return report.recent_history(v.jobs(spark, path), "host", "updated_at", "event_no").select(
        "host", "video_id", "event_no", "position")


@query("job_1_current_state", with_sql(JOBS, STATES, select="""
SELECT video_id, status, updated_at, host, event_no FROM states"""))
def current_state(spark, path):
    return jobs.current_states(v.jobs(spark, path)).select("video_id", "status", "updated_at", "host", "event_no")


LOGGED = """logged AS (
  SELECT *, TIMESTAMP '1994-01-01' + to_days(CAST(video_id % 90 AS INTEGER)) + to_hours(CAST(video_id % 24 AS INTEGER)) AS created_at FROM jobs)"""


def job_log(spark, path):
    """Events in three appends, the first two compacted; jobs of the same day are in all of them."""
    events = v.jobs(spark, path).withColumn("created_at", F.to_timestamp_ntz(F.lit("1994-01-01 00:00:00")) + F.make_dt_interval(
        (F.col("video_id") % 90).cast("int"), (F.col("video_id") % 24).cast("int")))
    log = JobLog(spark, fresh(spark, "job_log"))
    for part in range(3):
        log.append(events.filter(F.col("event_no") % 3 == part).withColumnRenamed("day", "on"), F.trunc(F.to_date("on"), "month"))
        if part < 2:
            log.compact()
    return log


@query("job_1_compacted_log", with_sql(JOBS, STATES, select="""
SELECT video_id, status, updated_at, host, event_no FROM states"""))
def compacted_log(spark, path):
    return job_log(spark, path).current().select("video_id", "status", "updated_at", "host", "event_no")


@query("job_3_log_retention", with_sql(JOBS, LOGGED, """states AS (
  SELECT * FROM logged QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY (status = 'cancelled') DESC, updated_at DESC) = 1)""", select="""
SELECT video_id, status, created_at < TIMESTAMP '1994-02-10 14:00:00' - INTERVAL 4 HOUR AS expired FROM states"""))
def log_retention(spark, path):
    log, now = job_log(spark, path), F.to_timestamp_ntz(F.lit("1994-02-10 14:00:00"))
    log.compact()
    gone = log.expired(now).select("video_id", "status", F.lit(True).alias("expired"))
    gone = cut_lineage(gone)
    log.forget(now)
    return gone.unionByName(log.current().select("video_id", "status", F.lit(False).alias("expired")))


@query("job_2_stale_sweep", with_sql(JOBS, select="""
SELECT event_no, CASE WHEN stale THEN 'failed' ELSE status END AS status,
  CASE WHEN stale THEN '서버가 다시 시작되어 분석이 중단됐어요. 다시 분석해 주세요.' END AS error,
  CASE WHEN stale THEN 99 ELSE updated_at END AS updated_at
FROM (SELECT *, host = '2' AND status IN ('queued', 'downloading', 'analyzing') AS stale FROM jobs)"""))
def stale_sweep(spark, path):
    events = v.jobs(spark, path).withColumn("error", F.lit(None).cast("string"))
    return jobs.fail_stale(events, "2", F.lit(99).cast("long")).select("event_no", "status", "error", "updated_at")


@query("job_3_retention", """
WITH made AS (SELECT o_orderkey, o_custkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created_at FROM orders),
gone AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS owner FROM made
  WHERE created_at < TIMESTAMP '1995-02-01 12:00:00' - INTERVAL 4 HOUR),
files AS (
  SELECT l_partkey || '_highlight' || CASE WHEN l_linenumber > 1 THEN '_' || l_linenumber ELSE '' END || '.mp4' AS name,
    l_orderkey, l_shipdate AS modified_at FROM lineitem)
SELECT name, l_orderkey, CASE WHEN owner IS NOT NULL THEN 'job' ELSE 'age' END AS reason
FROM files LEFT JOIN gone ON owner = regexp_extract(name, '^(.+)_highlight', 1)
WHERE owner IS NOT NULL OR modified_at < TIMESTAMP '1995-02-01 12:00:00' - INTERVAL 4 HOUR""")
def retention(spark, path):
    now = F.to_timestamp_ntz(F.lit("1995-02-01 12:00:00"))
    made = v.table(spark, path, "orders").select(
        F.col("o_custkey").alias("video_id"), (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(
            hours=(F.col("o_orderkey") % 24).cast("int"))).alias("created_at"))
    number = F.when(F.col("l_linenumber") > 1, F.concat(F.lit("_"), "l_linenumber")).otherwise("")
    files = v.table(spark, path, "lineitem").select(
        F.concat("l_partkey", F.lit("_highlight"), number, F.lit(".mp4")).alias("name"), "l_orderkey",
        F.col("l_shipdate").cast("timestamp_ntz").alias("modified_at"))
    return jobs.expired_files(files, made, now).select("name", "l_orderkey", "reason")


# --- signals ----------------------------------------------------------------------------------------

@query("agg_18_screen_change", """
WITH masked AS (
  SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN (i - 1) // 8 >= 2 AND (i - 1) // 8 < 6
    AND (i - 1) % 8 >= 4 AND (i - 1) % 8 < 8 THEN 0 ELSE x::DOUBLE END) AS px FROM embeddings),
paired AS (SELECT vec_id, px, lag(px) OVER (ORDER BY vec_id) AS before FROM masked)
SELECT vec_id AS scene, round(list_sum(list_transform(list_zip(px, before), lambda z: abs(z[1] - z[2]))) / len(px)
  + 1e-9, 6) AS value FROM paired WHERE before IS NOT NULL""")
def screen_change(spark, path):
    px = signals.masked(F.col("embedding"), 8, 8, (0.25, 0.5, 0.75, 1.0))
    frames = v.table(spark, path, "embeddings").select(
        F.lit("all").alias("video_id"), F.col("vec_id").alias("scene"), px.alias("pixels"))
    return signals.screen_change(frames).select("scene", rounded(F.col("value"), 6).alias("value"))


@query("agg_19_loudness_per_second", """
SELECT vec_id AS sec, round(CASE WHEN rms > 0 THEN greatest(-90.0::DOUBLE, 20 * log10(rms)) ELSE -90.0::DOUBLE END
  + 1e-9, 6) AS rms_db
FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: pow(trunc(x::DOUBLE * 20000) / 32768, 2))) / 64)
  AS rms FROM embeddings)""")
def loudness_per_second(spark, path):
    pcm = v.table(spark, path, "embeddings").select(F.col("vec_id").alias("sec"), F.transform(
        "embedding", lambda x: (x.cast("double") * 20000).cast("smallint")).alias("samples"))
    return signals.loudness(pcm).select("sec", rounded(F.col("rms_db"), 6).alias("rms_db"))


OLD_FUSION = """old_windows AS (
  SELECT l_suppkey AS video_id, l_partkey AS start_sec, count(*) * 6 AS chat_count, avg(l_discount) * 4 AS pos,
    avg(l_tax) * 7 AS neg, avg(l_quantity) / 40 - 0.2 AS audio, max(l_extendedprice) / 60000 AS visual
  FROM lineitem GROUP BY ALL),
old_scored AS (
  SELECT *, c < 0 AS never, a < 0.3 AND c > 0.5 AS low FROM (
    SELECT *, least(1.0::DOUBLE, ln(1 + chat_count) / ln(21)) * (pos + neg) AS c,
      least(1.0::DOUBLE, greatest(0.0::DOUBLE, audio)) AS a, least(1.0::DOUBLE, greatest(0.0::DOUBLE, visual)) AS vis
    FROM old_windows)),
old_fused AS (
  SELECT video_id, start_sec, low, chat_count, round(CASE WHEN low THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * c
      + CASE WHEN low THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END * a + 0.3::DOUBLE * vis + 1e-9, 4) AS fusion_score,
    round(c + 1e-9, 4) AS chat_score, round(a + 1e-9, 4) AS audio_score, round(vis + 1e-9, 4) AS visual_score
  FROM old_scored)"""


def _old_fusion(spark, path):
    w = v.table(spark, path, "lineitem").groupBy(
        F.col("l_suppkey").alias("video_id"), F.col("l_partkey").alias("start_sec")).agg(
        (F.count("*") * 6).alias("chat_count"), (F.avg("l_discount") * 4).alias("positive_density"),
        (F.avg("l_tax") * 7).alias("negative_density"), (F.avg("l_quantity") / 40 - 0.2).alias("audio_energy"),
        (F.max("l_extendedprice") / 60000).alias("visual_change"))
    return signals.weighted_scores(w)


@query("agg_20_weighted_fusion", with_sql(OLD_FUSION, select="""
SELECT video_id, start_sec, chat_count, low AS is_low_energy_high_emotion, fusion_score, chat_score, audio_score,
  visual_score FROM old_fused"""))
def weighted_fusion(spark, path):
    return _old_fusion(spark, path)


@query("agg_21_weighted_candidates", with_sql(OLD_FUSION, """old_judged AS (
  SELECT *, avg(fusion_score) OVER w AS mean, stddev_pop(fusion_score) OVER w AS sd FROM old_fused
  WINDOW w AS (PARTITION BY video_id))""", select="""
SELECT video_id, round(mean + 1e-9, 4) AS mean_score, round(sd + 1e-9, 4) AS std_score,
  round(mean + 1.0::DOUBLE * sd * 0.5::DOUBLE + 1e-9, 4) AS adaptive_threshold, count(*) AS total_windows,
  count_if(round(fusion_score, 9) >= round(mean + 1.0::DOUBLE * sd * 0.5::DOUBLE, 9) OR low) AS candidate_count
FROM old_judged GROUP BY video_id, mean, sd"""))
def weighted_candidates(spark, path):
    return signals.weighted_summary(signals.weighted_candidates(_old_fusion(spark, path)))
