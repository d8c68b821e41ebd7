"""Queries on candidate intervals and the final selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdpeak.checks import views as v
from crowdpeak.checks.registry import query
from crowdpeak.checks.views import CHATS, GRID, SPEECH, STATS, WINDOWS, with_sql
from crowdpeak.checks.windows import FUSION_PARTS, LINE_WINDOWS, fused, rank_sql
from crowdpeak.functions.emotion import speech_emotion
from crowdpeak.functions.numbers import rounded
from crowdpeak.operators import candidates as cand
from crowdpeak.operators import buckets, grid, selection
from crowdpeak.plans import analysis
from crowdpeak.settings import Settings

CANDIDATES = """candidates AS (
  SELECT video_id, k, start_sec AS start_time, end_sec AS end_time, end_sec - start_sec AS duration,
    round(chat_score + 1e-9, 2) AS window_score, round(avg_joy + 1e-9, 2) AS avg_joy, chat_count
  FROM windows JOIN stats USING (video_id)
  WHERE chat_count > 0 AND round(chat_score + 1e-9, 2) >= calculated_threshold)"""
ISLANDS = """marked AS (
  SELECT *, CASE WHEN start_time <= max(end_time) OVER (PARTITION BY video_id ORDER BY start_time
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM candidates),
numbered AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY video_id ORDER BY start_time) AS BIGINT) AS island FROM marked),
merged AS (
  SELECT video_id, island, min(start_time) AS start_time, max(end_time) AS end_time,
    max(end_time) - min(start_time) AS duration, max(window_score) AS window_score,
    arg_min(avg_joy, start_time) AS avg_joy, CAST(sum(chat_count) AS BIGINT) AS chat_count
  FROM numbered GROUP BY video_id, island)"""
SPANS = """spans AS (
  SELECT m.video_id, m.island, j, m.start_time + 5 * j AS s, m.start_time + 5 * j + 90 AS e, m.duration AS whole,
    sum(CAST(round(w.window_score * 100) AS BIGINT)) / count(*) AS mean_cents, max(w.window_score) AS window_score,
    arg_min(w.avg_joy, w.start_time) AS avg_joy, CAST(sum(w.chat_count) AS BIGINT) AS chat_count
  FROM merged m JOIN range(0, 2000) r(j) ON m.duration > 90 AND m.start_time + 5 * j + 90 <= m.end_time + 1e-9
    JOIN candidates w ON w.video_id = m.video_id AND w.start_time >= m.start_time + 5 * j
      AND w.end_time <= m.start_time + 5 * j + 90
  GROUP BY ALL),
first_spans AS (
  SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY video_id, island ORDER BY mean_cents DESC, s) = 1),
second_spans AS (
  SELECT p.* FROM spans p JOIN first_spans f ON f.video_id = p.video_id AND f.island = p.island
  WHERE p.whole >= 210 AND (p.e <= f.s - 30 + 1e-9 OR p.s >= f.e + 30 - 1e-9)
  QUALIFY row_number() OVER (PARTITION BY p.video_id, p.island ORDER BY p.mean_cents DESC, p.s) = 1),
capped AS (
  SELECT video_id, island, start_time, end_time, duration, window_score, avg_joy, chat_count,
    NULL::DOUBLE AS original_duration, NULL::BOOLEAN AS second_span, 0 AS span_no
  FROM merged m WHERE NOT EXISTS (SELECT 1 FROM first_spans f WHERE f.video_id = m.video_id AND f.island = m.island)
  UNION ALL
  SELECT video_id, island, s, e, 90.0::DOUBLE, window_score, avg_joy, chat_count, whole, NULL, 0 FROM first_spans
  UNION ALL
  SELECT video_id, island, s, e, 90.0::DOUBLE, window_score, avg_joy, chat_count, whole, TRUE, 1 FROM second_spans),
stage_1 AS (
  SELECT * FROM capped
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY window_score DESC, island, span_no) <= 20)"""
STAGE_1 = (CHATS, STATS, GRID, WINDOWS, CANDIDATES, ISLANDS, SPANS)
SCORED = """heard AS (
  SELECT * FROM stage_1
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY window_score DESC, start_time) <= 12),
scored AS (
  SELECT h.video_id, h.start_time, h.end_time, h.duration, h.window_score AS stage1_chat_score,
    coalesce(s.streamer_speech_text, '(음성 발화 없음)') AS streamer_speech_text,
    coalesce(s.streamer_speech_emotion, '평상') AS streamer_speech_emotion,
    coalesce(s.streamer_joy_score, 0.0::DOUBLE) AS streamer_joy_score,
    round(h.window_score * 0.7::DOUBLE + coalesce(s.streamer_joy_score, 0.0::DOUBLE) * 0.3::DOUBLE + 1e-9, 2)
      AS final_highlight_score
  FROM heard h LEFT JOIN speech s ON s.video_id = h.video_id AND s.start_time = h.start_time)"""
BUDGET = """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY final_highlight_score DESC, start_time) AS pos FROM scored),
walk AS (
  SELECT video_id, pos, start_time, 1 AS n, duration AS seconds, TRUE AS taken FROM ordered WHERE pos = 1
  UNION ALL
  SELECT o.video_id, o.pos, o.start_time,
    CASE WHEN w.n < 10 AND w.seconds + o.duration <= 900 THEN w.n + 1 ELSE w.n END,
    CASE WHEN w.n < 10 AND w.seconds + o.duration <= 900 THEN w.seconds + o.duration ELSE w.seconds END,
    w.n < 10 AND w.seconds + o.duration <= 900
  FROM walk w JOIN ordered o ON o.video_id = w.video_id AND o.pos = w.pos + 1),
highlights AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.video_id ORDER BY s.start_time) AS rank
  FROM scored s JOIN walk w ON w.video_id = s.video_id AND w.start_time = s.start_time AND w.taken)"""
HIGHLIGHTS = (*STAGE_1, SPEECH, SCORED, BUDGET)


def chat_windows(spark, path):
    """Windows above the chat threshold."""
    return analysis.candidate_windows(v.chats(spark, path), v.stats(spark, path))


def stage_1(spark, path):
    return analysis.first_stage(v.chats(spark, path), v.stats(spark, path))


def final_scored(spark, path):
    return selection.final_scores(selection.second_stage_input(stage_1(spark, path)), v.speech(spark, path))


def highlights(spark, path):
    return analysis.highlights(stage_1(spark, path), v.speech(spark, path), v.stats(spark, path))


@query("win_8_chat_candidates", with_sql(*STAGE_1[:5], select="""
SELECT video_id, start_time, end_time, duration, window_score, avg_joy, chat_count FROM candidates"""))
def chat_candidates(spark, path):
    return chat_windows(spark, path).select(
        "video_id", "start_time", "end_time", "duration", "window_score", "avg_joy", "chat_count")


FUSED_CANDIDATES = """candidates AS (
  SELECT video_id, k, start_sec AS start_time, end_sec AS end_time, end_sec - start_sec AS duration,
    round(fusion * 100 + 1e-9, 2) AS window_score, round(avg_joy + 1e-9, 2) AS avg_joy, chat_count,
    round(audio_rank + 1e-9, 4) AS audio_score, round(visual_score + 1e-9, 4) AS visual_score, low_energy_boost
  FROM judged WHERE round(fusion, 9) >= round(fusion_threshold, 9))"""


@query("win_9_fusion_candidates", with_sql(*FUSION_PARTS, FUSED_CANDIDATES, select="""
SELECT * EXCLUDE (k) FROM candidates"""))
def fusion_candidates(spark, path):
    return cand.fusion_candidates(fused(spark, path)).drop("k")


@query("win_10_merge_intervals", with_sql(*STAGE_1[:6], select="""
SELECT video_id, start_time, end_time, duration, window_score, avg_joy, chat_count FROM merged"""))
def merge_intervals(spark, path):
    return cand.merge_intervals(chat_windows(spark, path)).select(
        "video_id", "start_time", "end_time", "duration", "window_score", "avg_joy", "chat_count")


@query("win_11_cap_long_intervals", with_sql(*STAGE_1, select="""
SELECT video_id, start_time, end_time, duration FROM capped WHERE second_span IS NULL"""))
def cap_long_intervals(spark, path):
    out = cand.capped_intervals(chat_windows(spark, path), Settings(second_span=False))
    return out.select("video_id", "start_time", "end_time", "duration")


@query("win_12_second_span", with_sql(*FUSION_PARTS, FUSED_CANDIDATES, ISLANDS, SPANS, select="""
SELECT video_id, start_time, end_time, duration, original_duration FROM capped WHERE second_span"""))
def second_span(spark, path):
    out = cand.capped_intervals(cand.fusion_candidates(fused(spark, path)))
    return out.filter("second_span").select("video_id", "start_time", "end_time", "duration", "original_duration")


@query("win_13_cut_interval_fields", with_sql(*STAGE_1, select="""
SELECT video_id, start_time, end_time, window_score, avg_joy, chat_count, original_duration, second_span
FROM capped"""))
def cut_interval_fields(spark, path):
    return cand.capped_intervals(chat_windows(spark, path)).select(
        "video_id", "start_time", "end_time", "window_score", "avg_joy", "chat_count", "original_duration",
        "second_span")


@query("win_14_rank_in_time", with_sql(*STAGE_1, select="""
SELECT video_id, start_time, row_number() OVER (PARTITION BY video_id ORDER BY start_time) AS rank FROM stage_1"""))
def rank_in_time(spark, path):
    return selection.rank_in_time(stage_1(spark, path)).select("video_id", "start_time", "rank")


@query("top_1_first_stage", with_sql(*STAGE_1, select="""
SELECT video_id, start_time, end_time, duration, window_score, avg_joy, chat_count, original_duration, second_span
FROM stage_1"""))
def first_stage(spark, path):
    return stage_1(spark, path).drop("audio_score", "visual_score", "low_energy_boost")


@query("top_1_fused_first_stage", with_sql(*FUSION_PARTS, FUSED_CANDIDATES, ISLANDS, SPANS, select="""
SELECT video_id, start_time, end_time, duration, window_score, avg_joy, chat_count, original_duration, second_span
FROM stage_1"""))
def fused_first_stage(spark, path):
    signals = analysis.Signals(voice=v.voice(spark, path), screen=v.screen(spark, path))
    out = analysis.first_stage(v.chats(spark, path), v.stats(spark, path), signals)
    return out.drop("audio_score", "visual_score", "low_energy_boost")


@query("top_2_second_stage_input", with_sql(*HIGHLIGHTS, recursive=True, select="""
SELECT video_id, start_time, end_time, window_score FROM heard"""))
def second_stage_input(spark, path):
    return selection.second_stage_input(stage_1(spark, path)).select(
        "video_id", "start_time", "end_time", "window_score")


@query("top_3_final_score", with_sql(*HIGHLIGHTS, recursive=True, select="SELECT * FROM scored"))
def final_score(spark, path):
    return final_scored(spark, path)


@query("top_4_budgeted_selection", with_sql(*HIGHLIGHTS, recursive=True, select="SELECT * FROM highlights"))
def budgeted_selection(spark, path):
    return highlights(spark, path)


@query("top_5_length_budget", with_sql(CHATS, select="""
SELECT video_id, duration_sec, CASE WHEN duration_sec > 0 THEN least(900.0::DOUBLE, duration_sec * 0.4::DOUBLE)
  ELSE 900.0::DOUBLE END AS budget_sec
FROM (SELECT video_id, round(max(t) * (CAST(right(video_id, 2) AS INTEGER) / 20.0::DOUBLE), 2) AS duration_sec
  FROM chats GROUP BY video_id)"""))
def length_budget(spark, path):
    last = v.chats(spark, path).groupBy("video_id").agg(F.max("t").alias("last"))
    out = last.select("video_id", F.round(
        F.col("last") * (F.substring("video_id", 9, 2).cast("int") / 20.0), 2).alias("duration_sec"))
    return out.withColumn("budget_sec", selection.length_budget(F.col("duration_sec")))


@query("top_6_empty_reason", with_sql(*HIGHLIGHTS, """all_videos AS (
  SELECT video_id, total_chats FROM stats UNION ALL SELECT 'conv-' || conv_id, count(*) FROM conversations GROUP BY conv_id
  UNION ALL SELECT DISTINCT 'order-' || o_orderpriority, 0 FROM orders)""", recursive=True, select="""
SELECT a.video_id, coalesce(n, 0) AS total_candidates, coalesce(c, 0) AS total_highlights_count,
  round(coalesce(sec, 0) + 1e-9, 2) AS total_highlight_duration_sec, CASE WHEN n IS NOT NULL THEN 10 END AS top_k_limit,
  CASE WHEN n IS NOT NULL THEN 900.0::DOUBLE END AS max_duration_cap_sec,
  CASE WHEN n IS NULL THEN CASE WHEN a.total_chats = 0 THEN 'no_chats' ELSE 'no_candidates' END END
    AS empty_reason
FROM all_videos a
  LEFT JOIN (SELECT video_id, count(*) AS n FROM stage_1 GROUP BY ALL) USING (video_id)
  LEFT JOIN (SELECT video_id, count(*) AS c, sum(duration) AS sec FROM highlights GROUP BY ALL) USING (video_id)"""))
def empty_reason(spark, path):
    # Order priorities are recordings without chat; conversations have chat and no candidate.
    stats = v.stats(spark, path).select("video_id", "total_chats").unionByName(v.table(spark, path, "conversations").groupBy(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("video_id")).agg(F.count("*").alias("total_chats")))
    silent = v.table(spark, path, "orders").select(
        F.concat(F.lit("order-"), "o_orderpriority").alias("video_id")).distinct()
    return selection.result_metadata(stats.select("video_id").union(silent), stats, stage_1(spark, path), highlights(spark, path))


def _with_lines(sql: str) -> str:
    """The fusion of FUSION with chat lines: their ranks join those of joy."""
    for old, new in (
            ("SELECT w.*, audio_level", "SELECT w.*, chat_freq, chat_conc, audio_level"),
            ("JOIN screened s ON", "JOIN line_w l ON l.video_id = w.video_id AND l.k = w.k\n    JOIN screened s ON"),
            ("AS tempo_rank\n", f"AS tempo_rank,\n    coalesce({rank_sql('chat_conc', True)}, 0.5::DOUBLE) AS conc_rank, {rank_sql('chat_freq')} AS freq_rank\n"),
            ("AS voice_mix FROM", "AS voice_mix, 0.9::DOUBLE * joy_rank + 0.05::DOUBLE * conc_rank + 0.05::DOUBLE * freq_rank AS chat_mix FROM"),
            ("AS audio_rank FROM", f"AS audio_rank, {rank_sql('chat_mix')} AS chat_rank FROM"),
            ("0.05::DOUBLE) * joy_rank + 0.3", "0.05::DOUBLE) * chat_rank + 0.3"), ("0.05::DOUBLE) * joy_rank + 0.15", "0.05::DOUBLE) * chat_rank + 0.15")):
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


FULL_ANALYSIS = (*FUSION_PARTS[:-1], v.CHAT_SCENES, "scene_grid AS (SELECT * FROM grid)", v.NEW_LINES, LINE_WINDOWS, _with_lines(FUSION_PARTS[-1]),
                 FUSED_CANDIDATES, ISLANDS, SPANS, v.RAW_SPEECH, SCORED, BUDGET)


@query("plan_full_analysis", with_sql(*FULL_ANALYSIS, recursive=True, select="SELECT * FROM highlights"))
def full_analysis(spark, path):
    """All signals and the speech of the best candidates, to ranked highlights."""
    chats, stats = v.chats(spark, path), v.stats(spark, path)
    signals = analysis.Signals(voice=v.voice(spark, path), screen=v.screen(spark, path), scenes=v.chat_scenes(spark, path))
    found = analysis.first_stage(chats, stats, signals)
    speech = speech_emotion(v.raw_speech(spark, path)).drop("text", "probs")
    return analysis.highlights(found, speech, stats)


@query("join_4_windows_inside", with_sql(*STAGE_1, select="""
SELECT s.video_id, s.start_time, s.end_time, count(*) AS n_windows, round(max(w.chat_score) + 1e-9, 6) AS best
FROM stage_1 s JOIN windows w ON w.video_id = s.video_id AND w.start_sec >= s.start_time AND w.end_sec <= s.end_time
GROUP BY ALL"""))
def windows_inside(spark, path):
    windows = grid.chat_scores(v.chats(spark, path), grid.window_grid(v.stats(spark, path)))
    inside = buckets.windows_inside(windows, stage_1(spark, path))
    return inside.groupBy("video_id", "start_time", "end_time").agg(
        F.count("*").alias("n_windows"), rounded(F.max("chat_score"), 6).alias("best"))
