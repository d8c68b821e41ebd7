"""Queries on the window grid, its signals, and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdpeak.checks import views as v
from crowdpeak.checks.registry import query
from crowdpeak.checks.views import CHATS, GRID, SCREEN, STATS, VOICE, WINDOWS, with_sql
from crowdpeak.functions.numbers import rounded
from crowdpeak.operators import grid, lines, ranks


def _grid(spark, path):
    return grid.window_grid(v.stats(spark, path))


def _windows(spark, path):
    return grid.chat_scores(v.chats(spark, path), _grid(spark, path))


@query("agg_1_adaptive_threshold", with_sql(CHATS, STATS, select="""
SELECT video_id, total_chats, mean_joy, std_joy, calculated_threshold FROM stats"""))
def adaptive_threshold(spark, path):
    return grid.video_stats(v.chats(spark, path)).drop("duration_sec")


@query("agg_2_duration", """
WITH media AS (
  SELECT l_suppkey AS video_id, CAST(l_suppkey % 4 AS DOUBLE) * 10 AS fps, CAST(count(*) * 7 AS BIGINT) AS frames
  FROM lineitem GROUP BY ALL),
seen AS (SELECT o_custkey % 97 AS video_id, max(o_totalprice / 100) AS last_t FROM orders GROUP BY ALL)
SELECT m.video_id, round(coalesce(CASE WHEN fps > 0 AND frames > 0 THEN frames / fps END, last_t + 30, 65.0::DOUBLE)
  + 1e-9, 2) AS duration_sec
FROM media m LEFT JOIN seen USING (video_id)""")
def duration(spark, path):
    media = v.table(spark, path, "lineitem").groupBy(F.col("l_suppkey").alias("video_id")).agg(
        (F.count("*") * 7).alias("frames")).withColumn("fps", (F.col("video_id") % 4).cast("double") * 10)
    chat = v.table(spark, path, "orders").select(
        (F.col("o_custkey") % 97).alias("video_id"), (F.col("o_totalprice") / 100).alias("t"),
        F.lit(1.0).alias("joy_pct"))
    return grid.video_stats(chat, media).select("video_id", "duration_sec")


@query("win_1_grid", with_sql(CHATS, STATS, GRID, select="SELECT video_id, k, start_sec, end_sec FROM grid"))
def window_grid(spark, path):
    return _grid(spark, path).select("video_id", "k", "start_sec", "end_sec")


@query("join_1_chats_in_windows", with_sql(CHATS, STATS, GRID, select="""
SELECT g.video_id, g.k, count(*) AS n, CAST(sum(c.event_id) AS BIGINT) AS id_sum
FROM grid g JOIN chats c ON c.video_id = g.video_id AND c.t >= g.start_sec AND c.t <= g.end_sec GROUP BY ALL"""))
def chats_in_windows(spark, path):
    sums = grid.closed_window_sums(v.chats(spark, path), "event_id")
    return sums.join(_grid(spark, path).select("video_id", "k"), ["video_id", "k"]).select(
        "video_id", "k", "n", F.col("total").alias("id_sum"))


@query("agg_3_chat_score", with_sql(CHATS, STATS, GRID, WINDOWS, select="""
SELECT video_id, k, chat_count, round(avg_joy + 1e-9, 6) AS avg_joy, round(chat_score + 1e-9, 6) AS chat_score FROM windows"""))
def chat_score(spark, path):
    return _windows(spark, path).select(
        "video_id", "k", "chat_count", rounded(F.col("avg_joy"), 6).alias("avg_joy"),
        rounded(F.col("chat_score"), 6).alias("chat_score"))


VOICE_WINDOWS = """voice_all AS (
  SELECT video_id, min(rms_db) AS quietest, median(f0_hz) AS f0_all FROM voice GROUP BY video_id),
voice_w AS (
  SELECT g.video_id, g.k, avg(rms_db) AS loud, median(f0_hz) AS f0, avg(onset) AS tempo
  FROM grid g JOIN voice v ON v.video_id = g.video_id AND v.sec >= floor(g.start_sec) AND v.sec < ceil(g.end_sec)
  GROUP BY ALL),
voiced AS (
  SELECT g.video_id, g.k, coalesce(loud, quietest) AS audio_level, 12 * log2(f0 / f0_all) AS pitch_st, tempo
  FROM grid g JOIN voice_all a USING (video_id) LEFT JOIN voice_w w ON w.video_id = g.video_id AND w.k = g.k)"""
SCREEN_WINDOWS = """screen_w AS (
  SELECT g.video_id, g.k, median(s.value) AS med
  FROM grid g LEFT JOIN screen s ON s.video_id = g.video_id AND s.t >= g.start_sec AND s.t < g.end_sec GROUP BY ALL),
screened AS (
  SELECT video_id, k, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (coalesce(med, 0) - 50) / 40.0::DOUBLE)) AS visual_score
  FROM screen_w)"""


@query("join_2_half_open_windows", with_sql(CHATS, STATS, GRID, VOICE, SCREEN, select="""
SELECT g.video_id, g.k,
  (SELECT count(*) FROM voice v WHERE v.video_id = g.video_id AND v.sec >= floor(g.start_sec)
    AND v.sec < ceil(g.end_sec)) AS seconds,
  (SELECT count(*) FROM screen s WHERE s.video_id = g.video_id AND s.t >= g.start_sec AND s.t < g.end_sec) AS samples
FROM grid g"""))
def half_open_windows(spark, path):
    seconds = grid.spread_half_open(v.voice(spark, path), "sec").groupBy("video_id", "k").agg(
        F.count("*").alias("seconds"))
    samples = grid.spread_half_open(v.screen(spark, path), "t").groupBy("video_id", "k").agg(
        F.count("*").alias("samples"))
    out = _grid(spark, path).join(seconds, ["video_id", "k"], "left").join(samples, ["video_id", "k"], "left")
    return out.select("video_id", "k", F.coalesce("seconds", F.lit(0)).alias("seconds"),
                      F.coalesce("samples", F.lit(0)).alias("samples"))


@query("agg_4_loudness", with_sql(CHATS, STATS, GRID, VOICE, VOICE_WINDOWS, select="""
SELECT video_id, k, round(audio_level + 1e-9, 6) AS audio_level FROM voiced"""))
def window_loudness(spark, path):
    return grid.voice_scores(v.voice(spark, path), _grid(spark, path)).select(
        "video_id", "k", rounded(F.col("audio_level"), 6).alias("audio_level"))


@query("agg_5_screen_median", with_sql(CHATS, STATS, GRID, SCREEN, SCREEN_WINDOWS, select="""
SELECT video_id, k, round(visual_score + 1e-9, 6) AS visual_score FROM screened"""))
def screen_median(spark, path):
    return grid.screen_scores(v.screen(spark, path), _grid(spark, path)).select(
        "video_id", "k", rounded(F.col("visual_score"), 6).alias("visual_score"))


@query("agg_6_pitch", with_sql(CHATS, STATS, GRID, VOICE, VOICE_WINDOWS, select="""
SELECT video_id, k, round(pitch_st + 1e-9, 6) AS pitch_st FROM voiced"""))
def pitch(spark, path):
    return grid.voice_scores(v.voice(spark, path), _grid(spark, path)).select(
        "video_id", "k", rounded(F.col("pitch_st"), 6).alias("pitch_st"))


@query("agg_7_tempo", with_sql(CHATS, STATS, GRID, VOICE, VOICE_WINDOWS, select="""
SELECT video_id, k, round(tempo + 1e-9, 6) AS tempo FROM voiced"""))
def tempo(spark, path):
    return grid.voice_scores(v.voice(spark, path), _grid(spark, path)).select(
        "video_id", "k", rounded(F.col("tempo"), 6).alias("tempo"))


def rank_sql(value: str, present: bool = False) -> str:
    total = f"count({value})" if present else "count(*)"
    return (f"CASE WHEN {value} IS NOT NULL THEN (rank() OVER (PARTITION BY video_id ORDER BY round({value}, 9) "
            f"NULLS LAST) + (count({value}) OVER (PARTITION BY video_id, round({value}, 9)) - 1) / 2.0::DOUBLE) "
            f"/ {total} OVER (PARTITION BY video_id) END")


# Every signal of the chat recordings, with ranks, fusion and threshold.
FUSION = f"""signals AS (
  SELECT w.*, audio_level, pitch_st, tempo, visual_score
  FROM windows w JOIN voiced v ON v.video_id = w.video_id AND v.k = w.k
    JOIN screened s ON s.video_id = w.video_id AND s.k = w.k),
ranks_1 AS (
  SELECT *, {rank_sql('chat_score')} AS joy_rank, {rank_sql('audio_level')} AS loud_rank,
    coalesce({rank_sql('pitch_st', True)}, 0.5::DOUBLE) AS pitch_rank, {rank_sql('tempo')} AS tempo_rank
  FROM signals),
ranks_2 AS (
  SELECT *, 0.8::DOUBLE * loud_rank + 0.1::DOUBLE * pitch_rank + 0.1::DOUBLE * tempo_rank AS voice_mix FROM ranks_1),
ranks_3 AS (SELECT *, {rank_sql('voice_mix')} AS audio_rank FROM ranks_2),
fused AS (
  SELECT *, round(loud_rank, 9) < 0.3 AND round(joy_rank, 9) >= 0.7 AS low_energy_boost,
    (0.7::DOUBLE - 0.05::DOUBLE) * joy_rank + 0.3::DOUBLE * audio_rank + 0.05::DOUBLE * visual_score AS plain,
    (1.0::DOUBLE - 0.15::DOUBLE - 0.05::DOUBLE) * joy_rank + 0.15::DOUBLE * audio_rank + 0.05::DOUBLE * visual_score
      AS raised
  FROM ranks_3),
fusion AS (SELECT *, CASE WHEN low_energy_boost THEN raised ELSE plain END AS fusion FROM fused),
judged AS (
  SELECT *, avg(fusion) OVER (PARTITION BY video_id) + 0.5::DOUBLE * stddev_pop(fusion) OVER (PARTITION BY video_id)
    AS fusion_threshold
  FROM fusion)"""
FUSION_PARTS = (CHATS, STATS, GRID, WINDOWS, VOICE, VOICE_WINDOWS, SCREEN, SCREEN_WINDOWS, FUSION)


def fused(spark, path):
    from crowdpeak.plans.analysis import Signals, fused_windows

    signals = Signals(voice=v.voice(spark, path), screen=v.screen(spark, path))
    return fused_windows(v.chats(spark, path), v.stats(spark, path), signals)


@query("win_2_rank_fraction", with_sql(CHATS, STATS, GRID, WINDOWS, select=f"""
SELECT video_id, k, round({rank_sql('chat_score')} + 1e-9, 6) AS joy_rank FROM windows"""))
def rank_fraction(spark, path):
    return ranks.chat_ranks(_windows(spark, path)).select(
        "video_id", "k", rounded(F.col("joy_rank"), 6).alias("joy_rank"))


@query("win_3_rank_with_missing", with_sql(CHATS, STATS, GRID, VOICE, VOICE_WINDOWS, select=f"""
SELECT video_id, k, round(coalesce({rank_sql('pitch_st', True)}, 0.5::DOUBLE) + 1e-9, 6) AS pitch_rank FROM voiced"""))
def rank_with_missing(spark, path):
    w = grid.voice_scores(v.voice(spark, path), _grid(spark, path))
    return ranks.voice_ranks(w).select("video_id", "k", rounded(F.col("pitch_rank"), 6).alias("pitch_rank"))


@query("win_5_voice_rank", with_sql(*FUSION_PARTS, select="""
SELECT video_id, k, round(tempo_rank + 1e-9, 6) AS tempo_rank, round(audio_rank + 1e-9, 6) AS audio_rank FROM judged"""))
def voice_rank(spark, path):
    w = grid.voice_scores(v.voice(spark, path), _grid(spark, path))
    return ranks.voice_ranks(w).select("video_id", "k", rounded(F.col("tempo_rank"), 6).alias("tempo_rank"),
                                       rounded(F.col("audio_rank"), 6).alias("audio_rank"))


@query("win_6_fusion", with_sql(*FUSION_PARTS, select="""
SELECT video_id, k, round(plain + 1e-9, 6) AS fusion FROM judged"""))
def fusion_without_boost(spark, path):
    from crowdpeak.plans.analysis import Signals, fused_windows
    from crowdpeak.settings import Settings

    signals = Signals(voice=v.voice(spark, path), screen=v.screen(spark, path))
    out = fused_windows(v.chats(spark, path), v.stats(spark, path), signals,
                        s=Settings(low_energy_boost=False))
    return out.select("video_id", "k", rounded(F.col("fusion"), 6).alias("fusion"))


@query("win_7_low_energy_boost", with_sql(*FUSION_PARTS, select="""
SELECT video_id, k, low_energy_boost, round(fusion + 1e-9, 6) AS fusion FROM judged"""))
def low_energy_boost(spark, path):
    return fused(spark, path).select("video_id", "k", "low_energy_boost", rounded(F.col("fusion"), 6).alias("fusion"))


@query("agg_10_fusion_threshold", with_sql(*FUSION_PARTS, select="""
SELECT DISTINCT video_id, round(fusion_threshold + 1e-9, 6) AS fusion_threshold FROM judged"""))
def fusion_threshold(spark, path):
    return fused(spark, path).groupBy("video_id").agg(
        rounded(F.first("fusion_threshold"), 6).alias("fusion_threshold"))


@query("join_12_windows_with_global_stats", with_sql(CHATS, STATS, GRID, WINDOWS, select="""
SELECT video_id, k, calculated_threshold, round(avg(avg_joy) OVER w + 1e-9, 6) AS mu, round(stddev_pop(avg_joy) OVER w + 1e-9, 6) AS sd,
  count(*) OVER w AS n
FROM windows JOIN stats USING (video_id) WINDOW w AS (PARTITION BY video_id)"""))
def windows_with_global_stats(spark, path):
    from pyspark.sql import Window

    w = Window.partitionBy("video_id")
    return _windows(spark, path).select("video_id", "k", "calculated_threshold", rounded(F.avg("avg_joy").over(w), 6).alias("mu"),
                         rounded(F.stddev_pop("avg_joy").over(w), 6).alias("sd"), F.count("*").over(w).alias("n"))


# --- chat lines -----------------------------------------------------------------------------------

LINE_WINDOWS = """grams AS (
  SELECT video_id, t, line_no, gram, count(*) AS c FROM (
    SELECT video_id, t, line_no, unnest(list_concat(
      [body[i:i + 1] FOR i IN range(1, length(body))], [body[i:i + 2] FOR i IN range(1, length(body) - 1)])) AS gram
    FROM (SELECT video_id, t, line_no, regexp_replace(lower(replace(line, ' ', '')), '\\s\\s+', ' ', 'g') AS body
      FROM new_lines))
  GROUP BY ALL),
unit AS (
  SELECT video_id, t, line_no, gram, c / sqrt(sum(c * c) OVER (PARTITION BY video_id, t, line_no)) AS w FROM grams),
members AS (
  SELECT g.video_id, g.k, n.t, n.line_no FROM scene_grid g JOIN new_lines n
    ON n.video_id = g.video_id AND n.t >= g.start_sec AND n.t <= g.end_sec),
freq AS (SELECT video_id, k, count(*) AS m FROM members GROUP BY ALL),
pair_sums AS (
  SELECT a.video_id, a.k, sum(ua.w * ub.w) AS total
  FROM members a JOIN members b ON a.video_id = b.video_id AND a.k = b.k AND (a.t, a.line_no) < (b.t, b.line_no)
    JOIN unit ua ON ua.video_id = a.video_id AND ua.t = a.t AND ua.line_no = a.line_no
    JOIN unit ub ON ub.video_id = b.video_id AND ub.t = b.t AND ub.line_no = b.line_no AND ub.gram = ua.gram
  GROUP BY ALL),
line_w AS (
  SELECT g.video_id, g.k, g.start_sec, g.end_sec, coalesce(m, 0) AS chat_freq,
    CASE WHEN m >= 3 THEN coalesce(total, 0) / (m * (m - 1) / 2.0::DOUBLE) END AS chat_conc
  FROM scene_grid g LEFT JOIN freq f ON f.video_id = g.video_id AND f.k = g.k
    LEFT JOIN pair_sums p ON p.video_id = g.video_id AND p.k = g.k)"""


def _line_windows(spark, path):
    scenes = v.scenes(spark, path)
    fresh = lines.new_lines(scenes, exact=False)
    return lines.line_scores(fresh, grid.window_grid(v.scene_stats(spark, path)), scenes)


@query("join_6_previous_scene", with_sql(v.SCENES, """pairs AS (
  SELECT *, lag(t) OVER w AS p, lag(lines) OVER w AS prev FROM scenes WINDOW w AS (PARTITION BY video_id ORDER BY t))""",
                                         select="""
SELECT video_id, t, CASE WHEN t - p <= 7.5 THEN p END AS prev_t, len(lines) AS n_lines,
  CASE WHEN t - p <= 7.5 THEN len(prev) ELSE 0 END AS n_prev FROM pairs"""))
def previous_scene(spark, path):
    return lines.previous_scene(v.scenes(spark, path)).select(
        "video_id", "t", "prev_t", F.size("lines").alias("n_lines"), F.size("prev_lines").alias("n_prev"))


@query("join_7_similar_lines", with_sql(v.SCENES, v.NEW_LINES, select="""
SELECT video_id, t, line_no, line FROM new_lines"""))
def similar_lines(spark, path):
    return lines.new_lines(v.scenes(spark, path), exact=False)


@query("join_7_block_match")
def block_match(spark, path):
    return lines.new_lines(v.scenes(spark, path), exact=True)


@query("win_15_new_lines_per_scene", with_sql(v.SCENES, v.NEW_LINES, select="""
SELECT s.video_id, s.t, len(s.lines) AS n_lines, count(n.line_no) AS n_new
FROM scenes s LEFT JOIN new_lines n ON n.video_id = s.video_id AND n.t = s.t GROUP BY s.video_id, s.t, s.lines"""))
def new_lines_per_scene(spark, path):
    scenes = v.scenes(spark, path)
    fresh = lines.new_lines(scenes, exact=False).groupBy("video_id", "t").agg(F.count("*").alias("n_new"))
    return scenes.join(fresh, ["video_id", "t"], "left").select(
        "video_id", "t", F.size("lines").alias("n_lines"), F.coalesce("n_new", F.lit(0)).alias("n_new"))


@query("agg_8_chat_frequency", with_sql(v.SCENES, v.SCENE_GRID, v.NEW_LINES, select="""
SELECT g.video_id, g.k, count(n.t) AS chat_freq FROM scene_grid g
  LEFT JOIN new_lines n ON n.video_id = g.video_id AND n.t >= g.start_sec AND n.t <= g.end_sec GROUP BY ALL"""))
def chat_frequency(spark, path):
    return _line_windows(spark, path).select("video_id", "k", "chat_freq")


@query("agg_9_chat_concentration", with_sql(v.SCENES, v.SCENE_GRID, v.NEW_LINES, LINE_WINDOWS, select="""
SELECT video_id, k, round(chat_conc + 1e-9, 6) AS chat_conc FROM line_w"""))
def chat_concentration(spark, path):
    return _line_windows(spark, path).select("video_id", "k", rounded(F.col("chat_conc"), 6).alias("chat_conc"))


LINE_CHATS = """line_chats AS (
  SELECT CAST(conv_id AS VARCHAR) AS video_id, turn * 5.0::DOUBLE AS t, (length(text) * 7 % 1000) / 10.0::DOUBLE AS joy
  FROM conversations),
line_scored AS (
  SELECT w.*, coalesce(s.score, 0.0::DOUBLE) AS chat_score FROM line_w w LEFT JOIN (
    SELECT g.video_id, g.k, avg(joy) * 0.7::DOUBLE + max(joy) * 0.3::DOUBLE AS score
    FROM scene_grid g JOIN line_chats c ON c.video_id = g.video_id AND c.t >= g.start_sec AND c.t <= g.end_sec
    GROUP BY ALL) s ON s.video_id = w.video_id AND s.k = w.k),
"""


@query("win_4_chat_rank", with_sql(v.SCENES, v.SCENE_GRID, v.NEW_LINES, LINE_WINDOWS, LINE_CHATS.rstrip(",\n"), f"""mixed AS (
  SELECT *, 0.9::DOUBLE * {rank_sql('chat_score')} + 0.05::DOUBLE * coalesce({rank_sql('chat_conc', True)}, 0.5::DOUBLE)
    + 0.05::DOUBLE * {rank_sql('chat_freq')} AS mix FROM line_scored)""", select=f"""
SELECT video_id, k, round({rank_sql('mix')} + 1e-9, 6) AS chat_rank FROM mixed"""))
def chat_rank(spark, path):
    joy = v.table(spark, path, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), (F.col("turn") * 5.0).alias("t"),
        (F.length("text") * 7 % 1000 / 10.0).alias("joy_pct"))
    scenes = v.scenes(spark, path)
    w = grid.chat_scores(joy, grid.window_grid(v.scene_stats(spark, path)))
    w = lines.line_scores(lines.new_lines(scenes, exact=False), w, scenes)
    return ranks.chat_ranks(w).select("video_id", "k", rounded(F.col("chat_rank"), 6).alias("chat_rank"))
