"""Second stage: which candidates are heard, how they are scored, and which fit the length budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdpeak import fixed_values as fv
from crowdpeak.functions.numbers import rounded
from crowdpeak.settings import Settings

DEFAULT = Settings()


def second_stage_input(candidates: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The best candidates of each recording by score, then start; all of them if the limit is not positive."""
    if s.second_stage_limit <= 0:
        return candidates
    best = Window.partitionBy("video_id").orderBy(F.col("window_score").desc(), "start_time")
    return candidates.withColumn("_n", F.row_number().over(best)).filter(
        F.col("_n") <= s.second_stage_limit).drop("_n")


def final_scores(candidates: DataFrame, speech: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Mix first-stage score and speech joy.

    `speech(video_id, start_time, streamer_speech_text, streamer_speech_emotion, streamer_joy_score)` has one row per
    candidate that was transcribed; a candidate without a row counts as silent.
    """
    joined = candidates.join(speech, ["video_id", "start_time"], "left")
    joy = F.coalesce("streamer_joy_score", F.lit(0.0))
    return joined.select(
        "video_id", "start_time", "end_time", "duration", F.col("window_score").alias("stage1_chat_score"),
        F.coalesce("streamer_speech_text", F.lit(fv.NO_SPEECH_TEXT)).alias("streamer_speech_text"),
        F.coalesce("streamer_speech_emotion", F.lit(fv.NEUTRAL)).alias("streamer_speech_emotion"),
        joy.alias("streamer_joy_score"),
        rounded(F.col("window_score") * s.final_stage1_weight + joy * s.final_speech_weight).alias(
            "final_highlight_score"))


def length_budget(duration: Column, s: Settings = DEFAULT) -> Column:
    """Seconds all highlights may have together: a fixed cap, and a share of the recording if its length is known."""
    cap = F.lit(s.final_budget_sec)
    if s.final_budget_ratio <= 0:
        return cap
    return F.when(duration > 0, F.least(cap, duration * s.final_budget_ratio)).otherwise(cap)


def select_highlights(scored: DataFrame, videos: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Greedy choice by final score under the budget; a clip that does not fit is skipped and the next one is tried.

    The first clip is always taken. A recording brings at most `second_stage_limit` candidates, so its choice is a
    fold over one short array.
    """
    fields = [c for c in scored.columns if c != "video_id"]
    clip = F.struct((-F.col("final_highlight_score")).alias("_key"), F.col("start_time").alias("_tie"),
                    F.struct(*fields).alias("clip"))
    per_video = scored.groupBy("video_id").agg(F.array_sort(F.collect_list(clip)).alias("_clips")).join(
        videos.select("video_id", "duration_sec"), "video_id", "left")
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("seconds"),
                     F.filter(F.transform("_clips", lambda c: c["clip"]), lambda c: F.lit(False)).alias("kept"))

    def step(acc: Column, c: Column) -> Column:
        seconds = acc["seconds"] + c["clip"]["duration"]
        taken = (acc["n"] < s.final_limit) & ((seconds <= F.col("_budget")) | (acc["n"] == 0))
        return F.when(taken, F.struct(
            (acc["n"] + 1).alias("n"), seconds.alias("seconds"),
            F.concat(acc["kept"], F.array(c["clip"])).alias("kept"))).otherwise(acc)

    chosen = per_video.withColumn("_budget", length_budget(F.col("duration_sec"), s)).select(
        "video_id", F.aggregate("_clips", start, step)["kept"].alias("_kept"))
    by_time = F.array_sort(F.transform("_kept", lambda c: F.struct(c["start_time"].alias("at"), c.alias("clip"))))
    return chosen.select("video_id", F.posexplode(by_time).alias("_pos", "_c")).select(
        "video_id", "_c.clip.*", (F.col("_pos") + 1).alias("rank"))


def rank_in_time(clips: DataFrame) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("start_time")
    return clips.withColumn("rank", F.row_number().over(w))


def result_metadata(videos: DataFrame, stats: DataFrame, candidates: DataFrame, highlights: DataFrame,
                    s: Settings = DEFAULT) -> DataFrame:
    """One row per recording: counts, total length, and why there is no highlight if there is none."""
    n_candidates = candidates.groupBy("video_id").agg(F.count("*").alias("_candidates"))
    totals = highlights.groupBy("video_id").agg(
        F.count("*").alias("_count"), F.sum("duration").alias("_seconds"))
    has_any = F.col("_candidates").isNotNull()
    return (
        videos.select("video_id").join(stats.select("video_id", "total_chats"), "video_id", "left")
        .join(n_candidates, "video_id", "left").join(totals, "video_id", "left")
        .select(
            "video_id",
            F.when(has_any, F.lit(s.final_limit)).alias("top_k_limit"),
            F.when(has_any, F.lit(s.final_budget_sec)).alias("max_duration_cap_sec"),
            F.coalesce("_candidates", F.lit(0)).alias("total_candidates"),
            F.coalesce("_count", F.lit(0)).alias("total_highlights_count"),
            rounded(F.coalesce("_seconds", F.lit(0.0))).alias("total_highlight_duration_sec"),
            F.when(~has_any, F.when(F.coalesce("total_chats", F.lit(0)) == 0, F.lit("no_chats"))
                   .otherwise(F.lit("no_candidates"))).alias("empty_reason"))
    )
