"""From windows above the threshold to candidate intervals: filter, merge, cut to length, keep the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdpeak.functions.numbers import comparable, rounded
from crowdpeak.settings import Settings

DEFAULT = Settings()

FIELDS = ["video_id", "start_time", "end_time", "duration", "window_score", "avg_joy", "chat_count", "audio_score",
          "visual_score", "low_energy_boost"]


def chat_candidates(windows: DataFrame) -> DataFrame:
    """Windows with chats whose rounded chat score reaches the `calculated_threshold` of their recording."""
    return (
        windows.filter("chat_count > 0").withColumn("window_score", rounded(F.col("chat_score")))
        .filter(F.col("window_score") >= F.col("calculated_threshold"))
        .select("video_id", "k", rounded(F.col("start_sec")).alias("start_time"),
                rounded(F.col("end_sec")).alias("end_time"),
                rounded(F.col("end_sec") - F.col("start_sec")).alias("duration"), "window_score",
                rounded(F.col("avg_joy")).alias("avg_joy"), "chat_count",
                F.lit(None).cast("double").alias("audio_score"), F.lit(None).cast("double").alias("visual_score"),
                F.lit(None).cast("boolean").alias("low_energy_boost"))
    )


def fusion_candidates(windows: DataFrame) -> DataFrame:
    """Windows whose fusion reaches the threshold of their recording, scored 0-100.

    A recording without sound is judged by its chat, as in `chat_candidates`; it has none of the fusion fields.
    """
    heard = F.col("has_audio")
    screen = heard & F.col("has_screen") if "has_screen" in windows.columns else F.lit(False)
    visual = F.col("visual_score") if "visual_score" in windows.columns else F.lit(None).cast("double")
    chat = rounded(F.col("chat_score"))
    passes = F.when(heard, comparable(F.col("fusion")) >= comparable(F.col("fusion_threshold"))).otherwise(
        (F.col("chat_count") > 0) & (chat >= F.col("calculated_threshold")))
    return (
        windows.filter(passes)
        .select("video_id", "k", rounded(F.col("start_sec")).alias("start_time"),
                rounded(F.col("end_sec")).alias("end_time"),
                rounded(F.col("end_sec") - F.col("start_sec")).alias("duration"),
                F.when(heard, rounded(F.col("fusion") * 100)).otherwise(chat).alias("window_score"),
                rounded(F.col("avg_joy")).alias("avg_joy"), "chat_count",
                F.when(heard, rounded(F.col("audio_rank"), 4)).alias("audio_score"),
                F.when(screen, rounded(visual, 4)).alias("visual_score"),
                F.when(heard, F.col("low_energy_boost")).alias("low_energy_boost"))
    )


def with_islands(candidates: DataFrame) -> DataFrame:
    """Number the groups of overlapping or touching windows and add the bounds of the group to each window."""
    ordered = Window.partitionBy("video_id").orderBy("start_time")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.when(F.col("start_time") <= F.max("end_time").over(before), 0).otherwise(1)
    group = Window.partitionBy("video_id", "island")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    # Starts only grow, so the start of the group is the last one that opened a group.
    opened = F.when(F.col("_starts") == 1, F.col("start_time"))
    return (
        candidates.withColumn("_starts", starts)
        .select("*", F.sum("_starts").over(upto).alias("island"), F.max(opened).over(upto).alias("island_start"))
        .withColumn("island_end", F.max("end_time").over(group))
        .drop("_starts")
    )


def _summary() -> list[Column]:
    """Fields of several windows taken together. Joy and audio are those of the first window; the count adds up."""
    return [
        F.max("window_score").alias("window_score"),
        F.min_by("avg_joy", "start_time").alias("avg_joy"),
        F.sum("chat_count").alias("chat_count"),
        F.min_by("audio_score", "start_time").alias("audio_score"),
        F.max("visual_score").alias("visual_score"),
        F.bool_or("low_energy_boost").alias("low_energy_boost"),
    ]


def merge_intervals(candidates: DataFrame) -> DataFrame:
    """One row per group of overlapping windows."""
    return (
        with_islands(candidates)
        .groupBy("video_id", "island", F.col("island_start").alias("start_time"),
                 F.col("island_end").alias("end_time"))
        .agg(rounded(F.first("island_end") - F.first("island_start")).alias("duration"), *_summary())
    )


def capped_intervals(candidates: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Merge, then cut every interval that is too long to its best span, and keep a second span of very long ones.

    A window lies in a known, small range of span positions, so each window is given to its spans directly: spans are
    scored by one aggregation, without joining intervals to windows.
    """
    cap, step = s.clip_max_sec, s.step_sec
    long = F.col("island_end") - F.col("island_start") > cap
    # Span j starts at island_start + j * step. It holds the window if the window starts and ends inside it.
    lowest = F.greatest(F.lit(0), F.ceil((F.col("end_time") - cap - F.col("island_start")) / step))
    highest = F.least(F.floor((F.col("start_time") - F.col("island_start")) / step),
                      F.floor((F.col("island_end") - cap - F.col("island_start")) / step + F.lit(1e-9)))
    whole = F.array(F.lit(-1).cast("long"))
    positions = F.when(long & (lowest <= highest),
                       F.concat(whole, F.sequence(lowest.cast("long"), highest.cast("long")))).otherwise(whole)
    spans = (
        with_islands(candidates).withColumn("span", F.explode(positions))
        .groupBy("video_id", "island", "island_start", "island_end", "span")
        .agg((F.sum(F.round(F.col("window_score") * 100).cast("long")) / F.count("*")).alias("mean_cents"), *_summary())
    )
    island = Window.partitionBy("video_id", "island")
    best_first = island.orderBy((F.col("span") < 0), F.col("mean_cents").desc(), "span")
    chosen = spans.select("*", F.row_number().over(best_first).alias("_order"),
                          F.first("span").over(best_first).alias("_first"))
    apart = int(-(-(cap + s.second_span_gap_sec) // step))
    far = F.abs(F.col("span") - F.col("_first")) >= apart
    second_ok = (
        F.lit(s.second_span) & (F.col("_first") >= 0) & (F.col("span") >= 0) & far
        & (F.col("island_end") - F.col("island_start") >= s.second_span_from_sec)
    )
    again = island.orderBy(F.col("_second_ok").desc(), F.col("mean_cents").desc(), "span")
    kept = (
        chosen.withColumn("_second_ok", second_ok)
        .withColumn("_again", F.row_number().over(again))
        .filter((F.col("_order") == 1) | (F.col("_second_ok") & (F.col("_again") == 1)))
        .withColumn("second_span", F.when(F.col("_order") != 1, F.lit(True)))
    )
    cut = F.col("span") >= 0
    start = F.when(cut, F.col("island_start") + F.col("span") * step).otherwise(F.col("island_start"))
    end = F.when(cut, start + cap).otherwise(F.col("island_end"))
    return kept.select(
        "video_id", "island", rounded(start).alias("start_time"), rounded(end).alias("end_time"),
        rounded(end - start).alias("duration"), "window_score", "avg_joy", "chat_count", "audio_score",
        "visual_score", "low_energy_boost",
        F.when(cut, rounded(F.col("island_end") - F.col("island_start"))).alias("original_duration"), "second_span")


def top_candidates(intervals: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The best intervals of each recording. Ties go to the earlier group, and to a first span before a second."""
    second = F.coalesce(F.col("second_span"), F.lit(False)) if "second_span" in intervals.columns else F.lit(False)
    best = Window.partitionBy("video_id").orderBy(F.col("window_score").desc(), "island", second)
    return (
        intervals.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= s.first_stage_limit)
        .drop("_n", "island")
    )


def first_stage(candidates: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Candidate windows to candidate intervals. A cap of zero or less means no cap."""
    if s.clip_max_sec > 0:
        return top_candidates(capped_intervals(candidates, s), s)
    merged = merge_intervals(candidates).withColumn("original_duration", F.lit(None).cast("double")).withColumn(
        "second_span", F.lit(None).cast("boolean"))
    return top_candidates(merged, s)
