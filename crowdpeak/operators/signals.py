"""Signals from frames and sound samples, and the simple weighted fusion of window totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdpeak import fixed_values as fv
from crowdpeak.functions.numbers import clamp, decibels, rounded
from crowdpeak.operators.buckets import with_previous


def sampled_frames(frames: DataFrame, fps: Column, every_sec: float = 5.0) -> DataFrame:
    """Frames at a fixed spacing, with their time. `frames(video_id, frame)`."""
    interval = F.greatest(F.lit(1).cast("long"), F.floor(fps * every_sec).cast("long"))
    return frames.filter(F.col("frame") % interval == 0).withColumn("t", rounded(F.col("frame") / fps))


def masked(pixels: Column, width: int, height: int, box: tuple[float, float, float, float] | None) -> Column:
    """Row-major grey pixels with the region `(ymin, xmin, ymax, xmax)`, given as shares, set to zero."""
    if box is None:
        return pixels
    ymin, xmin, ymax, xmax = box
    top, bottom = int(ymin * height), int(round(ymax * height))
    left, right = int(xmin * width), int(round(xmax * width))

    def keep(value: Column, i: Column) -> Column:
        y, x = F.floor(i / width), i % width
        return F.when((y >= top) & (y < bottom) & (x >= left) & (x < right), F.lit(0).cast("double")).otherwise(
            value.cast("double"))

    return F.transform(pixels, keep)


def screen_change(frames: DataFrame, order: str = "scene", max_gap: float = 1.0,
                  bucket: float = 120.0) -> DataFrame:
    """Mean absolute pixel difference of each frame to the one before; the first frame has none.

    `frames(video_id, scene, pixels)`. Frames are compared inside buckets of scenes, not inside whole recordings.
    """
    paired = with_previous(frames, order, {"_before": "pixels"}, max_gap, bucket=bucket)
    difference = F.aggregate(
        F.zip_with("pixels", "_before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))),
        F.lit(0.0), lambda acc, x: acc + x) / F.size("pixels")
    return paired.filter(F.col("_before").isNotNull()).withColumn("value", difference).drop("pixels", "_before")


def loudness(pcm: DataFrame, samples: str = "samples", full_scale: float = 32768.0) -> DataFrame:
    """Loudness in dB of each second of 16-bit samples; silence and anything quieter is -90."""
    squares = F.aggregate(
        F.transform(F.col(samples), lambda x: (x.cast("double") / full_scale) * (x.cast("double") / full_scale)),
        F.lit(0.0), lambda acc, x: acc + x)
    return pcm.withColumn("rms_db", decibels(F.sqrt(squares / F.size(samples)))).drop(samples)


def weighted_scores(windows: DataFrame, weights: tuple[float, float, float] = fv.WEIGHTS) -> DataFrame:
    """Fusion of chat density, sound and screen in `windows(chat_count, positive_density, negative_density,
    audio_energy, visual_change)`; a quiet window with intense chat shifts weight from sound to chat."""
    fill = F.least(F.lit(1.0), F.log1p(F.col("chat_count").cast("double")) / F.log1p(F.lit(fv.FULL_CHAT)))
    chat_score = fill * (F.col("positive_density") + F.col("negative_density"))
    scored = (
        windows.withColumn("_chat", chat_score)
        .withColumn("_audio", clamp(F.col("audio_energy"))).withColumn("_visual", clamp(F.col("visual_change")))
        .withColumn("is_low_energy_high_emotion", (F.col("_audio") < fv.QUIET_BELOW) & (F.col("_chat") > fv.INTENSE_ABOVE))
    )
    shifted = F.col("is_low_energy_high_emotion")
    shares = [F.when(shifted, quiet).otherwise(usual) for usual, quiet in zip(weights, fv.QUIET_WEIGHTS)]
    fusion = shares[0] * F.col("_chat") + shares[1] * F.col("_audio") + shares[2] * F.col("_visual")
    return (
        scored.withColumn("fusion_score", rounded(fusion, 4)).withColumn("chat_score", rounded(F.col("_chat"), 4))
        .withColumn("audio_score", rounded(F.col("_audio"), 4))
        .withColumn("visual_score", rounded(F.col("_visual"), 4))
        .drop("_chat", "_audio", "_visual", "positive_density", "negative_density", "audio_energy", "visual_change")
    )


def weighted_candidates(scored: DataFrame, sensitivity: float = 1.0) -> DataFrame:
    """Add mean, deviation and threshold of the recording and whether the window is a candidate."""
    w = Window.partitionBy("video_id")
    mean, std = F.avg("fusion_score").over(w), F.stddev_pop("fusion_score").over(w)
    threshold = mean + F.lit(sensitivity) * std * 0.5
    return (
        scored.withColumn("mean_score", rounded(mean, 4)).withColumn("std_score", rounded(std, 4))
        .withColumn("_threshold", threshold).withColumn("adaptive_threshold", rounded(threshold, 4))
        .withColumn("is_candidate", (F.round("fusion_score", 9) >= F.round("_threshold", 9))
                    | F.col("is_low_energy_high_emotion"))
        .drop("_threshold")
    )


def weighted_summary(judged: DataFrame) -> DataFrame:
    return judged.groupBy("video_id", "mean_score", "std_score", "adaptive_threshold").agg(
        F.count("*").alias("total_windows"), F.count_if("is_candidate").alias("candidate_count"))
