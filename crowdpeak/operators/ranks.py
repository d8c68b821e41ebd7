"""Rank fractions of window signals inside a recording, and their fusion.

All windows of one recording are ranked together. Their number is length / step (17 280 for 24 hours), whatever the
number of chats, so partitioning these operators by `video_id` is bounded. Every step keeps that partitioning: the
whole chain needs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdpeak.functions.numbers import comparable
from crowdpeak.settings import Settings

DEFAULT = Settings()


def _video():
    return Window.partitionBy("video_id")



def rank_fraction(value: Column, among_present: bool = False) -> Column:
    """Average rank of equal values, divided by the number of windows (or of windows that have a value).

    The largest value gets 1; a missing value gets null.
    """
    v = comparable(value)
    ordered = _video().orderBy(v.asc_nulls_last())
    ties = F.count(v).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    total = F.count(v).over(_video()) if among_present else F.count(F.lit(1)).over(_video())
    return F.when(value.isNotNull(), (F.rank().over(ordered) + (ties - 1) / F.lit(2.0)) / total)


def chat_ranks(windows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """`joy_rank` from the chat score; `chat_rank` mixes in concentration and frequency where lines are known."""
    ranked = windows.withColumn("joy_rank", rank_fraction(F.col("chat_score")))
    if "chat_freq" not in windows.columns:
        return ranked.withColumn("chat_rank", F.col("joy_rank"))
    mixed = (
        ranked.withColumn("conc_rank", F.coalesce(rank_fraction(F.col("chat_conc"), True), F.lit(s.missing_rank)))
        .withColumn("freq_rank", rank_fraction(F.col("chat_freq").cast("double")))
        .withColumn("_mix", s.chat_joy * F.col("joy_rank") + s.chat_concentration * F.col("conc_rank")
                    + s.chat_frequency * F.col("freq_rank"))
    )
    return mixed.withColumn(
        "chat_rank", F.when(F.col("has_lines"), rank_fraction(F.col("_mix"))).otherwise(F.col("joy_rank"))
    ).drop("_mix")


def voice_ranks(windows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """`loud_rank` from loudness; `audio_rank` mixes in pitch and tempo where they are known.

    A window without tempo has no mixed rank and can therefore not become a candidate.
    """
    ranked = windows.withColumn("loud_rank", rank_fraction(F.col("audio_level")))
    if "tempo" not in windows.columns:
        return ranked.withColumn("audio_rank", F.col("loud_rank"))
    mixed = (
        ranked.withColumn("pitch_rank", F.coalesce(rank_fraction(F.col("pitch_st"), True), F.lit(s.missing_rank)))
        .withColumn("tempo_rank", rank_fraction(F.col("tempo")))
        .withColumn("_mix", s.voice_loud * F.col("loud_rank") + s.voice_pitch * F.col("pitch_rank")
                    + s.voice_tempo * F.col("tempo_rank"))
    )
    return mixed.withColumn(
        "audio_rank", F.when(F.col("has_voice"), rank_fraction(F.col("_mix"))).otherwise(F.col("loud_rank"))
    ).drop("_mix")


def fusion_scores(windows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Weighted fusion of the ranks. A quiet window with strong chat joy gets its chat share raised.

    The boost looks at loudness and joy alone, not at the mixed ranks.
    """
    screen = F.col("has_screen") if "has_screen" in windows.columns else F.lit(False)
    visual = F.when(screen, F.col("visual_score")) if "visual_score" in windows.columns else F.lit(None)
    visual = F.coalesce(visual.cast("double"), F.lit(0.0))
    share = F.when(screen, F.lit(s.fusion_screen)).otherwise(F.lit(0.0))

    def mix(chat_share: Column, audio_share: float) -> Column:
        return chat_share * F.col("chat_rank") + F.lit(audio_share) * F.col("audio_rank") + share * visual

    normal = mix(F.lit(s.fusion_chat) - share, s.fusion_audio)
    if not s.low_energy_boost:
        return windows.withColumn("low_energy_boost", F.lit(None).cast("boolean")).withColumn("fusion", normal)
    boosted = (comparable(F.col("loud_rank")) < s.boost_loud_below) & (
        comparable(F.col("joy_rank")) >= s.boost_joy_from)
    raised = mix(F.lit(1.0 - s.boost_audio) - share, s.boost_audio)
    return windows.withColumn("low_energy_boost", F.coalesce(boosted, F.lit(False))).withColumn(
        "fusion", F.when(F.col("low_energy_boost"), raised).otherwise(normal))


def fusion_threshold(windows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Add the threshold of the recording: mean plus half a population deviation of the fusion, nulls left out."""
    return windows.withColumn(
        "fusion_threshold",
        F.avg("fusion").over(_video()) + s.threshold_std_factor * F.stddev_pop("fusion").over(_video()))
