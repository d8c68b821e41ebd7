"""The analysis of many recordings at once, from chat rows to ranked highlights and their report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdpeak.functions.emotion import ContextRules, context_boost, with_emotion_columns
from crowdpeak.operators import candidates as cand
from crowdpeak.operators import grid, lines, ranks, report, selection
from crowdpeak.settings import Settings

DEFAULT = Settings()


@dataclass(frozen=True)
class Signals:
    """Optional inputs. A missing table, or a recording that is not in it, switches the signal off."""

    voice: DataFrame | None = None      # video_id, sec, rms_db, f0_hz, onset
    screen: DataFrame | None = None     # video_id, t, value
    scenes: DataFrame | None = None     # video_id, t, lines


def emotion_series(scored_chats: DataFrame, rules: ContextRules = ContextRules()) -> DataFrame:
    """Chat rows with model probabilities `probs` to the emotion series: rules, top emotion, percent columns."""
    return with_emotion_columns(context_boost(scored_chats, rules=rules))


def fused_windows(chats: DataFrame, videos: DataFrame, signals: Signals,
                  exact_lines: bool = False, s: Settings = DEFAULT) -> DataFrame:
    """All windows with their signals, ranks, fusion score and threshold."""
    windows = grid.chat_scores(chats, grid.window_grid(videos, s), videos, s=s)
    if signals.scenes is not None:
        fresh = lines.new_lines(signals.scenes, s, exact_lines)
        windows = lines.line_scores(fresh, windows, signals.scenes, videos, s)
    if signals.voice is not None or signals.screen is not None:
        windows = grid.signal_scores(windows, signals.voice, signals.screen, videos, s)
    ranked = ranks.voice_ranks(ranks.chat_ranks(windows, s), s)
    return ranks.fusion_threshold(ranks.fusion_scores(ranked, s), s)


def candidate_windows(chats: DataFrame, stats: DataFrame, signals: Signals = Signals(),
                      exact_lines: bool = False, s: Settings = DEFAULT) -> DataFrame:
    """Windows above the threshold. Recordings with a voice track are judged by fusion, the others by chat alone.

    `stats` is the output of `grid.video_stats`. Rows after the end of a recording are in no window.
    """
    if signals.voice is None:
        return cand.chat_candidates(grid.chat_scores(chats, grid.window_grid(stats, s), stats, s=s))
    return cand.fusion_candidates(fused_windows(chats, stats, signals, exact_lines, s))


def first_stage(chats: DataFrame, stats: DataFrame, signals: Signals = Signals(),
                exact_lines: bool = False, s: Settings = DEFAULT) -> DataFrame:
    """Candidate intervals of every recording."""
    return cand.first_stage(candidate_windows(chats, stats, signals, exact_lines, s), s)


def highlights(candidates: DataFrame, speech: DataFrame, stats: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Ranked highlights under the length budget. `speech` needs rows only for `second_stage_input(candidates)`."""
    heard = selection.second_stage_input(candidates, s)
    return selection.select_highlights(selection.final_scores(heard, speech, s), stats, s)


def video_report(chats: DataFrame, found: DataFrame, stats: DataFrame, s: Settings = DEFAULT, tie: str = "chat_text") -> DataFrame:
    """One row per recording for the result page. `tie` decides between chats of the same time and joy."""
    videos = stats.select("video_id")
    score = report.reaction_score(chats, found, videos, s=s).select("video_id", "score")
    return (
        videos.join(score, "video_id", "left")
        .join(report.peak_points(chats, tie=tie), "video_id", "left")
        .join(report.highlight_totals(chats, found, videos), "video_id", "left")
        .join(report.dominant_emotion(chats, found, videos), "video_id", "left")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
    )
