"""All tunable numbers of the engine in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # sliding windows
    window_sec: float = 30.0
    step_sec: float = 5.0
    joy_mean_weight: float = 0.7
    joy_max_weight: float = 0.3
    threshold_std_factor: float = 0.5
    default_mean_joy: float = 20.0
    default_std_joy: float = 5.0
    default_threshold: float = 8.0
    default_duration_sec: float = 65.0
    duration_margin_sec: float = 30.0

    # fusion of chat, voice and screen
    fusion_chat: float = 0.7
    fusion_audio: float = 0.3
    fusion_screen: float = 0.05
    screen_low: float = 50.0
    screen_high: float = 90.0
    voice_loud: float = 0.8
    voice_pitch: float = 0.1
    voice_tempo: float = 0.1
    chat_joy: float = 0.9
    chat_concentration: float = 0.05
    chat_frequency: float = 0.05
    missing_rank: float = 0.5
    low_energy_boost: bool = True
    boost_loud_below: float = 0.30
    boost_joy_from: float = 0.70
    boost_audio: float = 0.15

    # chat lines
    line_similarity: float = 0.8
    line_min_count: int = 3
    line_ngrams: tuple[int, ...] = (2, 3)
    scene_gap_sec: float = 7.5

    # candidate intervals
    clip_max_sec: float = 90.0
    second_span: bool = True
    second_span_from_sec: float = 210.0
    second_span_gap_sec: float = 30.0
    first_stage_limit: int = 20

    # final selection
    second_stage_limit: int = 12
    final_stage1_weight: float = 0.7
    final_speech_weight: float = 0.3
    final_limit: int = 10
    final_budget_sec: float = 900.0
    final_budget_ratio: float = 0.4

    # chat region detection
    region_frames: int = 20
    region_start_sec: float = 5.0
    region_end_guard_sec: float = 5.0
    region_fixed_iou: float = 0.5
    region_fixed_ratio: float = 0.5
    region_left_gap: float = 0.03
    region_top_groups: int = 5
    region_height_low: float = 0.65
    region_height_high: float = 1.35
    region_chunk_gap: float = 1.5
    region_row_gap: float = 0.5
    region_band_gap: float = 2.0
    region_margin_x: float = 0.02
    region_margin_y: float = 0.05
    region_min_rows: int = 8

    # data sets, jobs, history
    ingest_limit: int | None = None  # messages kept of each recording; all unless asked for
    ingest_from_ms: int = 180_000
    split_test_share: float = 0.2
    split_seed: int = 42
    oversample_to: int = 1200
    retention_hours: int = 4
    history_limit: int = 30
