"""Windows, candidates and selection on hand-made recordings."""

import difflib
import math
import random

import pytest
from collections import Counter

from pyspark.sql import functions as F

from crowdpeak.operators import candidates as cand
from crowdpeak.operators import grid, lines, ranks, selection
from crowdpeak.plans import analysis
from crowdpeak.settings import Settings


def chat(spark, rows):
    return spark.createDataFrame(rows, "video_id string, t double, joy_pct double")


def video(spark, *rows):
    return spark.createDataFrame(list(rows), "video_id string, duration_sec double")


def candidates(spark, rows):
    """Candidate windows (start, score) of one recording, 30 seconds long."""
    full = [("a", int(s // 5), float(s), s + 30.0, 30.0, float(score), 10.0 + s, 3, None, None, None)
            for s, score in rows]
    return spark.createDataFrame(full, "video_id string, k long, start_time double, end_time double, duration double, "
                                 "window_score double, avg_joy double, chat_count long, audio_score double, "
                                 "visual_score double, low_energy_boost boolean")


# --- Fixed values: seconds and joy of a 70-second recording with a known result ------------------
KNOWN_SERIES = [
    (0, 2.19), (1, 5.12), (10, 2.09), (21, 4.23), (25, 3.32), (28, 9.89), (41, 3.23), (42, 3.92),
    (46, 2.38), (51, 3.49), (52, 4.0), (54, 3.37), (57, 3.31), (59, 1.31), (62, 3.14), (66, 2.64),
    (67, 1.39), (68, 1.13), (69, 1.14),
]
# --- End of fixed values ---------------------------------------------------------------------------


def test_known_recording(spark):
    chats = chat(spark, [("game", float(t), joy) for t, joy in KNOWN_SERIES])
    stats = grid.video_stats(chats).withColumn("duration_sec", F.lit(70.0))
    row = stats.first()
    assert (row.calculated_threshold, row.mean_joy, row.std_joy) == (4.18, 3.23, 1.91)
    found = analysis.first_stage(chats, stats, s=Settings(clip_max_sec=0)).collect()
    assert [(r.start_time, r.end_time, r.window_score, r.avg_joy, r.chat_count) for r in found] == [
        (0.0, 55.0, 6.41, 4.47, 33)]


def test_both_ends_of_a_window_count(spark):
    w = grid.chat_scores(chat(spark, [("a", 30.0, 8.0), ("a", 29.999, 4.0), ("a", 60.0, 6.0)]),
                         grid.window_grid(video(spark, ("a", 60.0))))
    counts = {r.k: r.chat_count for r in w.collect()}
    assert counts == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 1}


def test_windows_against_brute_force(spark):
    rng = random.Random(5)
    length = 187.3
    times = [rng.choice([rng.uniform(0, 200), 5.0 * rng.randrange(40)]) for _ in range(300)]
    rows = [("a", t, rng.randrange(1000) / 10) for t in times]
    chats, videos = chat(spark, rows), video(spark, ("a", length), ("empty", 60.0), ("short", 24.9), ("least", 25.0))
    got = {(r.video_id, r.k): (r.chat_count, r.chat_score) for r in
           grid.chat_scores(chats, grid.window_grid(videos), videos).collect()}
    assert {v for v, _ in got} == {"a", "empty", "least"}
    k = 0
    while 5 * k + 30 <= length + 5:
        joys = [j for _, t, j in rows if 5 * k <= t <= min(5 * k + 30, length)]
        want = sum(joys) / len(joys) * 0.7 + max(joys) * 0.3
        assert got["a", k][0] == len(joys) and math.isclose(got["a", k][1], want, rel_tol=1e-9)
        k += 1
    assert ("a", k) not in got and got["empty", 0] == (0, 0.0)


def test_equal_values_share_a_rank_and_missing_values_have_none(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, 2.0, 2.0, None, 5.0])]
    df = spark.createDataFrame(rows, "video_id string, k int, v double")
    out = {r.k: (r.all, r.present) for r in df.select(
        "k", ranks.rank_fraction(F.col("v")).alias("all"), ranks.rank_fraction(F.col("v"), True).alias("present")
    ).collect()}
    assert out[0] == (0.2, 0.25) and out[1] == out[2] == (0.5, 0.625) and out[3] == (None, None) and out[4] == (0.8, 1.0)


def test_recording_without_sound_is_judged_by_chat(spark):
    rng = random.Random(2)
    rows = [(v, rng.uniform(0, 300), float(rng.randrange(100))) for v in ("heard", "mute") for _ in range(200)]
    chats = chat(spark, rows)
    stats = grid.video_stats(chats).withColumn("duration_sec", F.lit(300.0))
    voice = spark.createDataFrame([("heard", s, -60.0 + s % 37, None if s % 5 else 100.0 + s, (s % 11) / 5)
                                   for s in range(200)], "video_id string, sec int, rms_db double, f0_hz double, onset double")
    both = analysis.candidate_windows(chats, stats, analysis.Signals(voice=voice))
    alone = analysis.candidate_windows(chats.filter("video_id = 'mute'"), stats.filter("video_id = 'mute'"))
    mute = both.filter("video_id = 'mute'")
    assert sorted(mute.collect()) == sorted(alone.collect()) and alone.count() > 0
    heard = both.filter("video_id = 'heard'").collect()
    # Windows after the end of the sound have no tempo and cannot pass.
    assert heard and max(r.start_time for r in heard) < 200


def test_touching_windows_merge_and_others_do_not(spark):
    out = cand.merge_intervals(candidates(spark, [(0, 5), (30, 9), (65, 7)])).orderBy("start_time").collect()
    assert [(r.start_time, r.end_time, r.window_score, r.avg_joy, r.chat_count) for r in out] == [
        (0.0, 60.0, 9.0, 10.0, 6), (65.0, 95.0, 7.0, 75.0, 3)]


@pytest.mark.parametrize("length,spans", [(90, [(0, 90)]), (95, [(5, 95)]), (205, [(115, 205)]), (210, [(120, 210), (0, 90)])])
def test_long_intervals_are_cut(spark, length, spans):
    rows = [(s, 50 + s / 10) for s in range(0, length - 25, 5)]
    out = cand.capped_intervals(candidates(spark, rows)).orderBy(F.coalesce("second_span", F.lit(False))).collect()
    assert [(r.start_time, r.end_time) for r in out] == spans
    assert all(r.original_duration == (length if length > 90 else None) for r in out)


def test_cut_keeps_the_earliest_of_equal_spans(spark):
    out = cand.capped_intervals(candidates(spark, [(s, 7) for s in range(0, 100, 5)])).collect()
    assert [(r.start_time, r.end_time) for r in out] == [(0.0, 90.0)]


def test_cap_shorter_than_a_window_keeps_the_interval(spark):
    out = cand.capped_intervals(candidates(spark, [(0, 5), (5, 6)]), Settings(clip_max_sec=20.0)).collect()
    assert [(r.start_time, r.end_time, r.original_duration) for r in out] == [(0.0, 35.0, None)]


def test_budget_skips_what_does_not_fit_and_goes_on(spark):
    rows = [("a", 0.0, 60.0, 60.0, 9.0), ("a", 100.0, 190.0, 90.0, 8.0), ("a", 200.0, 230.0, 30.0, 7.0),
            ("b", 0.0, 90.0, 90.0, 5.0), ("b", 100.0, 130.0, 30.0, 4.0)]
    scored = spark.createDataFrame(rows, "video_id string, start_time double, end_time double, duration double, "
                                   "final_highlight_score double")
    out = selection.select_highlights(scored, video(spark, ("a", 250.0), ("b", 100.0))).orderBy("video_id", "rank")
    assert [(r.video_id, r.start_time, r.rank) for r in out.collect()] == [("a", 0.0, 1), ("a", 200.0, 2), ("b", 0.0, 1)]


def scene_rows(seed):
    rng = random.Random(seed)
    words = ["와 대박", "ㅋㅋㅋㅋ", "나이스 플레이", "와 대박!", "이게 되네", "ㅋㅋㅋㅋㅋ", "가", "hello  there", "", "나이스플레이"]
    rows, t = [], 0.0
    for _ in range(150):
        t += rng.choice([5.0, 5.0, 5.0, 7.5, 10.0])
        rows.append(("a", t, [rng.choice(words) for _ in range(rng.randrange(1, 6))]))
    return rows


def test_new_lines_against_brute_force(spark):
    rows = scene_rows(1)
    got = {(r.t, r.line_no) for r in lines.new_lines(
        spark.createDataFrame(rows, "video_id string, t double, lines array<string>")).collect()}
    want, before = set(), None
    for _, t, now in rows:
        known = before[1] if before and t - before[0] <= 7.5 else []
        want |= {(t, i) for i, line in enumerate(now)
                 if all(difflib.SequenceMatcher(None, line, p).ratio() < 0.8 for p in known)}
        before = (t, now)
    assert got == want


def test_concentration_against_all_pairs(spark):
    rows = scene_rows(3)
    scenes = spark.createDataFrame(rows, "video_id string, t double, lines array<string>")
    fresh = lines.new_lines(scenes)
    length = rows[-1][1] + 30
    got = lines.line_scores(fresh, grid.window_grid(video(spark, ("a", length)))).collect()
    kept = [(r.t, r.line) for r in fresh.collect()]

    def vector(line):
        body, counts = line.replace(" ", ""), {}
        for n in (2, 3):
            for i in range(len(body) - n + 1):
                counts[body[i:i + n]] = counts.get(body[i:i + n], 0) + 1
        size = math.sqrt(sum(c * c for c in counts.values()))
        return {g: c / size for g, c in counts.items()}

    for r in got:
        inside = [vector(line) for t, line in kept if r.start_sec <= t <= r.end_sec]
        assert r.chat_freq == len(inside)
        if len(inside) < 3:
            assert r.chat_conc is None
            continue
        pairs = [sum(w * b.get(g, 0) for g, w in a.items()) for i, a in enumerate(inside) for b in inside[i + 1:]]
        assert math.isclose(r.chat_conc, sum(pairs) / len(pairs), abs_tol=1e-9)


def test_empty_reasons(spark):
    videos = spark.createDataFrame([("quiet",), ("flat",), ("good",)], "video_id string")
    stats = spark.createDataFrame([("flat", 3), ("good", 9)], "video_id string, total_chats long")
    found = spark.createDataFrame([("good", 30.0)], "video_id string, duration double")
    out = {r.video_id: r for r in selection.result_metadata(videos, stats, found, found).collect()}
    assert (out["quiet"].empty_reason, out["flat"].empty_reason, out["good"].empty_reason) == (
        "no_chats", "no_candidates", None)
    assert out["good"].total_highlight_duration_sec == 30.0 and out["flat"].top_k_limit is None


def test_rows_after_the_end_are_in_no_window(spark):
    times = [0.0, 4.5, 5.0, 29.9, 31.0, 33.2, 33.5, 34.9, 35.0, 40.0, 62.0]
    chats = chat(spark, [("a", t, float(i + 1)) for i, t in enumerate(times)] + [("b", 9.0, 3.0)])
    for length in (33.2, 34.0, 35.0, 41.5):
        videos = video(spark, ("a", length), ("b", length))
        got = {(r.video_id, r.k): (r.n, r.total, r.top) for r in grid.closed_window_sums(chats, "joy_pct", videos=videos).collect()}
        for k in range(13):
            inside = [i + 1.0 for i, t in enumerate(times) if 5 * k <= t <= min(5 * k + 30, length)]
            assert got.get(("a", k)) == ((len(inside), sum(inside), max(inside)) if inside else None), (length, k)
    rows = spark.createDataFrame([("a", t, f"line {i} of some") for i, t in enumerate(times)], "video_id string, t double, line string")
    cut = lines.line_scores(rows, grid.window_grid(video(spark, ("a", 34.0))), clip_to=video(spark, ("a", 34.0)))
    plain = lines.line_scores(rows.filter("t <= 34"), grid.window_grid(video(spark, ("a", 34.0))))
    keep = ["k", "chat_freq", "chat_conc"]
    pairs = list(zip(sorted(cut.select(*keep).collect()), sorted(plain.select(*keep).collect()), strict=True))
    assert pairs and all(x[:2] == y[:2] and math.isclose(x.chat_conc, y.chat_conc, rel_tol=1e-12) for x, y in pairs)


def test_line_scores_over_blocks_of_windows_with_repeated_lines(spark):
    rng = random.Random(5)
    texts = ["wow what a play", "lol", "ㅋㅋ ㅋㅋ ㅋ", "a", "", "𝄞𝄞 wow"]
    rows = [(v, rng.choice([5.0, 1.0]) * rng.randrange(0, 80), rng.choice(texts)) for v in "ab" for _ in range(150)] + [(None, 3.0, "lol")]
    fresh = spark.createDataFrame(rows, "video_id string, t double, line string")
    out = lines.line_scores(fresh, grid.window_grid(video(spark, ("a", 430.0), ("b", 200.0), ("c", 60.0))))
    assert "explode(grams" not in out._jdf.queryExecution().executedPlan().toString()  # lines are shuffled, n-grams are not

    def vector(line):
        body = line.replace(" ", "")
        counts = Counter(body[i:i + n] for n in (2, 3) for i in range(len(body) - n + 1))
        return {g: c / math.sqrt(sum(x * x for x in counts.values())) for g, c in counts.items()}

    got = out.collect()
    assert max(r.k for r in got if r.video_id == "a") > 2 * lines.BLOCK
    for r in got:
        inside = [vector(line) for v, t, line in rows if v == r.video_id and r.start_sec <= t <= r.end_sec]
        assert r.chat_freq == len(inside)
        total = Counter()
        for x in inside:
            total.update(x)
        m = len(inside)
        want = (sum(w * w for w in total.values()) - sum(bool(x) for x in inside)) / (m * (m - 1)) if m >= 3 else None
        assert r.chat_conc is None if want is None else math.isclose(r.chat_conc, want, abs_tol=1e-9)
