"""The 30-second window grid and the signals measured on it.

Windows overlap: a chat lies in six or seven of them. Instead of a range join, rows are first summed up per 5-second
slot (one partial row per slot leaves each map task) and only the slot totals are spread over the windows they belong
to. The number of slots depends on the length of a recording, not on how many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdpeak.functions.numbers import clamp, rounded, semitones
from crowdpeak.operators.buckets import slot_of
from crowdpeak.settings import Settings

DEFAULT = Settings()


def video_stats(chats: DataFrame, videos: DataFrame | None = None, joy: str | None = None,
                s: Settings = DEFAULT) -> DataFrame:
    """Length, number of chats and adaptive joy threshold of each recording.

    Mean and deviation are those of the unrounded joy where the table has it (`joy_raw`), else of `joy_pct`.

    `videos(video_id, fps, frames)` adds media lengths and recordings without any chat.
    """
    joy = joy or ("joy_raw" if "joy_raw" in chats.columns else "joy_pct")
    stats = chats.groupBy("video_id").agg(
        F.count("*").alias("total_chats"), F.max("t").alias("_last"),
        F.avg(joy).alias("_mean"), F.stddev_pop(joy).alias("_std"))
    if videos is not None:
        stats = videos.join(stats, "video_id", "left")
        media = F.when((F.col("fps") > 0) & (F.col("frames") > 0), F.col("frames") / F.col("fps"))
    else:
        media = F.lit(None).cast("double")
    mean = F.coalesce("_mean", F.lit(s.default_mean_joy))
    std = F.coalesce("_std", F.lit(s.default_std_joy))
    return stats.select(
        "video_id",
        F.coalesce("total_chats", F.lit(0)).alias("total_chats"),
        rounded(F.coalesce(media, F.col("_last") + s.duration_margin_sec, F.lit(s.default_duration_sec))).alias(
            "duration_sec"),
        rounded(mean).alias("mean_joy"), rounded(std).alias("std_joy"),
        rounded(mean + s.threshold_std_factor * std).alias("calculated_threshold"))


def window_count(duration: Column, s: Settings = DEFAULT) -> Column:
    reach = duration + s.step_sec - s.window_sec
    return F.when(reach >= 0, F.least(
        F.floor(reach / s.step_sec) + 1, F.ceil(duration / s.step_sec))).otherwise(F.lit(0)).cast("long")


def window_grid(videos: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row per window of each recording in `videos(video_id, duration_sec)`. The last window may be cut short.

    A threshold in `videos` stays with the windows, so that they need not be joined with `videos` again.
    """
    more = [c for c in ("calculated_threshold",) if c in videos.columns]
    return (
        videos.withColumn("_n", window_count(F.col("duration_sec"), s)).filter("_n > 0")
        .select("video_id", "duration_sec", *more,
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("k"))
        .select("video_id", "k", (F.col("k") * s.step_sec).alias("start_sec"),
                F.least(F.col("k") * s.step_sec + s.window_sec, F.col("duration_sec")).alias("end_sec"), *more)
    )


def _steps(s: Settings) -> int:
    steps = int(s.window_sec // s.step_sec)
    if steps * s.step_sec != s.window_sec:
        raise ValueError("the window length must be a multiple of the step")
    return steps


def _slot_parts(value: Column, t: Column, j: Column, s: Settings) -> list[Column]:
    """Sums of a slot; those of rows exactly on its start apart, since they also close the window that ends there."""
    edge = t == j * F.lit(s.step_sec)
    return [F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"),
            F.count_if(edge).alias("edge_n"), F.sum(F.when(edge, value)).alias("edge_total"),
            F.max(F.when(edge, value)).alias("edge_top")]


def slot_sums(points: DataFrame, value: str, t: str = "t", s: Settings = DEFAULT) -> DataFrame:
    """One row per 5-second slot with rows: all that window sums and thresholds need, and mergeable by `merge_slots`."""
    placed = points.select("video_id", slot_of(F.col(t), s.step_sec).alias("j"), F.col(t).alias("t"), F.col(value).alias("v"))
    return placed.groupBy("video_id", "j").agg(
        *_slot_parts(F.col("v"), F.col("t"), F.col("j"), s), F.max("t").alias("last_t"),
        (F.var_pop("v") * F.count("v")).alias("spread"), F.count("v").alias("valued"))


def merge_slots(slots: DataFrame) -> DataFrame:
    """Partial slot sums of the same slot added up. Squared deviations are moved to the common mean."""
    mean = F.sum("total") / F.sum("valued")
    # sum n_i * (mean_i - mean)^2 = sum n_i * mean_i^2 - N * mean^2, taken around the smallest part mean to keep digits
    part = F.col("total") / F.col("valued")
    base = F.min(part).over(Window.partitionBy("video_id", "j"))
    moved = slots.withColumn("_d", part - base).withColumn("_base", base)
    between = F.sum(F.col("valued") * F.col("_d") * F.col("_d")) - F.sum("valued") * (mean - F.max("_base")) * (mean - F.max("_base"))
    return moved.groupBy("video_id", "j").agg(
        *[F.sum(c).alias(c) if c not in ("top", "edge_top") else F.max(c).alias(c) for c in ("n", "total", "top", "edge_n", "edge_total", "edge_top")],
        F.max("last_t").alias("last_t"), (F.sum("spread") + F.greatest(between, F.lit(0.0))).alias("spread"), F.sum("valued").alias("valued"))


def stats_of_slots(slots: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """What `video_stats` gives, from the slots of whole recordings instead of their rows."""
    whole = slots.groupBy("video_id").agg(
        F.sum("n").alias("total_chats"), F.max("last_t").alias("_last"), (F.sum("total") / F.sum("valued")).alias("_mean"))
    off = F.col("total") / F.col("valued") - F.col("_mean")
    spread = slots.join(whole.select("video_id", "_mean"), "video_id").groupBy("video_id").agg(
        F.sqrt(F.sum(F.col("spread") + F.col("valued") * off * off) / F.sum("valued")).alias("_std"))
    mean = F.coalesce("_mean", F.lit(s.default_mean_joy))
    std = F.coalesce("_std", F.lit(s.default_std_joy))
    return whole.join(spread, "video_id").select(
        "video_id", "total_chats", rounded(F.col("_last") + s.duration_margin_sec).alias("duration_sec"),
        rounded(mean).alias("mean_joy"), rounded(std).alias("std_joy"),
        rounded(mean + s.threshold_std_factor * std).alias("calculated_threshold"))


def windows_of_slots(slots: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Count, sum and maximum for each window `[5k, 5k+30]` with both ends inside, from slot sums."""
    steps = _steps(s)
    whole = [F.struct((F.col("j") - d).alias("k"), F.col("n").alias("n"), F.col("total").alias("total"),
                      F.col("top").alias("top")) for d in range(steps)]
    closing = F.struct((F.col("j") - steps).alias("k"), F.col("edge_n").alias("n"),
                       F.col("edge_total").alias("total"), F.col("edge_top").alias("top"))
    return (
        slots.select("video_id", F.explode(F.array(*whole, closing)).alias("p")).select("video_id", "p.*")
        .filter("k >= 0 AND n > 0")
        .groupBy("video_id", "k")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"))
    )


def closed_window_sums(points: DataFrame, value: str, t: str = "t", videos: DataFrame | None = None,
                       s: Settings = DEFAULT) -> DataFrame:
    """Count, sum and maximum of `value` for each window `[5k, 5k+30]` with both ends inside.

    With `videos(video_id, duration_sec)` a point after the end of its recording is in no window. Slots that lie inside
    as a whole are kept as they are; only rows of the one slot in which a recording ends are looked at again, by
    `(video_id, slot)`.
    """
    placed = points.select("video_id", slot_of(F.col(t), s.step_sec).alias("j"), F.col(t).alias("t"), F.col(value).alias("v"))
    parts = _slot_parts(F.col("v"), F.col("t"), F.col("j"), s)
    if videos is None:
        return windows_of_slots(placed.groupBy("video_id", "j").agg(*parts), s)
    ends = videos.select("video_id", F.col("duration_sec").alias("_end"))
    spans = placed.groupBy("video_id", "j").agg(
        *parts, F.min("t").alias("_first"), F.max("t").alias("_last")).join(ends, "video_id")
    inside = spans.filter(F.col("_last") <= F.col("_end")).drop("_first", "_last", "_end")
    cut = spans.filter((F.col("_first") <= F.col("_end")) & (F.col("_last") > F.col("_end"))).select("video_id", "j", "_end")
    return windows_of_slots(inside.unionByName(
        placed.join(cut, ["video_id", "j"]).filter(F.col("t") <= F.col("_end")).groupBy("video_id", "j").agg(*parts)), s)


def chat_scores(chats: DataFrame, grid: DataFrame, clip_to: DataFrame | None = None, joy: str = "joy_pct",
                s: Settings = DEFAULT) -> DataFrame:
    """Chat score of every window; windows without chats are kept with count and score 0."""
    return scored_windows(closed_window_sums(chats, joy, videos=clip_to, s=s), grid, s)


def scored_windows(sums: DataFrame, grid: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The windows of `grid` with the chat score of their sums."""
    avg = F.coalesce(F.col("total") / F.col("n"), F.lit(0.0))
    return (
        grid.join(sums, ["video_id", "k"], "left")
        .withColumn("chat_count", F.coalesce("n", F.lit(0)))
        .withColumn("avg_joy", avg)
        .withColumn("chat_score",
                    F.coalesce(F.col("avg_joy") * s.joy_mean_weight + F.col("top") * s.joy_max_weight, F.lit(0.0)))
        .drop("n", "total", "top")
    )


def spread_half_open(points: DataFrame, t: str, s: Settings = DEFAULT) -> DataFrame:
    """Each row once per window `[5k, 5k+30)` it lies in. Only for signals with at most one row a second."""
    steps = _steps(s)
    j = slot_of(F.col(t).cast("double"), s.step_sec)
    return points.withColumn("k", F.explode(F.sequence(j - (steps - 1), j))).filter("k >= 0")


def _median(values: Column) -> Column:
    """Exact median of an array without nulls, null if it is empty."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def _present(values: Column, field: str) -> Column:
    return F.filter(F.transform(values, lambda x: x[field]), lambda x: x.isNotNull())


def signal_scores(windows: DataFrame, voice: DataFrame | None = None, screen: DataFrame | None = None,
                  clip_to: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
    """The scores of `voice_scores` and of `screen_scores` for each window, whichever table is given, in one pass.

    Samples of both tables go into one list per 5-second slot: one exchange, in which each sample stands once. A slot then
    meets the window that starts with it, and a window takes the lists of its six slots from the rows after it in its
    recording, so that no sample is repeated in an exchange. Rows of a recording are as many as its slots, like those that
    are ranked afterwards by the same key. Medians are exact: the lists of a window are merged and sorted.
    """
    parts = []
    v_type, s_type = "struct<at:double,loud:double,f0:double,onset:double>", "struct<at:double,value:double>"

    def number(c: str) -> Column:
        return F.when(~F.isnan(c), F.col(c))

    if voice is not None:
        voice = voice.select("video_id", F.col("sec").cast("double").alias("at"), number("rms_db").alias("loud"),
                             number("f0_hz").alias("f0"), number("onset").alias("onset"))
        parts.append(voice.select("video_id", slot_of(F.col("at"), s.step_sec).alias("k"),
                                  F.struct("at", "loud", "f0", "onset").cast(v_type).alias("v"), F.lit(None).cast(s_type).alias("s")))
    if screen is not None:
        parts.append(screen.select("video_id", slot_of(F.col("t"), s.step_sec).alias("k"), F.lit(None).cast(v_type).alias("v"),
                                   F.struct(F.col("t").alias("at"), "value").cast(s_type).alias("s")))
    samples = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    slots = samples.groupBy("video_id", "k").agg(F.collect_list("v").alias("_voice"), F.collect_list("s").alias("_screen"))
    slots = slots.withColumns({"_heard": F.array_min(_present(F.col("_voice"), "loud")), "_onsets": F.size(_present(F.col("_voice"), "onset")),
                               "_seen": F.size("_screen") > 0})
    if clip_to is not None:
        slots = slots.join(clip_to.select("video_id", F.col("duration_sec").alias("_end")), "video_id")
        slots = slots.withColumns({"_voice": F.filter("_voice", lambda x: x["at"] < F.ceil(F.col("_end"))),
                                   "_screen": F.filter("_screen", lambda x: x["at"] < F.col("_end"))}).drop("_end")
    recording = Window.partitionBy("video_id")
    ahead = recording.orderBy("k").rangeBetween(0, _steps(s) - 1)
    out = windows.withColumn("_window", F.lit(True)).join(slots, ["video_id", "k"], "full").select(
        *windows.columns, "_window", F.flatten(F.collect_list("_voice").over(ahead)).alias("_voice"),
        F.flatten(F.collect_list("_screen").over(ahead)).alias("_screen"), F.min("_heard").over(recording).alias("_quietest"),
        F.sum("_onsets").over(recording).alias("_onsets"), F.coalesce(F.bool_or("_seen").over(recording), F.lit(False)).alias("_seen")).filter("_window")
    if voice is not None:
        base = voice.groupBy("video_id").agg(F.median("f0").alias("_f0_all"))
        out = out.join(base, "video_id", "left").withColumns({
            "tempo": _mean(_present(F.col("_voice"), "onset")), "has_audio": F.col("_quietest").isNotNull(),
            "has_voice": F.coalesce(F.col("_onsets") > 0, F.lit(False)),
            "audio_level": F.coalesce(_mean(_present(F.col("_voice"), "loud")), "_quietest"),
            "pitch_st": semitones(_median(_present(F.col("_voice"), "f0")), F.col("_f0_all"))}).drop("_f0_all")
    if screen is not None:
        change = (F.coalesce(_median(_present(F.col("_screen"), "value")), F.lit(0.0)) - s.screen_low) / (s.screen_high - s.screen_low)
        out = out.withColumns({"has_screen": F.col("_seen"), "visual_score": clamp(change)})
    return out.drop("_window", "_voice", "_screen", "_quietest", "_onsets", "_seen")


def voice_scores(voice: DataFrame, windows: DataFrame, clip_to: DataFrame | None = None,
                 s: Settings = DEFAULT) -> DataFrame:
    """Loudness, pitch in semitones and tempo of each window from `voice(video_id, sec, rms_db, f0_hz, onset)`.

    A window without seconds gets the lowest loudness of the recording and neither pitch nor tempo. Columns
    `has_audio` and `has_voice` tell which recordings have the signals at all.
    """
    return signal_scores(windows, voice=voice, clip_to=clip_to, s=s)


def screen_scores(screen: DataFrame, windows: DataFrame, clip_to: DataFrame | None = None,
                  s: Settings = DEFAULT) -> DataFrame:
    """0-1 screen score of each window from `screen(video_id, t, value)`: the median change between two bounds."""
    return signal_scores(windows, screen=screen, clip_to=clip_to, s=s)
