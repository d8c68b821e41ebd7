"""Result view: reaction score, peak, dominant emotion, totals, clip links, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdpeak import fixed_values as fv
from crowdpeak.functions.numbers import first_argmax, normal_cdf
from crowdpeak.operators.buckets import points_in_any, windows_inside
from crowdpeak.operators.grid import closed_window_sums, window_grid
from crowdpeak.settings import Settings

DEFAULT = Settings()


def view_lengths(chats: DataFrame, highlights: DataFrame) -> DataFrame:
    """Length of each recording as its result view sees it: the last chat or the last highlight end."""
    last = chats.groupBy("video_id").agg(F.max("t").alias("_last"))
    ends = highlights.groupBy("video_id").agg(F.max("end_time").alias("_end"))
    return ends.join(last, "video_id", "full").select(
        "video_id", F.greatest("_last", "_end").alias("duration_sec"))


def _highlight_moments(chats: DataFrame, highlights: DataFrame, joy: str, s: Settings) -> DataFrame:
    """Each highlight of a recording with chats: mean joy of the windows inside it, if there are any, and mean and
    deviation of all windows of the recording that have chats. Both sides have a bounded number of rows a recording."""
    grid = window_grid(view_lengths(chats, highlights), s)
    sums = closed_window_sums(chats, joy, s=s)
    whole = Window.partitionBy("video_id")
    value = F.col("total") / F.col("n")
    windows = grid.join(sums, ["video_id", "k"]).select(
        "video_id", "start_sec", "end_sec", value.alias("joy"), F.avg(value).over(whole).alias("mu"),
        F.stddev_pop(value).over(whole).alias("sd"))
    spans = highlights.select("video_id", "start_time", "end_time").distinct()
    inside = windows_inside(windows, spans).groupBy("video_id", "start_time", "end_time").agg(F.avg("joy").alias("mean_joy"))
    moments = windows.groupBy("video_id").agg(F.first("mu").alias("mu"), F.first("sd").alias("sd"))
    per = spans.join(moments, "video_id").join(inside, ["video_id", "start_time", "end_time"], "left")
    return per.withColumn("z", F.when(F.col("sd") >= 1e-9, (F.col("mean_joy") - F.col("mu")) / F.col("sd")))


def highlight_z(chats: DataFrame, highlights: DataFrame, joy: str = "joy_pct", s: Settings = DEFAULT) -> DataFrame:
    """Standard score of each highlight with at least one window inside: its mean joy against that of all windows."""
    return _highlight_moments(chats, highlights, joy, s).filter(F.col("mean_joy").isNotNull())


def reaction_score(chats: DataFrame, highlights: DataFrame, videos: DataFrame, joy: str = "joy_pct",
                   s: Settings = DEFAULT) -> DataFrame:
    """Score 0-100 of each recording: how far its highlights stand out from its usual joy, as a percentile.

    Even joy scores 50. Without a usable window the mean final score stands in; without highlights the score is 0.
    """
    z = _highlight_moments(chats, highlights, joy, s).groupBy("video_id").agg(
        F.avg("z").alias("mean_z"), F.first("sd").alias("_sd"))
    finals = highlights.groupBy("video_id").agg(F.avg("final_highlight_score").alias("_final"))
    return (
        videos.select("video_id").join(finals, "video_id", "left").join(z, "video_id", "left")
        .select(
            "video_id", "mean_z",
            F.when(F.col("_final").isNull(), F.lit(0.0))
            .when(F.col("_sd") < 1e-9, F.lit(50.0))
            .when(F.col("mean_z").isNotNull(), normal_cdf(F.col("mean_z")) * 100)
            .otherwise(F.col("_final")).alias("score"))
    )


def peak_points(chats: DataFrame, joy: str = "joy_pct", tie: str = "chat_text") -> DataFrame:
    """Earliest chat with the highest joy of each recording; of several at that time the one with the smallest `tie`."""
    order = F.struct(F.col(joy).isNull().alias("a"), (-F.col(joy)).alias("b"), F.col("t").alias("c"), F.col(tie).alias("d"))
    found = chats.groupBy("video_id").agg(F.min_by(F.struct("t", joy, "chat_text"), order).alias("_p"))
    return found.select("video_id", F.col("_p.t").alias("peak_t"), F.col(f"_p.{joy}").alias("peak_joy"),
                        F.col("_p.chat_text").alias("peak_text"))


def dominant_emotion(chats: DataFrame, highlights: DataFrame, videos: DataFrame) -> DataFrame:
    """Strongest emotion but neutral, over the chats inside any highlight (each chat once); null without chats."""
    fields = fv.EMOTION_FIELDS[:-1]
    inside = points_in_any(chats.select("video_id", "t", *fields), highlights)
    means = inside.groupBy("video_id").agg(*[F.avg(F.coalesce(f, F.lit(0.0))).alias(f) for f in fields])
    values = F.array(*[F.round(F.col(f), 9) for f in fields])
    names = F.array(*[F.lit(n) for n in fv.EMOTIONS[:-1]])
    best = means.select("video_id", F.get(names, first_argmax(values)).alias("dominant_emotion"))
    return videos.select("video_id").join(best, "video_id", "left")


def highlight_totals(chats: DataFrame, highlights: DataFrame, videos: DataFrame) -> DataFrame:
    """Number and length of the highlights, and the length of the time line (at least one second)."""
    totals = highlights.groupBy("video_id").agg(
        F.count("*").alias("n"), F.sum(F.col("end_time") - F.col("start_time")).alias("sec"))
    return (
        videos.select("video_id").join(totals, "video_id", "left")
        .join(view_lengths(chats, highlights), "video_id", "left")
        .select("video_id", F.coalesce("n", F.lit(0)).alias("highlight_count"),
                F.coalesce("sec", F.lit(0.0)).alias("highlight_sec"),
                F.greatest(F.coalesce("duration_sec", F.lit(0.0)), F.lit(1.0)).alias("timeline_sec"))
    )


def with_clip_links(highlights: DataFrame, clips: DataFrame) -> DataFrame:
    """Give the i-th highlight the i-th clip file `clips(video_id, clip_no from 0, path)`; links use the rank."""
    position = Window.partitionBy("video_id").orderBy("start_time")
    numbered = highlights.withColumn("_no", F.row_number().over(position) - 1)
    made = clips.select("video_id", F.col("clip_no").alias("_no"), F.col("path").isNotNull().alias("_made"))
    link = F.format_string("/files/%s_highlight_%d.mp4", F.col("video_id"), F.col("rank"))
    return numbered.join(made, ["video_id", "_no"], "left").withColumn(
        "clip_url", F.when(F.col("_made"), link)).drop("_no", "_made")


def result_view(jobs: DataFrame, series: DataFrame, highlights: DataFrame, progress: DataFrame) -> DataFrame:
    """Everything known about a job on one row: its state, the size of its series and highlights, its progress."""
    points = series.groupBy("video_id").agg(F.count("*").alias("points"))
    found = highlights.groupBy("video_id").agg(F.count("*").alias("highlights"))
    return (
        jobs.join(points, "video_id", "left").join(found, "video_id", "left").join(progress, "video_id", "left")
        .withColumn("final_video_url", F.when(
            (F.col("status") == "done") & (F.col("highlights") > 0),
            F.format_string("/files/%s_highlight.mp4", F.col("video_id"))))
    )


def history_with_state(history: DataFrame, states: DataFrame) -> DataFrame:
    """History entries with their state. `states(video_id, status, reachable)`; entries the server does not know are
    dropped, entries it could not be asked about are kept as unreachable."""
    return history.join(states, "video_id").withColumn(
        "status", F.when(F.col("reachable"), F.col("status")).otherwise(F.lit("unreachable"))).drop("reachable")


def recent_history(history: DataFrame, user: str = "user_id", created: str = "created_at", tie: str = "video_id",
                   s: Settings = DEFAULT) -> DataFrame:
    """Newest entries of each user. Spark keeps only the best rows of each map task before it shuffles."""
    w = Window.partitionBy(user).orderBy(F.col(created).desc(), F.col(tie).desc())
    return history.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= s.history_limit)
