"""Time buckets: the way this engine joins by range, looks back and ranks without one large task per recording.

A recording may hold a third of all rows. Therefore no row-level operator partitions by `video_id` alone: rows are
keyed by `(video_id, bucket of time)`, which splits a hot recording evenly over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slot_of(t: Column, width: float) -> Column:
    """Largest j with `j * width <= t`, exact even where the division rounds up to the next whole number."""
    j = F.floor(t / F.lit(width)).cast("long")
    return F.when(j * F.lit(width) > t, j - 1).otherwise(j)


def interval_join(points: DataFrame, intervals: DataFrame, t: str = "t", start: str = "start_time",
                  end: str = "end_time", key: str = "video_id", bucket_sec: float = 60.0) -> DataFrame:
    """Points inside closed intervals of the same recording, one row per pair.

    Both sides meet on `(key, bucket)`; an interval is repeated once per bucket it touches, a point never.
    """
    spread = intervals.withColumn("_bucket", F.explode(F.sequence(
        slot_of(F.col(start), bucket_sec), slot_of(F.col(end), bucket_sec))))
    placed = points.withColumn("_bucket", slot_of(F.col(t), bucket_sec))
    return (
        placed.join(spread, [key, "_bucket"])
        .filter((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end)))
        .drop("_bucket")
    )


def points_in_any(points: DataFrame, intervals: DataFrame, t: str = "t", start: str = "start_time",
                  end: str = "end_time", key: str = "video_id", bucket_sec: float = 60.0) -> DataFrame:
    """Points inside at least one interval, each point once (a semi join on the same buckets)."""
    spread = intervals.select(
        F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end"),
        F.explode(F.sequence(slot_of(F.col(start), bucket_sec), slot_of(F.col(end), bucket_sec))).alias("_bucket"))
    placed = points.withColumn("_point_bucket", slot_of(F.col(t), bucket_sec))
    hit = (
        (F.col(key) == F.col("_key")) & (F.col("_point_bucket") == F.col("_bucket"))
        & (F.col(t) >= F.col("_start")) & (F.col(t) <= F.col("_end"))
    )
    return placed.join(spread, hit, "left_semi").drop("_point_bucket")


def windows_inside(windows: DataFrame, intervals: DataFrame, start: str = "start_sec", end: str = "end_sec",
                   key: str = "video_id", bucket_sec: float = 60.0) -> DataFrame:
    """Windows that lie wholly inside an interval `(start_time, end_time)` of their recording, one row per pair.

    A window meets the intervals of the bucket its start falls in, never all of its recording."""
    met = interval_join(windows, intervals.select(key, "start_time", "end_time"), t=start, key=key, bucket_sec=bucket_sec)
    return met.filter(F.col(end) <= F.col("end_time"))


def with_previous(df: DataFrame, order: str, columns: dict[str, str], max_gap: float, key: str = "video_id",
                  tie: str | None = None, bucket: float = 600.0) -> DataFrame:
    """Add values of the row before, or null where it is more than `max_gap` away.

    Rows close to the end of a bucket are repeated at the head of the next one, so the look-back never leaves the
    task. `columns` maps each new column to its source. `bucket` must not be smaller than `max_gap`.
    """
    if bucket < max_gap:
        raise ValueError("a bucket must be at least as long as the gap")
    here = slot_of(F.col(order), bucket)
    reach = slot_of(F.col(order) + F.lit(max_gap), bucket)
    placed = df.withColumn("_home", here).withColumn("_bucket", F.explode(F.sequence("_home", reach)))
    w = Window.partitionBy(key, "_bucket").orderBy(order, *([tie] if tie else []))
    near = F.col(order) - F.lag(order).over(w) <= F.lit(max_gap)
    out = placed
    for new, source in columns.items():
        out = out.withColumn(new, F.when(near, F.lag(source).over(w)))
    return out.filter(F.col("_bucket") == F.col("_home")).drop("_bucket", "_home")


def asof_last(left: DataFrame, right: DataFrame, value: str, left_t: str = "t", right_t: str = "t",
              key: str = "video_id", tie: str | None = None, bucket_sec: float = 60.0,
              out: str = "last_value") -> DataFrame:
    """For each left row, the value of the last right row at or before it.

    Inside a bucket a window finds it; for a left row ahead of all right rows of its bucket, the answer is the last
    row of the nearest earlier bucket, taken from a summary with one row per bucket.
    """
    order_keys = [right_t] + ([tie] if tie else [])
    packed = right.select(
        F.col(key), F.col(right_t).cast("double").alias("_t"),
        slot_of(F.col(right_t), bucket_sec).alias("_bucket"),
        F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_keys)]).alias("_order"),
        F.struct(F.col(value).alias("v"), F.col(right_t).cast("double").alias("t")).alias("_value"))
    summary = packed.groupBy(key, "_bucket").agg(F.max_by("_value", "_order").alias("_last"))
    asked = left.withColumn("_bucket", slot_of(F.col(left_t), bucket_sec))
    wanted = asked.select(key, "_bucket").distinct()
    marks = summary.withColumn("_asked", F.lit(False)).unionByName(
        wanted.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    # The question of a bucket sorts ahead of that bucket's own summary.
    ahead = Window.partitionBy(key).orderBy("_bucket", F.col("_asked").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    carried = (
        marks.withColumn("_carry", F.last("_last", ignorenulls=True).over(ahead))
        .filter("_asked").select(key, "_bucket", "_carry")
    )
    left_cols = left.columns
    rows = asked.withColumn("_t", F.col(left_t).cast("double")).withColumn(
        "_row", F.struct(*[F.col(c) for c in left_cols]))
    both = packed.select(key, "_bucket", "_t", "_order", "_value").withColumn("_side", F.lit(0)).unionByName(
        rows.select(key, "_bucket", "_t", "_row").withColumn("_side", F.lit(1)), allowMissingColumns=True)
    inside = Window.partitionBy(key, "_bucket").orderBy("_t", "_side", "_order").rowsBetween(
        Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(inside)).filter("_side = 1")
    answered = found.join(carried, [key, "_bucket"], "left").withColumn(
        "_answer", F.coalesce("_found", "_carry"))
    return answered.select(
        *[F.col(f"_row.{c}").alias(c) for c in left_cols],
        F.col("_answer.v").alias(out), F.col("_answer.t").alias(f"{out}_t"))


def first_rows(df: DataFrame, key: str, order: list[str], limit: int | None, bucket: Column) -> DataFrame:
    """The first `limit` rows of each key in `order` (all of them without a limit), numbered from 1, exact for a key of
    any size.

    `bucket` must grow with the first order column. A count per bucket shows in which buckets the first rows lie; only
    rows of those buckets are sorted.
    """
    placed = df.withColumn("_bucket", bucket)
    counts = placed.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .filter(F.lit(True) if limit is None else F.col("_before") < limit).select(key, "_bucket", "_before")
    )
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    numbered = placed.withColumn("_nth", F.row_number().over(w))
    if limit is not None:  # no bucket gives more than the limit, which is known before its rows are shuffled
        numbered = numbered.filter(F.col("_nth") <= limit)
    placed = numbered.join(needed, [key, "_bucket"]).withColumn("row_no", F.col("_before") + F.col("_nth"))
    return (placed if limit is None else placed.filter(F.col("row_no") <= limit)).drop("_bucket", "_before", "_nth")
