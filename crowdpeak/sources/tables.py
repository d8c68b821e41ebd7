"""Readers and writers for recordings: chat, screen change, chat lines, emotion series, payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdpeak import fixed_values as fv
from crowdpeak.functions.text import seconds_or_zero
from crowdpeak.session import shared_folder
from crowdpeak.settings import Settings
from crowdpeak.sources.records import cell, cell_or, csv_records

DEFAULT = Settings()

# The recording a file belongs to is the directory or the file-name part in front of the known suffix.
VIDEO_FROM_PATH = r"([^/]+?)(?:_extracted_ocr_chats|_video_emotion_timeseries|_visual_change|_chat_lines)?\.[^./]+$"


def video_of(path: Column, pattern: str = VIDEO_FROM_PATH) -> Column:
    """The recording a file belongs to: its `video_id=...` folder, or else its name."""
    folder = F.regexp_extract(path, "/video_id=([^/]+)/", 1)  # a file read by its own name has no partition column
    return F.when(folder != "", F.url_decode(folder)).otherwise(F.regexp_extract(path, pattern, 1))


def with_video(raw: DataFrame, pattern: str = VIDEO_FROM_PATH) -> DataFrame:
    """Add `video_id` from the file name, unless the files lie in `video_id=...` folders."""
    if "video_id" in raw.columns:
        return raw.withColumn("video_id", F.col("video_id").cast("string"))
    return raw.withColumn("video_id", video_of(F.col("_metadata.file_path"), pattern))


def read_chat_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Chat rows `(video_id, t, frame, chat_text)` from CSV files, each with its own header, with or without a byte order mark.

    Time and text are the columns of the known names, or else the first and the last column of the file.
    """
    return csv_records(spark, paths).select(
        video_of(F.col("file")).alias("video_id"), seconds_or_zero(cell_or("timestamp", F.lit(0))).alias("t"),
        cell("frame").try_cast("double").try_cast("int").alias("frame"),
        cell_or("chat_text", F.size("header") - 1).alias("chat_text"))


def series_tables(raw: DataFrame, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Stats and points of series documents `(video_id, doc)`, each document a variant.

    Threshold and length fall back to older keys, then to the points, then to constants. Points are taken out of the
    variant one by one, so that a day-long series is never a row of structs; `point` keeps each one with the keys that have
    no column of their own.
    """
    def field(path: str, kind: str = "double", of: str = "doc") -> Column:
        return F.try_variant_get(F.col(of), path, kind)

    last = F.array_max(F.transform(field("$.time_series_data", "array<variant>"), lambda p: F.try_variant_get(p, "$.timestamp", "double")))
    duration = F.coalesce(field("$.video_metadata.duration_sec"), last + s.duration_margin_sec)
    stats = raw.select(
        "video_id",
        F.coalesce(field("$.adaptive_threshold_stats.calculated_threshold"), field("$.recommended_joy_threshold"),
                   F.lit(s.default_threshold)).alias("calculated_threshold"),
        F.when(duration != 0, duration).otherwise(F.lit(s.default_duration_sec)).alias("duration_sec"),
        F.coalesce(F.size(field("$.time_series_data", "array<variant>")), F.lit(0)).alias("total_chats"))
    listed = raw.withColumn("_series", field("$.time_series_data", "variant"))
    each = listed.lateralJoin(raw.sparkSession.tvf.variant_explode(F.col("_series").outer()))
    points = each.select(
        "video_id", field("$.timestamp", of="value").alias("t"), field("$.chat_text", "string", "value").alias("chat_text"),
        field("$.top_emotion", "string", "value").alias("top_emotion"),
        *[field(f"$.{f}", of="value").alias(f) for f in fv.EMOTION_FIELDS], F.col("value").alias("point"))
    return stats, current_emotions(points)


def in_rounds(folders: list[tuple[str, int]], most: int = 20_000) -> list[list[str]]:
    """Folders, given with their number of files, in lists that hold at most `most` files (or one folder)."""
    out, held = [], 0
    for folder, files in folders:
        if not out or held + files > most:
            out, held = [*out, []], 0
        out[-1].append(folder)
        held += files
    return out


def read_series_json(spark: SparkSession, paths: str | list[str] | list[list[str]], one_per_file: bool = True, s: Settings = DEFAULT):
    """Stats and points of series documents: one indented document per file, or one `video_id` document per line.

    The driver holds every file of a read in memory. So very many files of one document are given as lists of paths
    (`in_rounds`): these are read one list after the other, by a task for each path, and their documents are kept in the
    shared folder.
    """
    read = spark.read.option("singleVariantColumn", "doc")
    if not one_per_file:
        return series_tables(read.json(paths).select(F.try_variant_get("doc", "$.video_id", "string").alias("video_id"), "doc"), s)

    def whole(some: str | list[str]) -> DataFrame:
        return with_video(read.json(some, multiLine=True)).select("video_id", "doc")

    if isinstance(paths, str) or isinstance(paths[0], str):
        return series_tables(whole(paths), s)
    kept = f"{shared_folder(spark)}/crowdpeak_series_docs_{uuid.uuid4().hex}"
    # Otherwise Spark holds up to 250 MB of file names on the driver after the reads.
    key = "spark.sql.hive.manageFilesourcePartitions"
    before = spark.conf.get(key)
    for some in paths:
        spark.conf.set(key, "false")
        try:
            docs = whole(some)
        finally:
            spark.conf.set(key, before)
        docs.coalesce(len(some)).write.mode("append").parquet(kept)
    return series_tables(spark.read.schema("video_id string, doc variant").parquet(kept), s)


def current_emotions(points: DataFrame) -> DataFrame:
    """Bring series of an older label set to the current one: missing percent columns are 0.0, the neutral label is
    renamed, and columns of labels that no longer exist are dropped."""
    out = points
    for name in fv.EMOTION_FIELDS:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in points.columns else F.lit(0.0)
        out = out.withColumn(name, value)
    known = {"joy_pct", *fv.EMOTION_FIELDS}
    out = out.drop(*[c for c in points.columns if c.endswith("_pct") and c not in known])
    if "top_emotion" not in out.columns:
        return out
    return out.withColumn("top_emotion", F.when(
        F.col("top_emotion") == fv.LEGACY_NEUTRAL, F.lit(fv.NEUTRAL)).otherwise(F.col("top_emotion")))


def read_screen_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Screen change samples `(video_id, t, value)`; a recording without rows has the signal switched off."""
    return csv_records(spark, paths).select(
        video_of(F.col("file")).alias("video_id"), cell("timestamp").try_cast("double").alias("t"),
        cell("value").try_cast("double").alias("value")).filter("t IS NOT NULL AND value IS NOT NULL")


def signal_flags(videos: DataFrame, signals: dict[str, DataFrame]) -> DataFrame:
    """Which optional signals each recording has: one boolean column per entry of `signals`."""
    out = videos.select("video_id")
    for name, table in signals.items():
        present = table.select("video_id").distinct().withColumn(name, F.lit(True))
        out = out.join(present, "video_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def read_lines_jsonl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Scenes `(video_id, t, lines)`; lines without a `video_id` of their own take that of their file."""
    raw = spark.read.schema("video_id string, t double, lines array<string>").json(paths)
    of_file = F.regexp_extract(F.col("_metadata.file_path"), VIDEO_FROM_PATH, 1)
    return raw.select(F.coalesce("video_id", of_file).alias("video_id"), "t", "lines")


def write_lines_jsonl(scenes: DataFrame, path: str) -> None:
    """One scene per line, with its recording as a field: as many files as tasks, however many recordings there are."""
    scenes.select("video_id", "t", "lines").write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a table for the next stage; a CSV of a table without rows still has its header."""
    writer = df.write.mode("overwrite").partitionBy(*(partition_by or []))
    if kind == "csv":
        writer.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False,
                   ignoreTrailingWhiteSpace=False)
    else:
        writer.format(kind).save(path)


def payloads(items: DataFrame, metadata: DataFrame, items_name: str) -> DataFrame:
    """One document per recording: `metadata` as a struct and the items in time order as an array.

    A recording has at most a few dozen items, so the array is small.
    """
    fields = [c for c in items.columns if c != "video_id"]
    lists = items.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(
        "start_time", F.struct(*fields).alias("item")))).alias("_l")).select(
        "video_id", F.transform("_l", lambda e: e["item"]).alias(items_name))
    meta = metadata.select("video_id", F.struct(*[c for c in metadata.columns if c != "video_id"]).alias("metadata"))
    joined = meta.join(lists, "video_id", "left")
    return joined.withColumn(items_name, F.coalesce(items_name, F.array().cast(joined.schema[items_name].dataType)))
