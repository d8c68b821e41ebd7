"""Flattening of raw chat responses, and label files with differing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdpeak import fixed_values as fv
from crowdpeak.functions.text import strip
from crowdpeak.operators.buckets import first_rows
from crowdpeak.settings import Settings
from crowdpeak.sources.records import cell, csv_records

DEFAULT = Settings()

REPLAY_SCHEMA = (
    "continuationContents struct<liveChatContinuation: struct<actions: array<struct<replayChatItemAction: struct<"
    "videoOffsetTimeMsec: string, actions: array<struct<addChatItemAction: struct<item: struct<"
    "liveChatTextMessageRenderer: struct<message: struct<runs: array<struct<text: string>>>>>>>>>>>>>"
)
XML_SCHEMA = "chat array<struct<m: string, t: string>>"
MINUTE_MS = 60_000


def replay_messages(responses: DataFrame, body: str = "body", s: Settings = DEFAULT,
                    limit: int | None = None) -> DataFrame:
    """Chat messages `(video_id, time_ms, chat_message)` of replay responses `(video_id, page, body)` in JSON text.

    Text runs of a message are joined; empty messages and the opening minutes are left out; messages are
    numbered in the order they came. With a limit, only the first ones of each recording are kept.
    """
    parsed = responses.withColumn("_b", F.from_json(body, REPLAY_SCHEMA))
    actions = parsed.select(
        "video_id", "page", F.posexplode("_b.continuationContents.liveChatContinuation.actions").alias("a", "_a"))
    items = actions.select(
        "video_id", "page", "a", F.coalesce(F.col("_a.replayChatItemAction.videoOffsetTimeMsec").try_cast("long"),
                                            F.lit(0).cast("long")).alias("time_ms"),
        F.posexplode("_a.replayChatItemAction.actions").alias("i", "_i"))
    runs = F.col("_i.addChatItemAction.item.liveChatTextMessageRenderer.message.runs")
    message = strip(F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), ""))
    kept = items.withColumn("chat_message", message).filter(
        (F.col("time_ms") >= s.ingest_from_ms) & (F.length("chat_message") > 0)).drop("_i")
    # Pages follow each other in time, so a bucket of pages grows with the order of arrival.
    first = first_rows(kept, "video_id", ["page", "a", "i"], s.ingest_limit if limit is None else limit, F.col("page"))
    return first.select("video_id", "time_ms", "chat_message", "row_no")


def xml_messages(responses: DataFrame, body: str = "body", start_sec: str = "start_sec", s: Settings = DEFAULT,
                 limit: int | None = None) -> DataFrame:
    """Chat messages of XML responses `(video_id, page, start_sec, body)`.

    A message without a time gets the start of its page; a repeated (time, message) pair counts once.
    """
    parsed = responses.select("video_id", "page", F.col(start_sec).alias("_start"),
                              F.posexplode(F.from_xml(body, XML_SCHEMA)["chat"]).alias("i", "_c"))
    seconds = F.coalesce(F.col("_c.t").try_cast("double"), F.col("_start").cast("double"))
    rows = parsed.select("video_id", "page", "i", F.floor(seconds * 1000).cast("long").alias("time_ms"),
                         strip(F.coalesce(F.col("_c.m"), F.lit(""))).alias("chat_message"))
    unique = rows.filter(F.length("chat_message") > 0).groupBy("video_id", "time_ms", "chat_message").agg(
        F.min(F.struct("page", "i")).alias("_at")).withColumn("page", F.col("_at.page"))
    first = first_rows(unique, "video_id", ["_at"], s.ingest_limit if limit is None else limit, F.col("page"))
    return first.select("video_id", "time_ms", "chat_message", "row_no")


def unique_messages(chats: DataFrame) -> DataFrame:
    """Each (recording, time, message) once; copies are dropped in each task before they meet."""
    return chats.dropDuplicates(["video_id", "time_ms", "chat_message"])


def first_messages(chats: DataFrame, limit: int, s: Settings = DEFAULT, tie: str = "chat_message") -> DataFrame:
    """The first messages of each source by time."""
    return first_rows(chats, "video_id", ["time_ms", tie], limit, F.floor(F.col("time_ms") / MINUTE_MS).cast("long"))


def text_column(df: DataFrame) -> str:
    """Name of the column that holds text: a known name, else the first string column, else the first column."""
    for name in fv.TEXT_COLUMN_NAMES:
        if name in df.columns:
            return name
    for field in df.schema.fields:
        if field.dataType.simpleString() == "string":
            return field.name
    return df.columns[0]


def read_label_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of all CSV files that have the two needed columns, with their file; other files are skipped."""
    named = F.array_contains("header", "chat_message") & F.array_contains("header", "label")
    return csv_records(spark, paths).filter(named).select(cell("chat_message").alias("chat_message"), cell("label").alias("label"), "file")


def union_labels(tables: list[DataFrame]) -> DataFrame:
    """Union of label tables by column name; a table may lack optional columns."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
