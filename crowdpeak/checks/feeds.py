"""Queries that write driver tables in the formats of the sources and read them back, and flatten raw responses."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdpeak.checks import views as v
from crowdpeak.checks.intervals import HIGHLIGHTS, highlights, stage_1
from crowdpeak.checks.registry import query
from crowdpeak.checks.texts import strip_sql
from crowdpeak.checks.views import CHATS, SCENES, SCREEN, with_sql
from crowdpeak.functions.numbers import rounded
from crowdpeak.session import shared_folder
from crowdpeak.sources import ingest, tables


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/crowdpeak_{name}_{uuid.uuid4().hex}"


@query("src_1_chat_csv", with_sql(CHATS, select="""
SELECT video_id, round(CASE WHEN event_id % 11 = 3 THEN 0.0::DOUBLE ELSE t END + 1e-9, 6) AS t, CAST(event_id AS INTEGER) AS frame,
  chat_text || chr(10) || '"' || video_id || '", ' AS chat_text FROM chats"""))
def chat_csv(spark, path):
    folder = fresh(spark, "chat_csv")
    # Some times are not plain numbers and become 0.0; the text has quotes, commas and line breaks.
    rows = v.chats(spark, path).select(
        "video_id", F.when(F.col("event_id") % 11 == 3, F.concat(F.lit("-"), F.col("t").cast("string"))).otherwise(
            F.col("t").cast("decimal(20,12)").cast("string")).alias("timestamp"),
        F.col("event_id").alias("frame"), F.concat("chat_text", F.lit('\n"'), "video_id", F.lit('", ')).alias("chat_text"))
    tables.write_table(rows, folder, "csv", ["video_id"])
    out = tables.read_chat_csv(spark, folder)
    return out.withColumn("t", rounded(F.col("t"), 6)).select("video_id", "t", "frame", "chat_text")


SERIES_DOCS = """docs AS (
  SELECT CAST(conv_id * 8 + turn AS VARCHAR) AS video_id, conv_id % 3 AS kind, conv_id % 2 AS timed, turn,
    string_split(text, chr(10)) AS lines FROM conversations)"""


def _series_docs(spark, path):
    c = v.table(spark, path, "conversations").withColumn("lines", F.split("text", "\n"))
    score = F.round(F.col("conv_id") / 7 + F.col("turn"), 2)
    points = F.transform("lines", lambda line, i: F.struct(
        (F.col("turn") * 5.0 + i).alias("timestamp"), line.alias("chat_text"), F.lit("중립").alias("top_emotion"),
        (F.length(line) % 100).cast("double").alias("joy_pct"), F.lit(1.5).alias("embarrass_pct"),
        F.lit(2.5).alias("anxiety_pct"), F.lit(3.5).alias("neutral_pct")))
    return c.select(
        (F.col("conv_id") * 8 + F.col("turn")).cast("string").alias("video_id"),
        F.when(F.col("conv_id") % 3 == 0, F.struct(score.alias("calculated_threshold"))).alias("adaptive_threshold_stats"),
        F.when(F.col("conv_id") % 3 == 1, score + 1).alias("recommended_joy_threshold"),
        F.when(F.col("conv_id") % 2 == 0, F.struct((F.col("turn") * 100.0).alias("duration_sec"))).alias("video_metadata"),
        points.alias("time_series_data"))


def _series(spark, path):
    folder = fresh(spark, "series")
    tables.write_table(_series_docs(spark, path), folder, "json")
    return tables.read_series_json(spark, folder, one_per_file=False)


@query("src_2_series_json", with_sql("""docs AS (
  SELECT conv_id, turn, len(string_split(text, chr(10))) AS n FROM conversations)""", select="""
SELECT CAST(conv_id * 8 + turn AS VARCHAR) AS video_id,
  CASE conv_id % 3 WHEN 0 THEN round(conv_id / 7 + turn, 2) WHEN 1 THEN round(conv_id / 7 + turn, 2) + 1 ELSE 8.0::DOUBLE END
    AS calculated_threshold,
  CASE WHEN conv_id % 2 = 0 THEN CASE WHEN turn = 0 THEN 65.0::DOUBLE ELSE turn * 100.0::DOUBLE END
    ELSE turn * 5.0::DOUBLE + n - 1 + 30 END AS duration_sec, n AS total_chats FROM docs"""))
def series_json(spark, path):
    return _series(spark, path)[0]


@query("src_11_older_series", with_sql("""docs AS (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations)""", select="""
SELECT CAST(conv_id * 8 + turn AS VARCHAR) AS video_id, turn * 5.0::DOUBLE + i AS t, line AS chat_text,
  '평상' AS top_emotion, CAST(length(line) % 100 AS DOUBLE) AS joy_pct, 1.5::DOUBLE AS embarrass_pct,
  0.0::DOUBLE AS anger_pct, 0.0::DOUBLE AS sadness_pct, 0.0::DOUBLE AS disgust_pct, 0.0::DOUBLE AS fear_pct,
  3.5::DOUBLE AS neutral_pct FROM docs"""))
def older_series(spark, path):
    return _series(spark, path)[1].drop("point")


def write_one_each(docs: DataFrame, folder: str, most: int | None = None) -> list[tuple[str, int]]:
    """A file `<video_id>.json` for each recording of `docs(video_id, value)`; a null id names no recording.

    Tasks write these small files themselves, through a file system that pyarrow knows. A task that runs again writes the
    same files again. They lie in `folder`, or with `most` in folders in it that hold at most so many files each. Returned
    are the folders and how many files were put there."""
    place = re.sub("^file:/+", "/", folder)
    filesystem, base = fs.FileSystem.from_uri(place)
    filesystem.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, root = fs.FileSystem.from_uri(place)
        task, part = TaskContext.get().partitionId(), ""
        values = ((name, value) for batch in batches for name, value in zip(*(c.to_pylist() for c in batch.columns)))
        for i, (name, same) in enumerate(itertools.groupby(values, key=lambda x: x[0])):
            if most and i % most == 0:
                part = f"/{task:05d}-{i // most:05d}"
                into.create_dir(root + part)
            with into.open_output_stream(f"{root}{part}/{name}.json") as out:
                for _, value in same:
                    out.write(f"{value}\n\n".encode())
            yield pa.record_batch({"part": pa.array([part]), "files": pa.array([1], pa.int64())})

    # The number of parts is given, so that Spark does not join small ones into one task that makes all files.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = docs.filter("video_id IS NOT NULL").repartition(parts, "video_id").sortWithinPartitions("video_id").mapInArrow(
        write, "part string, files long").groupBy("part").agg(F.sum("files").alias("files")).collect()
    return sorted((folder + r.part, r.files) for r in made) or [(folder, 0)]


@query("src_2_both_forms", """
SELECT kind, video_id, t, chat_text, joy_pct, anxiety_pct, calculated_threshold, total_chats FROM (
  SELECT CAST(conv_id * 8 + turn AS VARCHAR) AS video_id, turn * 5.0::DOUBLE + i AS t, line AS chat_text,
    CAST(length(line) % 100 AS DOUBLE) AS joy_pct, 2.5::DOUBLE AS anxiety_pct, n AS total_chats,
    CASE conv_id % 3 WHEN 0 THEN round(conv_id / 7 + turn, 2) WHEN 1 THEN round(conv_id / 7 + turn, 2) + 1 ELSE 8.0::DOUBLE END AS calculated_threshold
  FROM (SELECT conv_id, turn, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations)), (VALUES ('file'), ('line')) k(kind)""")
def both_forms(spark, path):
    # The same documents once a file each, over several lines, and once a line each. A key without a column survives.
    docs, folder = _series_docs(spark, path), fresh(spark, "series_files")
    body = F.to_json(F.struct(*[c for c in docs.columns if c != "video_id"]), {"pretty": "true"})
    files = tables.in_rounds(write_one_each(docs.select("video_id", body.alias("value")), folder, most=500))
    lines = fresh(spark, "series_lines")
    tables.write_table(docs, lines, "json")
    out = None
    for kind, (stats, points) in {"file": tables.read_series_json(spark, files), "line": tables.read_series_json(spark, lines, one_per_file=False)}.items():
        one = points.withColumn("anxiety_pct", F.try_variant_get("point", "$.anxiety_pct", "double")).join(stats, "video_id").select(
            F.lit(kind).alias("kind"), "video_id", "t", "chat_text", "joy_pct", "anxiety_pct", "calculated_threshold", "total_chats")
        out = one if out is None else out.unionByName(one)
    return out


@query("src_3_screen_csv", with_sql(CHATS, SCREEN, """listed AS (
  SELECT DISTINCT video_id FROM chats UNION ALL SELECT DISTINCT 'conv ' || conv_id FROM conversations)""", select="""
SELECT c.video_id, s.video_id IS NOT NULL AS has_screen, t, value FROM listed c LEFT JOIN screen s ON s.video_id = c.video_id"""))
def screen_csv(spark, path):
    # Conversations are recordings that the screen table does not have.
    folder = fresh(spark, "screen")
    tables.write_table(v.screen(spark, path).select("video_id", F.col("t").alias("timestamp"), "value"), folder, "csv", ["video_id"])
    screen = tables.read_screen_csv(spark, folder)
    others = v.table(spark, path, "conversations").select(F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("video_id"))
    listed = v.stats(spark, path).select("video_id").unionByName(others.distinct())
    return tables.signal_flags(listed, {"has_screen": screen}).join(screen, "video_id", "left").select("video_id", "has_screen", "t", "value")


@query("src_4_chat_lines", with_sql(SCENES, select="""
SELECT video_id, t, len(lines) AS n_lines, array_to_string(lines, '|') AS joined FROM scenes"""))
def chat_lines(spark, path):
    folder = fresh(spark, "lines")
    tables.write_lines_jsonl(v.scenes(spark, path), folder)
    return tables.read_lines_jsonl(spark, folder).select(
        "video_id", "t", F.size("lines").alias("n_lines"), F.array_join("lines", "|").alias("joined"))


@query("src_5_write_series", with_sql(CHATS, select="""
SELECT kind, video_id, round(t + 1e-9, 6) AS t, chat_text, joy_pct FROM chats, (VALUES ('csv'), ('json')) k(kind)"""))
def write_series(spark, path):
    series = v.chats(spark, path).select("video_id", F.col("t").alias("timestamp"), "chat_text", "joy_pct")
    csv, json = fresh(spark, "series_csv"), fresh(spark, "series_json")
    tables.write_table(series, csv, "csv")
    tables.write_table(series, json, "json")
    a = spark.read.csv(csv, header=True, schema="video_id string, timestamp double, chat_text string, joy_pct double")
    both = a.withColumn("kind", F.lit("csv")).unionByName(spark.read.json(json, schema=series.schema).withColumn("kind", F.lit("json")))
    return both.select("kind", "video_id", rounded(F.col("timestamp"), 6).alias("t"), "chat_text", "joy_pct")


@query("src_6_payloads", with_sql(*HIGHLIGHTS, recursive=True, select="""
SELECT s.video_id, s.calculated_threshold AS applied_threshold, count(h.rank) AS total_highlights_count,
  string_agg(CAST(CAST(h.start_time AS INTEGER) AS VARCHAR), ',' ORDER BY h.start_time) AS starts
FROM stats s LEFT JOIN highlights h ON h.video_id = s.video_id GROUP BY ALL"""))
def payloads(spark, path):
    found, stats = highlights(spark, path), v.stats(spark, path)
    meta = stats.select("video_id", F.col("calculated_threshold").alias("applied_threshold")).join(
        found.groupBy("video_id").agg(F.count("*").alias("total_highlights_count")), "video_id", "left")
    folder = fresh(spark, "payload")
    tables.write_table(tables.payloads(found, meta, "highlights"), folder, "json")
    back = spark.read.json(folder, schema="video_id string, metadata struct<applied_threshold double, "
                           "total_highlights_count long>, highlights array<struct<start_time double, rank int>>")
    return back.select("video_id", "metadata.*", F.array_join(F.transform(
        "highlights", lambda h: h["start_time"].cast("int").cast("string")), ",").alias("starts"))


@query("src_6_candidate_payload", with_sql(*HIGHLIGHTS[:7], select="""
SELECT s.video_id, s.duration_sec AS source_video_duration, s.calculated_threshold AS applied_threshold, count(c.start_time) AS total_candidates,
  coalesce(string_agg(CAST(CAST(c.start_time AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(c.end_time AS INTEGER) AS VARCHAR) || ':'
    || c.chat_count || ':' || CAST(CAST(round(c.window_score * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY c.start_time), '') AS clips
FROM stats s LEFT JOIN stage_1 c ON c.video_id = s.video_id GROUP BY ALL"""))
def candidate_payload(spark, path):
    found, stats = stage_1(spark, path), v.stats(spark, path)
    meta = stats.select("video_id", F.col("duration_sec").alias("source_video_duration"), F.col("calculated_threshold").alias("applied_threshold")).join(
        found.groupBy("video_id").agg(F.count("*").alias("total_candidates")), "video_id", "left").fillna(0, ["total_candidates"])
    folder = fresh(spark, "candidate_payload")
    tables.write_table(tables.payloads(found, meta, "candidate_clips"), folder, "json")
    back = spark.read.json(folder, schema="video_id string, metadata struct<source_video_duration double, applied_threshold double, total_candidates long>, "
                           "candidate_clips array<struct<start_time double, end_time double, chat_count long, window_score double>>")
    whole = lambda c: c.cast("int").cast("string")
    return back.select("video_id", "metadata.*", F.array_join(F.transform("candidate_clips", lambda c: F.concat(
        whole(c["start_time"]), F.lit("-"), whole(c["end_time"]), F.lit(":"), c["chat_count"].cast("string"), F.lit(":"),
        F.round(c["window_score"] * 100).cast("long").cast("string"))), ",").alias("clips"))


@query("src_7_label_files", """
SELECT chat_message, label FROM (SELECT text AS chat_message, CAST(quality AS VARCHAR) AS label FROM documents
  JOIN labels USING (doc_id) UNION ALL SELECT text, role FROM conversations)""")
def label_files(spark, path):
    folder = fresh(spark, "labels")
    docs = v.table(spark, path, "documents").join(v.table(spark, path, "labels"), "doc_id")
    kinds = {
        "a": docs.select(F.col("text").alias("chat_message"), F.col("quality").alias("label"), "doc_id"),
        "b": v.table(spark, path, "conversations").select(F.col("role").alias("label"), F.col("text").alias("chat_message")),
        "c": v.table(spark, path, "benchmark"),
    }
    for kind, table in kinds.items():
        tables.write_table(table, f"{folder}/{kind}", "csv")
    return ingest.read_label_files(spark, f"{folder}/*/*.csv").select("chat_message", "label")


@query("src_8_replay_json", f"""
SELECT video_id, time_ms, chat_message, row_no FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY turn, i) AS row_no FROM (
    SELECT CAST(conv_id AS VARCHAR) AS video_id, turn, turn * 60000 AS time_ms, {strip_sql('line')} AS chat_message, i
    FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations))
  WHERE time_ms >= 180000 AND length(chat_message) > 0)""")
def replay_json(spark, path):
    # One response per turn; each line is a message whose words are its text runs.
    item = lambda line: F.struct(F.struct(F.struct(F.struct(F.struct(F.transform(
        F.split(line, " "), lambda w: F.struct(F.concat(w, F.lit(" ")).alias("text"))).alias("runs")).alias("message")).alias(
        "liveChatTextMessageRenderer")).alias("item")).alias("addChatItemAction"))
    action = F.struct(F.struct(
        (F.col("turn") * 60_000).cast("string").alias("videoOffsetTimeMsec"),
        F.transform(F.split("text", "\n"), item).alias("actions")).alias("replayChatItemAction"))
    body = F.to_json(F.struct(F.struct(F.struct(F.array(action).alias("actions")).alias(
        "liveChatContinuation")).alias("continuationContents")))
    responses = v.table(spark, path, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("page"), body.alias("body"))
    return ingest.replay_messages(responses)


@query("src_9_chat_xml", f"""
SELECT video_id, time_ms, chat_message, row_no FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY turn, i) AS row_no FROM (
    SELECT video_id, time_ms, chat_message, min(turn) AS turn, min(i) AS i FROM (
      SELECT CAST(conv_id AS VARCHAR) AS video_id, turn, turn * 5500 AS time_ms, {strip_sql('piece')} AS chat_message, i
      FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS piece,
        generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations))
    WHERE length(chat_message) > 0 GROUP BY video_id, time_ms, chat_message))""")
def chat_xml(spark, path):
    # One response per turn; each word is a message, so repeats are common. Every other word has no time of its own.
    def node(word, i):
        safe = F.replace(F.replace(word, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        time = F.when(i % 2 == 0, F.concat(F.lit("<t>"), (F.col("turn") * 5.5).cast("string"), F.lit("</t>"))).otherwise("")
        return F.concat(F.lit("<chat><m>"), safe, F.lit("</m>"), time, F.lit("</chat>"))

    body = F.concat(F.lit("<chats>"), F.array_join(F.transform(F.split("text", " "), node), ""), F.lit("</chats>"))
    responses = v.table(spark, path, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("page"),
        (F.col("turn") * 5.5).alias("start_sec"), body.alias("body"))
    return ingest.xml_messages(responses)


@query("src_10_text_column", """
SELECT 'documents' AS source, 'text' AS found, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents
UNION ALL SELECT 'events', 'event_type', CAST(sum(length(event_type)) AS BIGINT) FROM events
UNION ALL SELECT 'lineitem', 'l_returnflag', CAST(sum(length(l_returnflag)) AS BIGINT) FROM lineitem
UNION ALL SELECT 'labels', 'doc_id', CAST(sum(length(CAST(doc_id AS VARCHAR))) AS BIGINT) FROM labels""")
def text_column(spark, path):
    out = None
    for name in ("documents", "events", "lineitem", "labels"):
        table = v.table(spark, path, name)
        found = ingest.text_column(table)
        one = table.agg(F.sum(F.length(F.col(found).cast("string"))).alias("chars")).select(
            F.lit(name).alias("source"), F.lit(found).alias("found"), "chars")
        out = one if out is None else out.unionByName(one)
    return out


@query("top_8_first_messages", with_sql(CHATS, select="""
SELECT video_id, time_ms, event_id, row_no FROM (SELECT video_id, time_ms, event_id,
  row_number() OVER (PARTITION BY video_id ORDER BY time_ms, event_id) AS row_no
  FROM (SELECT video_id, CAST(floor(t * 1000) AS BIGINT) AS time_ms, event_id FROM chats)) WHERE row_no <= 100"""))
def first_messages(spark, path):
    chats = v.chats(spark, path).select("video_id", F.floor(F.col("t") * 1000).cast("long").alias("time_ms"), "event_id")
    return ingest.first_messages(chats, 100, tie="event_id")
