"""Driver tables seen as recordings. Each view has a Spark form and a SQL form with the same integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


LENGTH = 3600.0


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def texts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of long texts."""
    return table(spark, path, name)


def micros_of_day():
    # Wall-clock parts, so that the session time zone does not matter.
    return (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("long") * 1_000_000 + (
        F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("long")


def chats(spark: SparkSession, path: str) -> DataFrame:
    """One recording per day of `events`, its 24 hours played in one."""
    e = table(spark, path, "events")
    out = e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("video_id"), (micros_of_day() / 24e6).alias("t"),
        F.col("value").alias("joy_pct"), F.col("event_type").alias("chat_text"), "event_id")
    for i, name in enumerate(["embarrass_pct", "anger_pct", "sadness_pct", "disgust_pct", "fear_pct", "neutral_pct"]):
        out = out.withColumn(name, (F.col("event_id") * (2 * i + 3) % (601 + 2 * i)) / 1.2)
    return out


CHATS = """chats AS (
  SELECT strftime(ts, '%Y-%m-%d') AS video_id,
    (CAST(epoch_us(ts) AS BIGINT) % 86400000000) / 24e6 AS t, value AS joy_pct, event_type AS chat_text, event_id,
    (event_id * 3 % 601) / 1.2::DOUBLE AS embarrass_pct, (event_id * 5 % 603) / 1.2::DOUBLE AS anger_pct,
    (event_id * 7 % 605) / 1.2::DOUBLE AS sadness_pct, (event_id * 9 % 607) / 1.2::DOUBLE AS disgust_pct,
    (event_id * 11 % 609) / 1.2::DOUBLE AS fear_pct, (event_id * 13 % 611) / 1.2::DOUBLE AS neutral_pct
  FROM events)"""


def stats(spark: SparkSession, path: str) -> DataFrame:
    """Recordings with their known length: the statistics of the chat, and 3600 seconds for all."""
    from crowdpeak.operators.grid import video_stats

    return video_stats(chats(spark, path)).withColumn("duration_sec", F.lit(LENGTH))


STATS = """stats AS (
  SELECT video_id, count(*) AS total_chats, 3600.0::DOUBLE AS duration_sec,
    round(avg(joy_pct) + 1e-9, 2) AS mean_joy, round(stddev_pop(joy_pct) + 1e-9, 2) AS std_joy,
    round(avg(joy_pct) + 0.5 * stddev_pop(joy_pct) + 1e-9, 2) AS calculated_threshold
  FROM chats GROUP BY video_id)"""

GRID = """grid AS (
  SELECT video_id, k, 5.0::DOUBLE * k AS start_sec, least(5.0::DOUBLE * k + 30, duration_sec) AS end_sec
  FROM stats, range(0, 100000) r(k)
  WHERE 5 * k + 30 <= duration_sec + 5 AND 5 * k < duration_sec)"""

WINDOWS = """windows AS (
  SELECT g.video_id, g.k, g.start_sec, g.end_sec, count(c.t) AS chat_count,
    coalesce(avg(c.joy_pct), 0.0::DOUBLE) AS avg_joy,
    coalesce(avg(c.joy_pct) * 0.7::DOUBLE + max(c.joy_pct) * 0.3::DOUBLE, 0.0::DOUBLE) AS chat_score
  FROM grid g LEFT JOIN chats c ON c.video_id = g.video_id AND c.t >= g.start_sec AND c.t <= g.end_sec
  GROUP BY ALL)"""


def voice(spark: SparkSession, path: str) -> DataFrame:
    """Per second of a recording that has events: whole-number mixes of the event ids of that second."""
    e = table(spark, path, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("video_id"), F.floor(micros_of_day() / 24e6).cast("int").alias("sec"),
        "event_id", "user_id")
    per = e.groupBy("video_id", "sec").agg(F.sum("event_id").alias("x"), F.sum("user_id").alias("u"))
    return per.select(
        "video_id", "sec", (F.lit(-90.0) + (F.col("x") * 37 + F.col("u") * 11) % 900 / 10.0).alias("rms_db"),
        F.when(F.col("u") % 7 != 0, F.lit(70.0) + F.col("x") * 53 % 4300 / 10.0).alias("f0_hz"),
        (F.col("x") * 29 % 100 / 50.0).alias("onset"))


VOICE = """voice AS (
  SELECT video_id, sec, -90.0::DOUBLE + (x * 37 + u * 11) % 900 / 10.0::DOUBLE AS rms_db,
    CASE WHEN u % 7 <> 0 THEN 70.0::DOUBLE + x * 53 % 4300 / 10.0::DOUBLE END AS f0_hz,
    x * 29 % 100 / 50.0::DOUBLE AS onset
  FROM (SELECT video_id, CAST(floor(t) AS INTEGER) AS sec, CAST(sum(event_id) AS BIGINT) AS x,
      CAST(sum(user_id) AS BIGINT) AS u
    FROM (SELECT strftime(ts, '%Y-%m-%d') AS video_id, (CAST(epoch_us(ts) AS BIGINT) % 86400000000) / 24e6 AS t,
        event_id, user_id FROM events)
    GROUP BY ALL))"""


def screen(spark: SparkSession, path: str) -> DataFrame:
    """Per 5-second scene of a recording that has events: a whole-number mix of the event ids of the scene."""
    e = table(spark, path, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("video_id"), F.floor(micros_of_day() / 120e6).cast("long").alias("i"),
        "event_id")
    return e.groupBy("video_id", "i").agg(F.sum("event_id").alias("x")).select(
        "video_id", (F.col("i") * 5.0).alias("t"), ((F.col("x") * 17 + F.col("i") * 5) % 256).cast("double").alias("value"))


SCREEN = """screen AS (
  SELECT video_id, i * 5.0::DOUBLE AS t, CAST((x * 17 + i * 5) % 256 AS DOUBLE) AS value
  FROM (SELECT video_id, i, CAST(sum(event_id) AS BIGINT) AS x FROM (
      SELECT strftime(ts, '%Y-%m-%d') AS video_id, CAST(floor((CAST(epoch_us(ts) AS BIGINT) % 86400000000) / 120e6)
        AS BIGINT) AS i, event_id FROM events) GROUP BY ALL))"""


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """Conversations as recordings: a turn is a scene, its lines are the chat lines."""
    return texts(spark, path, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), (F.col("turn") * 5.0).alias("t"),
        F.split("text", "\n").alias("lines"))


SCENES = """scenes AS (
  SELECT CAST(conv_id AS VARCHAR) AS video_id, turn * 5.0::DOUBLE AS t, string_split(text, chr(10)) AS lines
  FROM conversations)"""


def chat_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of the recordings of `chats`: the events of each 5 seconds as lines, a few distinct ones repeated often."""
    e = table(spark, path, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("video_id"), F.floor(micros_of_day() / 120e6).alias("i"), "event_id",
        F.concat_ws(" ", "event_type", (F.col("user_id") % 7).cast("string")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"])
    return e.groupBy("video_id", (F.col("i") * 5.0).alias("t")).agg(lines.alias("lines"))


CHAT_SCENES = """scenes AS (
  SELECT video_id, i * 5.0::DOUBLE AS t, list(line ORDER BY event_id) AS lines FROM (
    SELECT strftime(ts, '%Y-%m-%d') AS video_id, floor((CAST(epoch_us(ts) AS BIGINT) % 86400000000) / 120e6) AS i, event_id,
      event_type || ' ' || user_id % 7 AS line FROM events) GROUP BY ALL)"""


def raw_speech(spark: SparkSession, path: str) -> DataFrame:
    """What `speech` holds before it is judged: the words of the events of 5 seconds, and probabilities from the number in their properties."""
    e = table(spark, path, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("video_id"), F.floor(micros_of_day() / 120e6).alias("i"), "event_id",
        F.get_json_object("props", "$.k").cast("double").alias("k"), "event_type")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), " ")
    rows = e.groupBy("video_id", (F.col("i") * 5.0).alias("start_time")).agg(words.alias("said"), F.max("k").alias("k"))
    joy = F.col("k") / 100.0
    return rows.select("video_id", "start_time", F.concat(F.lit("  "), F.when(F.col("k") % 9 != 0, F.col("said")).otherwise("")).alias("text"),
                       F.array(joy, *[(1 - joy) * share / 21.0 for share in (1, 2, 3, 4, 5, 6)]).alias("probs"))


RAW_SPEECH = """uttered AS (
  SELECT video_id, start_time, string_agg(event_type, ' ' ORDER BY event_id) AS said, max(k) AS k FROM (
    SELECT strftime(ts, '%Y-%m-%d') AS video_id, floor((CAST(epoch_us(ts) AS BIGINT) % 86400000000) / 120e6) * 5.0::DOUBLE AS start_time,
      CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type, event_id FROM events) GROUP BY ALL),
uttered_words AS (SELECT video_id, start_time, unnest(string_split(said, ' ')) AS w, generate_subscripts(string_split(said, ' '), 1) AS i FROM uttered WHERE k % 9 <> 0),
uttered_runs AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, start_time, w, i - r ORDER BY i) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, start_time, w ORDER BY i) AS r FROM uttered_words)),
speech AS (
  SELECT u.video_id, u.start_time, coalesce(body, '(음성 발화 없음)') AS streamer_speech_text,
    CASE WHEN body IS NULL OR k / 100.0::DOUBLE < (1 - k / 100.0::DOUBLE) * 6 / 21.0::DOUBLE THEN '평상' ELSE '기쁨' END AS streamer_speech_emotion,
    CASE WHEN body IS NULL THEN 0.0::DOUBLE ELSE round(k / 100.0::DOUBLE * 100 + 1e-9, 2) END AS streamer_joy_score
  FROM uttered u LEFT JOIN (SELECT video_id, start_time, string_agg(w, ' ' ORDER BY i) AS body FROM uttered_runs WHERE n <= 3 GROUP BY ALL) s
    ON s.video_id = u.video_id AND s.start_time = u.start_time)"""


def scene_stats(spark: SparkSession, path: str) -> DataFrame:
    return scenes(spark, path).groupBy("video_id").agg((F.max("t") + 30.0).alias("duration_sec"))


SCENE_GRID = """scene_stats AS (SELECT video_id, max(t) + 30.0::DOUBLE AS duration_sec FROM scenes GROUP BY video_id),
scene_grid AS (
  SELECT video_id, k, 5.0::DOUBLE * k AS start_sec, least(5.0::DOUBLE * k + 30, duration_sec) AS end_sec
  FROM scene_stats, range(0, 100000) r(k)
  WHERE 5 * k + 30 <= duration_sec + 5 AND 5 * k < duration_sec)"""

NEW_LINES = """pairs AS (
  SELECT *, lag(t) OVER w AS prev_t, lag(lines) OVER w AS prev_all
  FROM scenes WINDOW w AS (PARTITION BY video_id ORDER BY t)),
previous AS (
  SELECT video_id, t, lines, prev_t, CASE WHEN t - prev_t <= 7.5 THEN prev_all ELSE [] END AS prev_lines FROM pairs),
lined AS (
  SELECT video_id, t, prev_lines, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM previous),
new_lines AS (
  SELECT video_id, t, line_no, line FROM lined
  WHERE len(list_filter(prev_lines, lambda p: CASE WHEN greatest(length(p), length(line)) = 0 THEN 1.0::DOUBLE
    ELSE 1 - levenshtein(line, p)::DOUBLE / greatest(length(p), length(line)) END >= 0.8::DOUBLE)) = 0)"""


def speech(spark: SparkSession, path: str) -> DataFrame:
    """What is said in the first 5 seconds of a window: the events there, joy from the number in their properties."""
    e = table(spark, path, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("video_id"), F.floor(micros_of_day() / 120e6).alias("i"),
        F.get_json_object("props", "$.k").cast("double").alias("joy"), "event_type")
    return e.groupBy("video_id", (F.col("i") * 5.0).alias("start_time")).agg(
        F.max("event_type").alias("streamer_speech_text"), F.max("joy").alias("streamer_joy_score")).withColumn(
        "streamer_speech_emotion", F.when(F.col("streamer_joy_score") >= 50, "joy").otherwise("calm"))


SPEECH = """speech AS (
  SELECT video_id, start_time, max(event_type) AS streamer_speech_text, max(joy) AS streamer_joy_score,
    CASE WHEN max(joy) >= 50 THEN 'joy' ELSE 'calm' END AS streamer_speech_emotion
  FROM (SELECT strftime(ts, '%Y-%m-%d') AS video_id,
      floor((CAST(epoch_us(ts) AS BIGINT) % 86400000000) / 120e6) * 5.0::DOUBLE AS start_time,
      CAST(json_extract_string(props, '$.k') AS DOUBLE) AS joy, event_type FROM events)
  GROUP BY ALL)"""


def boxes(spark: SparkSession, path: str) -> DataFrame:
    """Line items as text boxes: a supplier is a recording, a line number a frame."""
    li = table(spark, path, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("video_id"), F.col("l_linenumber").alias("frame"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box_idx"),
        F.round(F.col("l_discount") * 5, 4).alias("xmin"), F.round(F.col("l_tax") * 10, 4).alias("ymin"),
        F.round(F.col("l_discount") * 5 + F.col("l_quantity") / 100, 4).alias("xmax"),
        F.round(F.col("l_tax") * 10 + F.col("l_quantity") / 400, 4).alias("ymax"),
        F.col("l_returnflag").alias("text"))


BOXES = """boxes AS (
  SELECT l_suppkey AS video_id, l_linenumber AS frame, l_orderkey * 8 + l_linenumber AS box_idx,
    round(l_discount * 5, 4) AS xmin, round(l_tax * 10, 4) AS ymin, round(l_discount * 5 + l_quantity / 100, 4) AS xmax,
    round(l_tax * 10 + l_quantity / 400, 4) AS ymax, l_returnflag AS text
  FROM lineitem)"""


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """Orders as job events: a customer is a job, each of its orders an event."""
    o = table(spark, path, "orders")
    state = (
        F.when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 3 == 0, "cancelled").otherwise("queued"))
        .otherwise(F.when(F.col("o_orderkey") % 2 == 0, "analyzing").otherwise("failed"))
    )
    at = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.col("o_custkey").alias("video_id"), state.alias("status"),
        (F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * 100_000_000 + F.col("o_orderkey")).alias(
            "updated_at"),
        at.alias("day"), (F.col("o_custkey") % 4).cast("string").alias("host"), F.col("o_orderkey").alias("event_no"))


JOBS = """jobs AS (
  SELECT o_custkey AS video_id,
    CASE WHEN o_orderstatus = 'F' THEN 'done'
      WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'cancelled' ELSE 'queued' END
      WHEN o_orderkey % 2 = 0 THEN 'analyzing' ELSE 'failed' END AS status,
    date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 100000000 + o_orderkey AS updated_at,
    strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_custkey % 4 AS VARCHAR) AS host, o_orderkey AS event_no
  FROM orders)"""


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Documents with seven probabilities from the embedding of the same number, or even ones if there is none."""
    from crowdpeak.functions.numbers import softmax

    e = table(spark, path, "embeddings").select(
        F.col("vec_id").alias("doc_id"), softmax(F.slice("embedding", 1, 7)).alias("_p"))
    d = texts(spark, path, "documents").select("doc_id", F.col("text").alias("chat_text"))
    even = F.array(*[F.lit(1.0 / 7)] * 7)
    return d.join(e, "doc_id", "left").withColumn("probs", F.coalesce("_p", even)).drop("_p")


VECTORS = """vectors AS (
  SELECT d.doc_id, d.text AS chat_text, coalesce(p.probs, [1.0::DOUBLE / 7, 1.0::DOUBLE / 7, 1.0::DOUBLE / 7,
    1.0::DOUBLE / 7, 1.0::DOUBLE / 7, 1.0::DOUBLE / 7, 1.0::DOUBLE / 7]) AS probs
  FROM documents d LEFT JOIN (
    SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM (
      SELECT vec_id, list_transform(embedding[1:7], lambda x: exp(x::DOUBLE - list_max(embedding[1:7])::DOUBLE)) AS e
      FROM embeddings)) p ON p.vec_id = d.doc_id)"""


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a label of four classes, as text, some of them damaged."""
    d = table(spark, path, "documents").select("doc_id", F.col("text").alias("chat_message"))
    lab = table(spark, path, "labels")
    return d.join(lab, "doc_id", "left").select(
        "doc_id", "chat_message",
        F.when(F.col("doc_id") % 50 == 7, F.lit("."))
        .when(F.col("doc_id") % 50 == 9, F.lit("9"))
        .when(F.col("doc_id") % 50 == 11, F.concat((F.col("quality") + 2 * F.col("toxic")).cast("string"), F.lit(".0")))
        .otherwise((F.col("quality") + 2 * F.col("toxic")).cast("string")).alias("label"))


LABELLED = """labelled AS (
  SELECT d.doc_id, d.text AS chat_message,
    CASE d.doc_id % 50 WHEN 7 THEN '.' WHEN 9 THEN '9' WHEN 11 THEN CAST(quality + 2 * toxic AS VARCHAR) || '.0'
      ELSE CAST(quality + 2 * toxic AS VARCHAR) END AS label
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

CLEAN = """clean AS (
  SELECT doc_id, chat_message, CAST(trunc(TRY_CAST(label AS DOUBLE)) AS INTEGER) AS label FROM labelled
  WHERE chat_message IS NOT NULL AND TRY_CAST(label AS DOUBLE) IS NOT NULL
    AND trunc(TRY_CAST(label AS DOUBLE)) BETWEEN 0 AND 6)"""


def with_sql(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select
