"""Queries on text quality, emotion rules and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdpeak import fixed_values as fv
from crowdpeak.checks import views as v
from crowdpeak.checks.registry import query
from crowdpeak.checks.views import VECTORS, with_sql
from crowdpeak.functions import emotion, text
from crowdpeak.functions.numbers import clamp, decibels, normal_cdf, rounded, semitones, softmax

# The driver texts are invented words of four languages, so the word rules get lists of such words.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LATIN = text.TokenRules(syllable="[aeiou]", letter="[a-z]", slang="^[hxn]{2,}$", singles=["y", "à", "e", "a"])
CONTEXT = emotion.ContextRules(negative=["tionti", "heitung", "ouais"], positive=["anor", "chein", "ción"],
                               joy="ha|ei|la", sad="ou|ß", surprise=r"\?|!|zu")
GUARD = emotion.GuardRules(question=["the", "der", "que"], cheer="from", anger=["wh", "pf"], disgust=["ç", "ón"])


def strip_sql(value: str) -> str:
    return f"regexp_replace({value}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words_sql(value: str) -> str:
    return f"list_filter(string_split_regex({value}, '{SPACE}+'), lambda w: w <> '')"


def count_sql(value: str, pattern: str) -> str:
    return f"len(regexp_extract_all({value}, '{pattern}'))"


def any_sql(value: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({value}, '{n}')" for n in needles) + ")"


VALID_SQL = f"""CASE WHEN {count_sql('tok', '[aeiou]')} >= 2 THEN TRUE WHEN tok IN ('y', 'à', 'e', 'a') THEN TRUE
  WHEN regexp_matches(tok, '^[hxn]{{2,}}$') THEN TRUE WHEN regexp_matches(tok, '[a-z]') THEN FALSE END"""
TOKENS = f"""tokens AS (SELECT doc_id, unnest({words_sql('text')}) AS tok FROM documents)"""
LINES = f"""doc_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1
    AS line_no FROM documents),
line_tokens AS (SELECT doc_id, line_no, unnest({words_sql('line')}) AS tok FROM doc_lines),
line_quality AS (
  SELECT l.doc_id, l.line_no, l.line, coalesce(q.good, FALSE) AS good
  FROM doc_lines l LEFT JOIN (
    SELECT doc_id, line_no, count_if(valid) >= count(valid) * 0.5 AND count(valid) > 0 AS good
    FROM (SELECT doc_id, line_no, {VALID_SQL} AS valid FROM line_tokens) GROUP BY ALL) q USING (doc_id, line_no))"""


def _doc_lines(spark, path):
    return v.texts(spark, path, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("flt_1_legible_text", f"""
SELECT doc_id, line_no, {strip_sql('line')} AS line FROM (
  SELECT doc_id, line_no, line, (doc_id * 7 + line_no * 13) % 100 / 100.0::DOUBLE AS confidence FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents))
WHERE confidence >= 0.5 AND length({strip_sql('line')}) > 0 AND length(translate({strip_sql('line')}, '+-=;_~`|', '')) > 0""")
def legible_text(spark, path):
    confidence = (F.col("doc_id") * 7 + F.col("line_no") * 13) % 100 / 100.0
    kept = _doc_lines(spark, path).withColumn("line", text.legible_text(F.col("line"), confidence))
    return kept.filter("line IS NOT NULL").select("doc_id", "line_no", "line")


@query("flt_2_token_validity", with_sql(TOKENS, select=f"""
SELECT doc_id, count(*) AS tokens, count(*) FILTER (WHERE valid) AS valid,
  count(*) FILTER (WHERE NOT valid) AS invalid, count(*) FILTER (WHERE valid IS NULL) AS neutral
FROM (SELECT doc_id, {VALID_SQL} AS valid FROM tokens) GROUP BY doc_id"""))
def token_validity(spark, path):
    tokens = v.texts(spark, path, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("tok"))
    valid = tokens.withColumn("valid", text.token_validity(F.col("tok"), LATIN))
    return valid.groupBy("doc_id").agg(
        F.count("*").alias("tokens"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.col("valid").isNull()).alias("neutral"))


@query("flt_3_line_quality", with_sql(LINES, select="SELECT doc_id, line_no, good FROM line_quality"))
def line_quality(spark, path):
    return _doc_lines(spark, path).select("doc_id", "line_no", text.is_quality_line(F.col("line"), LATIN).alias("good"))


@query("flt_4_scene_text", with_sql(LINES, select="""
SELECT doc_id AS frame, string_agg(line, ' ' ORDER BY line_no) AS chat_text, count(*) AS n_lines
FROM line_quality WHERE good GROUP BY doc_id"""))
def scene_text(spark, path):
    good = _doc_lines(spark, path).filter(text.is_quality_line(F.col("line"), LATIN))
    scenes = good.select(F.col("doc_id").alias("frame"), F.col("line_no").alias("box_idx"), F.col("line").alias("text"))
    return text.scene_lines(scenes, ["frame"]).select("frame", "chat_text", F.size("lines").alias("n_lines"))


@query("flt_5_frame_sampling", """
SELECT l_orderkey AS video_id, frame, round(frame / 29.97::DOUBLE + 1e-9, 2) AS t FROM (
  SELECT l_orderkey, l_linenumber * 37 + l_partkey AS frame FROM lineitem)
WHERE frame % greatest(1, CAST(floor(29.97::DOUBLE * 5) AS BIGINT)) = 0""")
def frame_sampling(spark, path):
    from crowdpeak.operators.signals import sampled_frames

    frames = v.table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") * 37 + F.col("l_partkey")).alias("frame"))
    return sampled_frames(frames, F.lit(29.97))


@query("flt_8_platform", """
SELECT page_id, CASE WHEN contains(url, 'example.org') THEN 'org' WHEN contains(url, 'blog.') OR contains(url, '/fr/')
  THEN 'blog' END AS platform FROM pages""")
def platform(spark, path):
    hosts = [("org", ["example.org"]), ("blog", ["blog.", "/fr/"])]
    return v.table(spark, path, "pages").select("page_id", text.platform_of(F.col("url"), hosts).alias("platform"))


@query("flt_9_recording_id", """
SELECT page_id,
  CASE WHEN contains(host, 'spam-farm') THEN substr(path, 2)
    WHEN starts_with(path, '/en/') THEN split_part(path, '/', 3)
    ELSE nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') END AS share_id,
  nullif(regexp_extract(url, '/de/([0-9]+)', 1), '') AS number
FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def recording_id(spark, path):
    return v.table(spark, path, "pages").select(
        "page_id", text.share_link_id(F.col("url"), "spam-farm", "/en/", "page").alias("share_id"),
        text.recording_number(F.col("url"), "/de/").alias("number"))


# --- emotion rules --------------------------------------------------------------------------------

BOOST = f"""signs AS (
  SELECT doc_id, probs AS p, {any_sql('body', CONTEXT.negative)} AS neg, {any_sql('body', CONTEXT.positive)} AS pos,
    {count_sql('body', CONTEXT.joy)} AS joy, {count_sql('body', CONTEXT.sad)} AS sad,
    {count_sql('body', CONTEXT.surprise)} AS sur
  FROM (SELECT doc_id, probs, {strip_sql('chat_text')} AS body FROM vectors)),
rule_1 AS (
  SELECT *,
    CASE WHEN neg AND joy >= 1 THEN greatest(0.01, p[1] - 0.25)
      WHEN NOT neg AND (pos OR joy >= 2) THEN p[1] + least(0.5::DOUBLE, 0.15::DOUBLE * greatest(1, joy)) ELSE p[1] END AS p0,
    CASE WHEN neg AND joy >= 1 THEN p[2] + 0.105::DOUBLE ELSE p[2] END AS p1,
    CASE WHEN neg AND joy >= 1 THEN p[3] + 0.245::DOUBLE WHEN neg THEN p[3] + 0.4::DOUBLE ELSE p[3] END AS p2,
    CASE WHEN neg AND joy >= 1 THEN greatest(0.01, p[7] - 0.35) WHEN neg THEN greatest(0.01, p[7] - 0.4)
      WHEN pos OR joy >= 2 THEN greatest(0.01, p[7] - least(0.5::DOUBLE, 0.15::DOUBLE * greatest(1, joy)))
      ELSE p[7] END AS p6
  FROM signs),
rule_2 AS (
  SELECT * REPLACE (CASE WHEN NOT pos AND sad >= 2 THEN greatest(0.01, p6 - least(0.45::DOUBLE, 0.15::DOUBLE * sad))
      ELSE p6 END AS p6),
    CASE WHEN NOT pos AND sad >= 2 THEN p[4] + least(0.45::DOUBLE, 0.15::DOUBLE * sad) ELSE p[4] END AS p3
  FROM rule_1),
rule_3 AS (
  SELECT * REPLACE (CASE WHEN NOT neg AND sur >= 2 THEN greatest(0.01, p6 - least(0.4::DOUBLE, 0.15::DOUBLE * sur))
      ELSE p6 END AS p6,
    CASE WHEN NOT neg AND sur >= 2 THEN p1 + least(0.4::DOUBLE, 0.15::DOUBLE * sur) ELSE p1 END AS p1)
  FROM rule_2),
boosted AS (
  SELECT doc_id, list_transform(q, lambda x: x / list_sum(q)) AS b FROM (
    SELECT doc_id, list_transform([p0, p1, p2, p3, p[5], p[6], p6], lambda x: greatest(x, 0.001)) AS q FROM rule_3))"""


@query("emo_2_context_rules", with_sql(VECTORS, BOOST, select="SELECT doc_id, " + ", ".join(
    f"round(b[{i + 1}] + 1e-9, 6) AS p{i}" for i in range(7)) + " FROM boosted"))
def context_rules(spark, path):
    out = emotion.context_boost(v.vectors(spark, path), rules=CONTEXT)
    return out.select("doc_id", *[rounded(F.col("probs")[i], 6).alias(f"p{i}") for i in range(7)])


GUARDED = f"""messages AS (
  SELECT doc_id, line_no, {strip_sql('line')} AS body, probs FROM (
    SELECT doc_id, unnest(string_split(chat_text, chr(10))) AS line,
      generate_subscripts(string_split(chat_text, chr(10)), 1) - 1 AS line_no, probs FROM vectors)),
asked AS (
  SELECT *, CASE WHEN NOT regexp_matches(body, '[\\p{{L}}\\p{{N}}_]') AND contains(body, '?') THEN 'qm'
    WHEN NOT regexp_matches(body, '[\\p{{L}}\\p{{N}}_]') AND contains(body, '!') THEN 'em'
    WHEN contains(body, '?') AND {any_sql('body', GUARD.question)} THEN 'q'
    WHEN contains(body, '{GUARD.cheer}') AND NOT contains(body, '?') THEN 'cheer'
    WHEN {any_sql('body', GUARD.anger)} THEN 'anger' WHEN {any_sql('body', GUARD.disgust)} THEN 'disgust'
    ELSE 'none' END AS rule
  FROM messages WHERE length(body) > 0),
labelled_messages AS (
  SELECT *, CASE rule WHEN 'qm' THEN 1 WHEN 'em' THEN 0 WHEN 'q' THEN 1 WHEN 'cheer' THEN 0 WHEN 'anger' THEN 2
      WHEN 'disgust' THEN 4 ELSE list_position(probs, list_max(probs)) - 1 END AS idx,
    CASE rule WHEN 'qm' THEN [0.05::DOUBLE, 0.85, 0.02, 0.02, 0.02, 0.02, 0.02]
      WHEN 'em' THEN [0.85::DOUBLE, 0.05, 0.02, 0.02, 0.02, 0.02, 0.02]
      WHEN 'none' THEN probs
      ELSE list_transform(probs, lambda x, i: CASE
        WHEN i = CASE rule WHEN 'q' THEN 2 WHEN 'cheer' THEN 1 WHEN 'anger' THEN 3 ELSE 5 END
        THEN greatest(x, CASE rule WHEN 'q' THEN 0.75::DOUBLE WHEN 'cheer' THEN 0.85::DOUBLE ELSE 0.8::DOUBLE END)
        ELSE x END) END AS vec
  FROM asked)"""


@query("emo_3_guardrails", with_sql(VECTORS, GUARDED, select=f"""
SELECT doc_id, line_no, CAST(idx AS INTEGER) AS pred_label_idx, {fv.EMOTION_OFFICIAL_NAMES}[idx + 1] AS pred_label_name,
  round(vec[idx + 1] * 100 + 1e-9, 2) AS confidence, {", ".join(f"round(vec[{i + 1}] + 1e-9, 4) AS p{i}" for i in range(7))}
FROM labelled_messages"""))
def guarded(spark, path):
    rows = v.vectors(spark, path).select("doc_id", "probs", F.posexplode(F.split("chat_text", "\n")).alias("line_no", "chat_text"))
    out = emotion.guardrails(rows, rules=GUARD)
    return out.select("doc_id", "line_no", "pred_label_idx", "pred_label_name", "confidence",
                      *[F.col("all_probabilities")[i].alias(f"p{i}") for i in range(7)])


@query("emo_4_top_emotion", with_sql(VECTORS, BOOST, select=f"""
SELECT doc_id, {fv.EMOTIONS}[list_position(b, list_max(b))] AS top_emotion, """ + ", ".join(
    f"round(b[{i + 1}] * 100 + 1e-9, 2) AS {name}" for i, name in enumerate(fv.EMOTION_FIELDS)) + " FROM boosted"))
def top_emotion(spark, path):
    out = emotion.with_emotion_columns(emotion.context_boost(v.vectors(spark, path), rules=CONTEXT))
    return out.select("doc_id", "top_emotion", *fv.EMOTION_FIELDS)


@query("emo_5_softmax", """
SELECT vec_id, generate_subscripts(s, 1) - 1 AS i, round(unnest(s) + 1e-9, 6) AS p
FROM (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS s FROM (
  SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings))""")
def softmaxed(spark, path):
    s = v.table(spark, path, "embeddings").select("vec_id", F.posexplode(softmax(F.col("embedding"))).alias("i", "p"))
    return s.withColumn("p", rounded(F.col("p"), 6))


REPEAT_WORDS = f"""repeated AS (
  SELECT conv_id, turn, flatten(list_transform({words_sql('text')}, lambda w: [w FOR i IN range(0, 1 + length(w) % 6)]))
    AS ws FROM conversations),
keyed AS (
  SELECT conv_id, turn, ws, list_transform(ws, lambda w: CASE WHEN trim(w, '.,!?~…·''"()[]{{}}<>-:;') = '' THEN w
    ELSE trim(w, '.,!?~…·''"()[]{{}}<>-:;') END) AS ks FROM repeated)"""


@query("emo_6_collapse_repeats", with_sql(REPEAT_WORDS, """runs AS (
  SELECT conv_id, turn, i, ws[i] AS w, row_number() OVER (PARTITION BY conv_id, turn, ks[i], i - r ORDER BY i) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn, ks[i] ORDER BY i) AS r FROM (
      SELECT conv_id, turn, ws, ks, unnest(range(1, len(ws) + 1)) AS i FROM keyed)))""", select="""
SELECT conv_id, turn, coalesce(kept, '') AS collapsed FROM conversations LEFT JOIN (
  SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS kept FROM runs WHERE n <= 3 GROUP BY ALL) USING (conv_id, turn)"""))
def collapsed_repeats(spark, path):
    # Each word is said up to six times in a row, depending on its length.
    said = F.array_join(F.flatten(F.transform(
        text.words(F.col("text")), lambda w: F.array_repeat(w, (F.length(w) % 6 + 1).cast("int")))), " ")
    return v.texts(spark, path, "conversations").select(
        "conv_id", "turn", text.collapse_repeats(said).alias("collapsed"))


SAID = f"""lines AS (
  SELECT doc_id, probs, unnest(string_split(chat_text || chr(10), chr(10))) AS body,
    generate_subscripts(string_split(chat_text || chr(10), chr(10)), 1) - 1 AS line_no FROM vectors),
said AS (
  SELECT doc_id, line_no, flatten(list_transform({words_sql('body')}, lambda w: [w FOR i IN range(0, 1 + length(w) % 6)])) AS ws FROM lines),
spoken AS (SELECT doc_id, line_no, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM said),
bare AS (SELECT *, CASE WHEN trim(w, '.,!?~…·''"()[]{{}}<>-:;') = '' THEN w ELSE trim(w, '.,!?~…·''"()[]{{}}<>-:;') END AS key FROM spoken),
word_runs AS (
  SELECT doc_id, line_no, i, w, row_number() OVER (PARTITION BY doc_id, line_no, key, i - r ORDER BY i) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, key ORDER BY i) AS r FROM bare)),
shown AS (SELECT doc_id, line_no, string_agg(w, ' ' ORDER BY i) AS body FROM word_runs WHERE n <= 3 GROUP BY ALL)"""


@query("emo_7_speech_emotion", with_sql(VECTORS, SAID, select=f"""
SELECT doc_id, line_no, CASE WHEN silent THEN '평상' ELSE {fv.EMOTIONS}[list_position(probs, list_max(probs))] END
    AS streamer_speech_emotion,
  CASE WHEN silent THEN 0.0::DOUBLE ELSE round(probs[1] * 100 + 1e-9, 2) END AS streamer_joy_score,
  CASE WHEN silent THEN '(음성 발화 없음)' ELSE body END AS streamer_speech_text
FROM (SELECT l.doc_id, l.line_no, probs, s.body, s.body IS NULL AS silent FROM lines l LEFT JOIN shown s ON s.doc_id = l.doc_id AND s.line_no = l.line_no)"""))
def speech_emotion(spark, path):
    # A final empty line makes sure that silence occurs. Each word is said up to six times, with white space around the line.
    said = F.split(F.concat("chat_text", F.lit("\n")), "\n")
    rows = v.vectors(spark, path).select("doc_id", "probs", F.posexplode(said).alias("line_no", "text"))
    again = F.flatten(F.transform(text.words(F.col("text")), lambda w: F.array_repeat(w, (F.length(w) % 6 + 1).cast("int"))))
    rows = rows.withColumn("text", F.concat(F.lit(" \t"), F.array_join(again, "  "), F.lit(" ")))
    return emotion.speech_emotion(rows).drop("text", "probs")


@query("emo_8_label_lookup", f"""
SELECT event_id, CASE WHEN label = '중립' THEN '평상' ELSE label END AS name,
  CASE label {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(fv.EMOTIONS, fv.EMOTION_FIELDS))}
    WHEN '중립' THEN 'neutral_pct' END AS field,
  CASE label {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fv.EMOTION_COLORS.items())} ELSE '#6B6478' END AS color
FROM (SELECT event_id, {fv.EMOTIONS + [fv.LEGACY_NEUTRAL, '기타']}[event_id % 9 + 1] AS label FROM events)""")
def label_lookup(spark, path):
    names = F.array(*[F.lit(n) for n in fv.EMOTIONS + [fv.LEGACY_NEUTRAL, "기타"]])
    label = F.get(names, (F.col("event_id") % 9).cast("int"))
    return v.table(spark, path, "events").select("event_id", emotion.emotion_lookup(label).alias("e")).select(
        "event_id", "e.*")


# --- scalar functions -----------------------------------------------------------------------------

@query("fn_text_and_time", """
SELECT event_id, CAST(floor(x / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(x) AS BIGINT) % 60 AS VARCHAR), 2, '0')
    AS floored,
  CAST(floor(r / 60) AS BIGINT) || ':' || lpad(CAST(r % 60 AS VARCHAR), 2, '0') AS nearest,
  CASE WHEN h >= 3600 THEN CAST(floor(h / 3600) AS BIGINT) || ':' || lpad(CAST(CAST(floor(h % 3600 / 60) AS BIGINT)
      AS VARCHAR), 2, '0') || ':' || lpad(CAST(h % 60 AS VARCHAR), 2, '0')
    ELSE CAST(floor(h / 60) AS BIGINT) || ':' || lpad(CAST(h % 60 AS VARCHAR), 2, '0') END AS with_hours,
  CASE WHEN r >= 60 THEN CAST(floor(r / 60) AS BIGINT) || '분 ' || r % 60 || '초' ELSE r || '초' END AS elapsed,
  CASE WHEN m < 1 THEN '방금 전' WHEN m < 60 THEN m || '분 전' WHEN m < 1440 THEN CAST(floor(m / 60) AS BIGINT) || '시간 전'
    ELSE CAST(floor(m / 1440) AS BIGINT) || '일 전' END AS age
FROM (SELECT event_id, value AS x, CAST(floor(value + 0.5) AS BIGINT) AS r, CAST(floor(value * 20 + 0.5) AS BIGINT) AS h,
  CAST(floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 60000000) AS BIGINT) AS m FROM events)""")
def text_and_time(spark, path):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return v.table(spark, path, "events").select(
        "event_id", text.clock(F.col("value")).alias("floored"),
        text.clock(F.col("value"), rounding="nearest").alias("nearest"),
        text.clock(F.col("value") * 20, rounding="nearest", hours=True).alias("with_hours"),
        text.elapsed_text(F.floor(F.col("value") + 0.5)).alias("elapsed"),
        text.age_text(F.col("ts").cast("timestamp"), now).alias("age"))


@query("fn_job_id", """
SELECT event_id, 'wbb' || strftime(ts, '_%Y%m%d_%H%M%S') AS job_id, 'job' || strftime(ts, '_%Y%m%d_%H%M%S') AS other FROM events""")
def job_ids(spark, path):
    return v.table(spark, path, "events").select("event_id", text.job_id(F.col("ts")).alias("job_id"), text.job_id(F.col("ts"), "job").alias("other"))


@query("fn_shortened_text", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS shown FROM documents""")
def shortened_text(spark, path):
    return v.texts(spark, path, "documents").select("doc_id", text.shortened(F.col("text")).alias("shown"))


@query("fn_grades", """
SELECT event_id, CASE WHEN s >= 98 THEN '레전드 웃음' WHEN s >= 84 THEN '빵 터진 웃음' WHEN s >= 69 THEN '웃음 포인트'
  ELSE '잔잔한 웃음' END AS grade, CASE WHEN s >= 80 THEN 0 WHEN s >= 60 THEN 1 WHEN s >= 40 THEN 2 ELSE 3 END AS tier
FROM (SELECT event_id, floor(value + 0.5) AS s FROM events)""")
def grades(spark, path):
    return v.table(spark, path, "events").select(
        "event_id", text.grade(F.col("value")).alias("grade"), text.message_tier(F.col("value")).alias("tier"))


@query("fn_numbers", """
SELECT event_id, round(12 * log2(value / 100) + 1e-9, 6) AS semitones,
  round(greatest(-90.0::DOUBLE, 20 * log10(value / 32768)) + 1e-9, 6) AS db,
  round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (value - 20) / 60)) + 1e-9, 6) AS clamped,
  round(CASE WHEN z >= 0 THEN (1 + erf) / 2 ELSE (1 - erf) / 2 END + 1e-9, 6) AS phi
FROM (SELECT *, 1 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t
    - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x) AS erf
  FROM (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM (
    SELECT event_id, value, (value - 30) / 25 AS z, abs((value - 30) / 25) / sqrt(2.0::DOUBLE) AS x FROM events)))""")
def numbers(spark, path):
    value = F.col("value")
    return v.table(spark, path, "events").select(
        "event_id", rounded(semitones(value, F.lit(100.0)), 6).alias("semitones"),
        rounded(decibels(value / 32768), 6).alias("db"), rounded(clamp((value - 20) / 60), 6).alias("clamped"),
        rounded(normal_cdf((value - 30) / 25), 6).alias("phi"))
