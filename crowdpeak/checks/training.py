"""Queries on the training set and the classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdpeak.checks import views as v
from crowdpeak.checks.registry import query
from crowdpeak.checks.texts import strip_sql
from crowdpeak.checks.views import CLEAN, LABELLED, with_sql
from crowdpeak.functions.numbers import rounded
from crowdpeak.operators import bayes, dataset
from crowdpeak.session import cut_lineage
from crowdpeak.settings import Settings
from crowdpeak.sources import ingest

# The labelled documents have four small classes; one of them takes the part of the class that is left alone.
SMALL = Settings(oversample_to=200)

SPLIT = """keyed AS (
  SELECT *, CAST('0x' || substr(md5(doc_id || ':42'), 1, 8) AS BIGINT) % 2147483648 AS key FROM clean),
sizes AS (SELECT label, count(*) AS size FROM keyed GROUP BY label),
parts AS (
  SELECT label, floor(round(size * 0.2::DOUBLE, 6)) AS whole,
    row_number() OVER (ORDER BY round(round(size * 0.2::DOUBLE, 6) - floor(round(size * 0.2::DOUBLE, 6)), 6) DESC, label)
      AS turn,
    ceil(sum(size) OVER () * 0.2::DOUBLE) - sum(floor(round(size * 0.2::DOUBLE, 6))) OVER () AS rest
  FROM sizes),
split AS (
  SELECT k.doc_id, k.label, row_number() OVER (PARTITION BY k.label ORDER BY key, doc_id)
    <= whole + CASE WHEN turn <= rest THEN 1 ELSE 0 END AS is_test
  FROM keyed k JOIN parts p ON p.label = k.label)"""


def _clean(spark, path):
    return dataset.clean_labels(v.labelled(spark, path))


@query("ds_1_union", """
SELECT chat_message, label FROM (SELECT text AS chat_message, CAST(quality AS VARCHAR) AS label FROM documents
  JOIN labels USING (doc_id)
UNION ALL SELECT text, CAST(turn AS VARCHAR) FROM conversations
UNION ALL SELECT text, NULL FROM benchmark)""")
def union(spark, path):
    a = v.table(spark, path, "documents").join(v.table(spark, path, "labels"), "doc_id").select(
        F.col("quality").cast("string").alias("label"), F.col("text").alias("chat_message"))
    b = v.table(spark, path, "conversations").select(
        F.col("text").alias("chat_message"), F.col("turn").cast("string").alias("label"))
    c = v.table(spark, path, "benchmark").select(F.col("text").alias("chat_message"))
    return ingest.union_labels([a, b, c]).select("chat_message", "label")


@query("ds_2_label_cleaning", with_sql(LABELLED, CLEAN, select="SELECT doc_id, label FROM clean"))
def label_cleaning(spark, path):
    return _clean(spark, path).select("doc_id", "label")


@query("ds_3_first_of_each_message", with_sql(LABELLED, CLEAN, select="""
SELECT chat_message, doc_id, label FROM clean QUALIFY row_number() OVER (PARTITION BY chat_message ORDER BY doc_id) = 1"""))
def first_of_each_message(spark, path):
    return dataset.first_of_each(_clean(spark, path), "chat_message", "doc_id").select("chat_message", "doc_id", "label")


@query("ds_4_stratified_split", with_sql(LABELLED, CLEAN, SPLIT, select="SELECT doc_id, label, is_test FROM split"))
def stratified_split(spark, path):
    return dataset.stratified_split(_clean(spark, path), "doc_id").select("doc_id", "label", "is_test")


@query("ds_5_oversampling", with_sql(LABELLED, CLEAN, """sized AS (
  SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS row_no
  FROM clean),
drawn AS (
  SELECT s.doc_id, s.label, d.draw_no FROM range(1, 201) d(draw_no)
  JOIN sized s ON s.n < 200 AND s.label <> 6 AND s.row_no =
    CAST('0x' || substr(md5((d.draw_no * 31 + s.label) || ':42'), 1, 8) AS BIGINT) % 2147483648 % s.n)""", select="""
SELECT doc_id, label, draw_no,
  CAST('0x' || substr(md5((doc_id * 1201 + coalesce(draw_no, 0)) || ':43'), 1, 8) AS BIGINT) % 2147483648 AS shuffle_key FROM (
  SELECT * FROM drawn UNION ALL SELECT doc_id, label, NULL FROM sized WHERE n >= 200 OR label = 6)"""))
def oversampling(spark, path):
    out = dataset.oversample(_clean(spark, path), "doc_id", s=SMALL)
    return out.select("doc_id", "label", "draw_no", "shuffle_key")


@query("ds_6_corpus", f"""
SELECT text, min(position) AS position FROM (SELECT {strip_sql('text')} AS text, position FROM (
  SELECT text, doc_id AS position FROM documents UNION ALL SELECT text, 1000000000 + conv_id * 1000 + turn FROM conversations
  UNION ALL SELECT text, 2000000000 + item_id FROM benchmark))
WHERE length(text) > 0 GROUP BY text""")
def corpus(spark, path):
    docs = v.texts(spark, path, "documents").select("text", F.col("doc_id").alias("position"))
    conv = v.table(spark, path, "conversations").select(
        "text", (F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("position"))
    items = v.table(spark, path, "benchmark").select("text", (F.lit(2_000_000_000) + F.col("item_id")).alias("position"))
    return dataset.corpus(docs.unionByName(conv).unionByName(items))


@query("ds_7_ingest_dedup", """
SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS video_id, (CAST(epoch_us(ts) AS BIGINT) % 86400000000) // 600000000 AS time_ms,
  event_type AS chat_message FROM events""")
def ingest_dedup(spark, path):
    return ingest.unique_messages(v.table(spark, path, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("video_id"),
        F.floor(v.micros_of_day() / 600_000_000).alias("time_ms"), F.col("event_type").alias("chat_message")))


@query("ds_8_macro_f1", with_sql(LABELLED, CLEAN, """said AS (
  SELECT label, (length(chat_message) + doc_id) % 4 AS prediction FROM clean),
classes AS (
  SELECT label, CAST(sum(hit) AS BIGINT) AS true_positives, CAST(sum(actual) AS BIGINT) AS actual,
    CAST(sum(predicted) AS BIGINT) AS predicted FROM (
    SELECT label, CASE WHEN label = prediction THEN 1 ELSE 0 END AS hit, 1 AS actual, 0 AS predicted FROM said
    UNION ALL SELECT prediction, 0, 0, 1 FROM said) GROUP BY label)""", select="""
SELECT label, true_positives, actual, predicted, round(2 * true_positives / (actual + predicted) + 1e-9, 6) AS f1,
  round(avg(2 * true_positives / (actual + predicted)) OVER () + 1e-9, 6) AS macro_f1 FROM classes"""))
def macro_f1(spark, path):
    said = _clean(spark, path).withColumn(
        "prediction", ((F.length("chat_message") + F.col("doc_id")) % 4).cast("int"))
    out = dataset.macro_f1(said)
    return out.withColumn("f1", rounded(F.col("f1"), 6)).withColumn("macro_f1", rounded(F.col("macro_f1"), 6))


@query("agg_17_label_statistics", with_sql(LABELLED, CLEAN, select="""
SELECT c.label, c.rows, (SELECT count(*) FROM labelled) AS raw_rows, (SELECT count(*) FROM clean) AS clean_rows
FROM (SELECT label, count(*) AS rows FROM clean GROUP BY label) c"""))
def label_statistics(spark, path):
    return dataset.label_statistics(v.labelled(spark, path))


@query("emo_1_classifier", "SELECT doc_id, TRUE AS sums_to_one, TRUE AS known_label FROM documents")
def classifier(spark, path):
    """What SQL can state of a trained model: every document has probabilities and a label of the training part."""
    split = dataset.stratified_split(_clean(spark, path), "doc_id")
    # Read for the n-grams and for the labels; kept, so that the split is made once.
    training = cut_lineage(split.filter(~F.col("is_test")).select("label", "chat_message"))
    out = dataset.classify(dataset.train_classifier(training), v.table(spark, path, "documents").select(
        "doc_id", F.col("text").alias("chat_message")))
    known = training.select(F.col("label").alias("prediction")).distinct().withColumn("known_label", F.lit(True))
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return out.join(known, "prediction", "left").select(
        "doc_id", (F.abs(total - 1) < 1e-6).alias("sums_to_one"), F.coalesce("known_label", F.lit(False)).alias("known_label"))


BAYES = """chars AS (SELECT doc_id, string_split(lower(coalesce(text, '')), '') AS c, length(lower(coalesce(text, ''))) AS n FROM documents),
grams AS (
  SELECT doc_id, gram, count(*) AS times FROM (
    SELECT doc_id, unnest(list_concat(list_transform(range(1, n), lambda i: c[i] || c[i + 1]),
      list_transform(range(1, n - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS gram FROM chars) GROUP BY ALL),
learned AS (SELECT label, gram, sum(times) AS n FROM grams JOIN clean USING (doc_id) WHERE doc_id % 5 <> 0 GROUP BY ALL),
classes AS (
  SELECT label, ln(rows / (SELECT count(*) FROM clean WHERE doc_id % 5 <> 0)) AS prior,
    ln(total + (SELECT count(DISTINCT gram) FROM learned)) AS spread
  FROM (SELECT label, count(*)::DOUBLE AS rows FROM clean WHERE doc_id % 5 <> 0 GROUP BY label)
  JOIN (SELECT label, sum(n) AS total FROM learned GROUP BY label) USING (label)),
hits AS (
  SELECT doc_id, label, sum(times * ln(n + 1.0::DOUBLE)) AS hit FROM grams JOIN learned USING (gram) GROUP BY ALL),
scores AS (
  SELECT c.doc_id, k.label, prior + coalesce(hit, 0) - (greatest(c.n - 1, 0) + greatest(c.n - 2, 0)) * spread AS score
  FROM chars c CROSS JOIN classes k LEFT JOIN hits h ON h.doc_id = c.doc_id AND h.label = k.label),
judged AS (SELECT *, first_value(label) OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS prediction FROM scores)"""


def _bayes(spark, path):
    """Trained on four fifths of the labelled documents, applied to all documents."""
    clean = _clean(spark, path)
    model = bayes.train_bayes(clean.filter("doc_id % 5 <> 0"))
    return clean, bayes.bayes_scores(model, v.table(spark, path, "documents"), "doc_id", "text")


@query("emo_1_bayes", with_sql(LABELLED, CLEAN, BAYES, select="""
SELECT doc_id, label, round(score + 1e-9, 4) AS score, prediction FROM judged"""))
def bayes_classifier(spark, path):
    return _bayes(spark, path)[1].withColumn("score", rounded(F.col("score"), 4))


@query("ds_8_bayes_macro_f1", with_sql(LABELLED, CLEAN, BAYES, """said AS (
  SELECT DISTINCT c.doc_id, c.label, prediction FROM clean c JOIN judged j ON j.doc_id = c.doc_id WHERE c.doc_id % 5 = 0),
tallies AS (
  SELECT label, CAST(sum(hit) AS BIGINT) AS true_positives, CAST(sum(actual) AS BIGINT) AS actual, CAST(sum(predicted) AS BIGINT) AS predicted FROM (
    SELECT label, CASE WHEN label = prediction THEN 1 ELSE 0 END AS hit, 1 AS actual, 0 AS predicted FROM said
    UNION ALL SELECT prediction, 0, 0, 1 FROM said) GROUP BY label)""", select="""
SELECT label, true_positives, actual, predicted, round(2 * true_positives / (actual + predicted) + 1e-9, 6) AS f1,
  round(avg(2 * true_positives / (actual + predicted)) OVER () + 1e-9, 6) AS macro_f1 FROM tallies"""))
def bayes_macro_f1(spark, path):
    clean, scores = _bayes(spark, path)
    said = clean.filter("doc_id % 5 = 0").select("doc_id", "label").join(scores.select("doc_id", "prediction").distinct(), "doc_id")
    out = dataset.macro_f1(said)
    return out.withColumn("f1", rounded(F.col("f1"), 6)).withColumn("macro_f1", rounded(F.col("macro_f1"), 6))


@query("emo_1_external_model", """
SELECT doc_id, round(1 / (1 + length(CASE WHEN t = '' THEN '...' ELSE t END)::DOUBLE) + 1e-9, 6) AS p0
FROM (SELECT doc_id, """ + strip_sql("text") + """ AS t FROM documents)""")
def external_model(spark, path):
    def load():
        def predict(texts):
            share = 1 / (1 + texts.str.len().astype(float))
            return [[s] + [(1 - s) / 6] * 6 for s in share]
        return predict

    docs = v.texts(spark, path, "documents").select("doc_id", F.col("text").alias("chat_text"))
    return dataset.classify_with(docs, load).select("doc_id", rounded(F.col("probs")[0], 6).alias("p0"))
