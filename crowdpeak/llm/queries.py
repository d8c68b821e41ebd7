"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdpeak.llm import alignment, centroids, chat, decontamination, embeddings, html_text, jaccard, language, lm, mixing, pii, sharding, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Control strings inside texts, for op9.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':11'), 1, 15)) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk, CAST(3 * source_size AS HUGEINT) AS cap FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
f AS (SELECT *, sum(source_size) OVER () AS total,
             sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rk ROWS UNBOUNDED PRECEDING) - cap AS caps_before,
             sum(weight) OVER () - sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rk ROWS UNBOUNDED PRECEDING) + weight AS weights_from FROM w),
g AS (SELECT *, CAST(cap AS DOUBLE) * CAST(weights_from AS DOUBLE) <= CAST(total - caps_before AS DOUBLE) * CAST(weight AS DOUBLE) AS is_full FROM f),
o AS (SELECT *, total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS rest, sum(CASE WHEN NOT is_full THEN weight END) OVER () AS open_weight FROM g),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
        least(CAST(rest AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(open_weight AS DOUBLE), CAST(cap AS DOUBLE)) END AS target FROM o),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM p)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, budget - passes * source_size - before)) AS BIGINT) AS taken FROM q
"""


@query("op1_source_mix", MIX_SQL)
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_hypergeometric_shards")
def op6_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums are taken in the scan, so that texts do not move."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return sharding.shard(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
r AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
h AS (SELECT doc_id, hash(gram) AS gram FROM g JOIN r USING (gram)),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.gram = b.gram AND a.doc_id <> b.doc_id
      JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
c(node, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.reached)
SELECT n.doc_id, n.n AS n_shingles, min(c.reached) AS component_id FROM n JOIN c ON c.node = n.doc_id GROUP BY n.doc_id, n.n
"""


@query("op7_t_occurrence_join", JACCARD_SQL)
def op7_t_occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op2_cross_polytope")
def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op4_toxicity_cnn")
def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    _, limits, scored = toxicity.train_and_score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"),
                         toxicity.rejected(F.col("score"), F.col("lang"), limits).alias("rejected"))


@query("op3_cross_entropy_difference")
def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_aligned_leaks")
def op5_aligned_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_block_crf")
def op8_block_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.extract(pages, html_text.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op10_byte_gru")
def op10_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", (toxicity.fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k FROM c),
e AS (SELECT *, 9 + length(role) + length(text)
        + length(regexp_replace(role || text, '[^~<\[\]]', '', 'g')) AS chars FROM n),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto,
             max(k) OVER (PARTITION BY conv_id) AS last FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR k = last THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""


@query("op9_prefix_targets", CHAT_SQL)
def op9_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are read back from the longest example of a conversation, losses from the mask of each."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    made = chat.format_chats(given.unionByName(added))
    seen = made.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), chat.loss_text(made).alias("loss"),
                       F.when(F.col("is_last"), chat.read_back(F.col("formatted"))).alias("turns"))
    whole = seen.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.max("turns").alias("turns"))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def _centroid_sql(rounds: int = 3) -> str:
    steps = [r"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
e AS MATERIALIZED (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k),
s AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster FROM k),
c0 AS MATERIALIZED (SELECT cluster, i, x AS c FROM s JOIN e USING (row) WHERE cluster < 16)"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT row, cluster, CAST(d AS BIGINT) AS distance FROM (
  SELECT e.row, cluster, sum((x - c) * (x - c)) AS d FROM e JOIN c{n} USING (i) GROUP BY e.row, cluster)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT cluster, i, CAST((t - ((t % n) + n) % n) // n AS BIGINT) AS c FROM (SELECT cluster, i, sum(x) AS t, count(*) AS n FROM e JOIN a{n} USING (row) GROUP BY cluster, i)
  UNION ALL SELECT cluster, i, c FROM c{n} WHERE cluster NOT IN (SELECT cluster FROM a{n}))""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN k USING (row) JOIN (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) USING (cluster)
"""


@query("op13_drift_tightening", _centroid_sql())
def op13_drift_tightening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centres.tolist()]).cast("array<string>")
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # 16 rows
    totals = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(centres))]).cast("array<long>")
    return found.select("vec_id", "cluster", "distance", F.get(totals, F.col("cluster")).alias("cluster_inertia"),
                        F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"))


@query("op11_galloping_alignment")
def op11_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_shape_crf")
def op12_shape_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *counts, F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"))
