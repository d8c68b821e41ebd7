"""Queries on the chat region."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdpeak.checks import views as v
from crowdpeak.checks.registry import query
from crowdpeak.checks.views import BOXES, with_sql
from crowdpeak.functions.numbers import rounded
from crowdpeak.operators import regions

IOU_SQL = """CASE WHEN (a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin)
    - greatest(0.0::DOUBLE, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin))
    * greatest(0.0::DOUBLE, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) > 0
  THEN greatest(0.0::DOUBLE, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin))
    * greatest(0.0::DOUBLE, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))
    / ((a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin)
      - greatest(0.0::DOUBLE, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin))
      * greatest(0.0::DOUBLE, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))) ELSE 0.0::DOUBLE END"""
# Every box against every box of the other frames, the plain way.
MOVING = f"""frame_counts AS (SELECT video_id, count(DISTINCT frame) AS frames FROM boxes GROUP BY ALL),
shapes AS (SELECT DISTINCT video_id, frame, text, xmin, ymin, xmax, ymax FROM boxes),
same AS (
  SELECT a.video_id, a.frame, a.text, a.xmin, a.ymin, a.xmax, a.ymax, count(DISTINCT b.frame) AS same_frames
  FROM shapes a JOIN shapes b ON a.video_id = b.video_id AND a.text = b.text AND a.frame <> b.frame AND {IOU_SQL} >= 0.5
  GROUP BY ALL),
moving AS (
  SELECT b.* FROM boxes b JOIN frame_counts f ON f.video_id = b.video_id
  LEFT JOIN same s ON s.video_id = b.video_id AND s.frame = b.frame AND s.text = b.text AND s.xmin = b.xmin
    AND s.ymin = b.ymin AND s.xmax = b.xmax AND s.ymax = b.ymax
  WHERE NOT (frames > 1 AND coalesce(same_frames, 0) >= 0.5 * (frames - 1)))"""


def _groups(source: str) -> str:
    """SQL of the steps after the removal of fixed boxes, on the boxes in `source`."""
    return f"""edges AS (
  SELECT video_id, xmin, row_number() OVER (PARTITION BY video_id ORDER BY xmin) AS i
  FROM (SELECT DISTINCT video_id, xmin FROM {source})),
chain AS (
  SELECT video_id, i, xmin, xmin AS group_left FROM edges WHERE i = 1
  UNION ALL
  SELECT e.video_id, e.i, e.xmin, CASE WHEN e.xmin - c.group_left > 0.03 THEN e.xmin ELSE c.group_left END
  FROM chain c JOIN edges e ON e.video_id = c.video_id AND e.i = c.i + 1),
grouped AS (SELECT b.*, c.group_left FROM {source} b JOIN chain c ON c.video_id = b.video_id AND c.xmin = b.xmin),
largest AS (
  SELECT video_id, group_left, median(ymax - ymin) AS h,
    row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, group_left) AS group_order
  FROM grouped GROUP BY video_id, group_left QUALIFY group_order <= 5),
fitting AS (
  SELECT g.*, h, group_order FROM grouped g JOIN largest l ON l.video_id = g.video_id AND l.group_left = g.group_left
  WHERE ymax - ymin >= h * 0.65::DOUBLE AND ymax - ymin <= h * 1.35::DOUBLE),
gaps AS (
  SELECT *, CASE WHEN ymin - lag(ymax) OVER (PARTITION BY video_id, group_left, frame ORDER BY ymin, xmin, box_idx)
    > h * 1.5 THEN 1 ELSE 0 END AS starts FROM fitting),
blocks AS (
  SELECT *, sum(starts) OVER (PARTITION BY video_id, group_left, frame ORDER BY ymin, xmin, box_idx) AS block FROM gaps),
block_sizes AS (
  SELECT video_id, group_left, frame, block FROM blocks GROUP BY video_id, group_left, frame, block
  QUALIFY row_number() OVER (PARTITION BY video_id, group_left, frame ORDER BY count(*) DESC, block) = 1),
refined AS (SELECT b.* FROM blocks b JOIN block_sizes s USING (video_id, group_left, frame, block)),
centres AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, group_left, frame ORDER BY c) AS i FROM (
    SELECT DISTINCT video_id, group_left, group_order, frame, h, (ymin + ymax) / 2 AS c FROM refined)),
row_chain AS (
  SELECT video_id, group_left, group_order, frame, h, i, c, c AS row_at, 1 AS n FROM centres WHERE i = 1
  UNION ALL
  SELECT e.video_id, e.group_left, e.group_order, e.frame, e.h, e.i, e.c,
    CASE WHEN e.c - r.row_at > e.h * 0.5 THEN e.c ELSE r.row_at END,
    CASE WHEN e.c - r.row_at > e.h * 0.5 THEN r.n + 1 ELSE r.n END
  FROM row_chain r JOIN centres e ON e.video_id = r.video_id AND e.group_left = r.group_left AND e.frame = r.frame
    AND e.i = r.i + 1),
frame_rows AS (
  SELECT video_id, group_left, group_order, frame, h, max(n) AS rows FROM row_chain GROUP BY ALL),
group_scores AS (
  SELECT f.video_id, group_left, group_order, h, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS seen_frames,
    any_value(t.frames) AS frames, sum(rows) * (count(*) / any_value(t.frames)) AS score
  FROM frame_rows f JOIN (SELECT video_id, count(DISTINCT frame) AS frames FROM boxes GROUP BY ALL) t USING (video_id)
  GROUP BY f.video_id, group_left, group_order, h),
best AS (
  SELECT * FROM group_scores
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, group_order) = 1),
mine AS (SELECT r.* FROM refined r JOIN best b ON b.video_id = r.video_id AND b.group_left = r.group_left),
band_gaps AS (
  SELECT *, CASE WHEN ymin - max(ymax) OVER (PARTITION BY video_id ORDER BY ymin, xmin, box_idx ROWS BETWEEN UNBOUNDED
    PRECEDING AND 1 PRECEDING) > h * 2 THEN 1 ELSE 0 END AS opens FROM mine),
banded AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY video_id ORDER BY ymin, xmin, box_idx) AS BIGINT) AS band FROM band_gaps),
band_centres AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, band, frame ORDER BY c) AS i FROM (
    SELECT DISTINCT video_id, band, frame, h, (ymin + ymax) / 2 AS c FROM banded)),
band_chain AS (
  SELECT video_id, band, frame, h, i, c, c AS row_at, 1 AS n FROM band_centres WHERE i = 1
  UNION ALL
  SELECT e.video_id, e.band, e.frame, e.h, e.i, e.c, CASE WHEN e.c - r.row_at > e.h * 0.5 THEN e.c ELSE r.row_at END,
    CASE WHEN e.c - r.row_at > e.h * 0.5 THEN r.n + 1 ELSE r.n END
  FROM band_chain r JOIN band_centres e ON e.video_id = r.video_id AND e.band = r.band AND e.frame = r.frame
    AND e.i = r.i + 1),
band_scores AS (
  SELECT video_id, band, CAST(sum(rows) AS BIGINT) AS band_rows FROM (
    SELECT video_id, band, frame, max(n) AS rows FROM band_chain GROUP BY ALL) GROUP BY video_id, band
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY sum(rows) DESC, band) = 1),
kept AS (SELECT b.*, s.band_rows FROM banded b JOIN band_scores s ON s.video_id = b.video_id AND s.band = b.band),
found AS (
  SELECT video_id, round(least(1, greatest(0, min(ymin) - 0.05::DOUBLE)) + 1e-9, 2) AS region_ymin,
    round(least(1, greatest(0, min(xmin) - 0.02::DOUBLE)) + 1e-9, 2) AS region_xmin,
    round(least(1, greatest(0, max(ymax) + 0.05::DOUBLE)) + 1e-9, 2) AS region_ymax,
    round(least(1, greatest(0, max(xmax) + 0.02::DOUBLE)) + 1e-9, 2) AS region_xmax
  FROM kept GROUP BY video_id)"""


VOTE = """votes AS (
  SELECT video_id, count(*) AS n, count(*) FILTER (WHERE (xmin + xmax) / 2 < 0.35) AS l,
    count(*) FILTER (WHERE (xmin + xmax) / 2 BETWEEN 0.35 AND 0.65) AS m,
    count(*) FILTER (WHERE (xmin + xmax) / 2 > 0.65) AS r FROM boxes GROUP BY video_id),
sided AS (
  SELECT video_id, CASE WHEN n < 3 THEN 'default' WHEN r >= l AND r >= m THEN 'right' WHEN l >= r AND l >= m THEN 'left'
    ELSE 'middle' END AS side FROM votes),
voted AS (
  SELECT s.video_id, side,
    CASE WHEN side = 'default' THEN 0.15 ELSE round(least(1, greatest(0, min(ymin) - 0.05::DOUBLE)) + 1e-9, 2) END
      AS region_ymin,
    CASE WHEN side = 'default' THEN 0.65 ELSE round(least(1, greatest(0, min(xmin) - 0.03::DOUBLE)) + 1e-9, 2) END
      AS region_xmin,
    CASE WHEN side = 'default' THEN 0.95 ELSE round(least(1, greatest(0, max(ymax) + 0.05::DOUBLE)) + 1e-9, 2) END
      AS region_ymax,
    CASE WHEN side = 'default' THEN 0.98 ELSE round(least(1, greatest(0, max(xmax) + 0.03::DOUBLE)) + 1e-9, 2) END
      AS region_xmax
  FROM sided s JOIN boxes b ON b.video_id = s.video_id AND (side = 'default'
    OR (side = 'right' AND (xmin + xmax) / 2 > 0.55) OR (side = 'left' AND (xmin + xmax) / 2 < 0.45)
    OR (side = 'middle' AND (xmin + xmax) / 2 BETWEEN 0.30 AND 0.70))
  GROUP BY s.video_id, side)"""


def _refined(spark, path):
    return regions.refined_groups(regions.left_groups(v.boxes(spark, path)))


@query("roi_1_sample_times", """
SELECT s_suppkey AS video_id, i AS frame_no, round(CASE WHEN d - 5 <= 5 THEN greatest(d - 5, 0.0::DOUBLE) * i / 19
  ELSE 5 + (d - 5 - 5) * i / 19 END + 1e-9, 6) AS t
FROM (SELECT s_suppkey, abs(s_acctbal) / 8 AS d FROM supplier), range(0, 20) r(i)""")
def sample_times(spark, path):
    videos = v.table(spark, path, "supplier").select(
        F.col("s_suppkey").alias("video_id"), (F.abs("s_acctbal") / 8).alias("duration_sec"))
    return regions.sample_times(videos).withColumn("t", rounded(F.col("t"), 6))


@query("roi_2_iou", with_sql(BOXES, f"""neighbours AS (
  SELECT video_id, box_idx, {{'xmin': xmin, 'ymin': ymin, 'xmax': xmax, 'ymax': ymax}} AS a,
    lead({{'xmin': xmin, 'ymin': ymin, 'xmax': xmax, 'ymax': ymax}}) OVER (PARTITION BY video_id, frame, text
      ORDER BY box_idx, xmin, ymin, xmax, ymax) AS b FROM boxes)""", select=f"""
SELECT video_id, box_idx, round(sum({IOU_SQL}) + 1e-9, 6) AS iou FROM neighbours WHERE b IS NOT NULL GROUP BY ALL"""))
def iou(spark, path):
    from pyspark.sql import Window

    box = F.struct(*regions.GEOMETRY)
    w = Window.partitionBy("video_id", "frame", "text").orderBy("box_idx", *regions.GEOMETRY)
    pairs = v.boxes(spark, path).withColumn("a", box).withColumn("b", F.lead(box).over(w)).filter("b IS NOT NULL")
    return pairs.groupBy("video_id", "box_idx").agg(rounded(F.sum(regions.iou("a", "b")), 6).alias("iou"))


@query("join_8_fixed_boxes", with_sql(BOXES, MOVING, select="""
SELECT DISTINCT s.video_id, s.text, s.xmin, s.ymin, s.xmax, s.ymax, same_frames
FROM same s JOIN frame_counts f ON f.video_id = s.video_id WHERE frames > 1 AND same_frames >= 0.5 * (frames - 1)"""))
def fixed_boxes(spark, path):
    return regions.fixed_boxes(v.boxes(spark, path))


@query("roi_3_moving_boxes", with_sql(BOXES, MOVING, select="""
SELECT video_id, frame, box_idx, text, xmin, ymin, xmax, ymax FROM moving"""))
def moving_boxes(spark, path):
    return regions.moving_boxes(v.boxes(spark, path))


@query("roi_4_left_groups", with_sql(BOXES, _groups("boxes"), recursive=True, select="""
SELECT video_id, group_left, count(*) AS n, count(DISTINCT xmin) AS edges FROM grouped GROUP BY ALL"""))
def left_groups(spark, path):
    return regions.left_groups(v.boxes(spark, path)).groupBy("video_id", "group_left").agg(
        F.count("*").alias("n"), F.countDistinct("xmin").alias("edges"))


@query("roi_5_refined_groups", with_sql(BOXES, _groups("boxes"), recursive=True, select="""
SELECT video_id, group_left, frame, box_idx, xmin, ymin, ymax, round(h, 9) AS median_height FROM refined"""))
def refined_groups(spark, path):
    return _refined(spark, path).select("video_id", "group_left", "frame", "box_idx", "xmin", "ymin", "ymax",
                                        F.round("median_height", 9).alias("median_height"))


@query("roi_6_rows_per_frame", with_sql(BOXES, _groups("boxes"), recursive=True, select="""
SELECT video_id, group_left, frame, rows FROM frame_rows"""))
def rows_per_frame(spark, path):
    return regions.count_rows(_refined(spark, path), ["video_id", "group_left", "frame"], "median_height")


@query("roi_7_group_scores", with_sql(BOXES, _groups("boxes"), recursive=True, select="""
SELECT s.video_id, s.group_left, s.rows, s.seen_frames, round(s.score + 1e-9, 6) AS score, b.video_id IS NOT NULL AS is_best
FROM group_scores s LEFT JOIN best b ON b.video_id = s.video_id AND b.group_left = s.group_left"""))
def group_scores(spark, path):
    scores = regions.group_scores(_refined(spark, path), v.boxes(spark, path))
    best = regions.best_groups(scores).select("video_id", "group_left", F.lit(True).alias("is_best"))
    return scores.join(best, ["video_id", "group_left"], "left").select(
        "video_id", "group_left", "rows", "seen_frames", rounded(F.col("score"), 6).alias("score"),
        F.coalesce("is_best", F.lit(False)).alias("is_best"))


@query("roi_8_best_band", with_sql(BOXES, _groups("boxes"), recursive=True, select="""
SELECT video_id, band, band_rows, count(*) AS n, min(ymin) AS top, max(ymax) AS bottom FROM kept GROUP BY ALL"""))
def best_band(spark, path):
    refined = _refined(spark, path)
    best = regions.best_groups(regions.group_scores(refined, v.boxes(spark, path)))
    return regions.best_bands(refined, best).groupBy("video_id", "band", "band_rows").agg(
        F.count("*").alias("n"), F.min("ymin").alias("top"), F.max("ymax").alias("bottom"))


@query("roi_9_chat_region", with_sql(BOXES, MOVING, _groups("moving"), VOTE, recursive=True, select="""
SELECT v.video_id, CASE WHEN f.video_id IS NOT NULL THEN 'lines' ELSE 'vote_' || side END AS method,
  coalesce(f.region_ymin, v.region_ymin) AS region_ymin, coalesce(f.region_xmin, v.region_xmin) AS region_xmin,
  coalesce(f.region_ymax, v.region_ymax) AS region_ymax, coalesce(f.region_xmax, v.region_xmax) AS region_xmax
FROM voted v LEFT JOIN (SELECT f.* FROM found f JOIN best b ON b.video_id = f.video_id AND b.rows >= 8) f
  ON f.video_id = v.video_id"""))
def chat_region(spark, path):
    return regions.chat_regions(v.boxes(spark, path))


@query("agg_16_region_vote", with_sql(BOXES, VOTE, select="SELECT * FROM voted"))
def region_vote(spark, path):
    return regions.voted_region(v.boxes(spark, path))
