"""Where on the screen the chat is, from text boxes `(video_id, frame, box_idx, xmin, ymin, xmax, ymax, text)`.

Box coordinates are shares of the screen. Steps that depend on the order of boxes work on *distinct positions* (left
edges, top edges, centres), whose number is bounded by the screen resolution, and never on the list of all boxes of a
recording.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdpeak import fixed_values as fv
from crowdpeak.functions.numbers import clamp, rounded
from crowdpeak.session import cut_lineage
from crowdpeak.settings import Settings

DEFAULT = Settings()
GEOMETRY = ["xmin", "ymin", "xmax", "ymax"]
#: Pairs of boxes that are looked at at once.
PIECE = 1 << 20


def sample_times(videos: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Evenly spaced times of each recording, ends included; a very short recording is sampled from its start."""
    end = F.col("duration_sec") - s.region_end_guard_sec
    short = end <= s.region_start_sec
    first = F.when(short, F.lit(0.0)).otherwise(F.lit(s.region_start_sec))
    last = F.when(short, F.greatest(end, F.lit(0.0))).otherwise(end)
    step = (last - first) / (s.region_frames - 1)
    return videos.select("video_id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(s.region_frames - 1)), lambda i: first + i * step)).alias("frame_no", "t"))


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes given as struct columns, between 0 and 1."""
    def c(box: str, name: str) -> Column:
        return F.col(f"{box}.{name}")

    width = F.greatest(F.lit(0.0), F.least(c(a, "xmax"), c(b, "xmax")) - F.greatest(c(a, "xmin"), c(b, "xmin")))
    height = F.greatest(F.lit(0.0), F.least(c(a, "ymax"), c(b, "ymax")) - F.greatest(c(a, "ymin"), c(b, "ymin")))
    inter = width * height
    area_a = (c(a, "xmax") - c(a, "xmin")) * (c(a, "ymax") - c(a, "ymin"))
    area_b = (c(b, "xmax") - c(b, "xmin")) * (c(b, "ymax") - c(b, "ymin"))
    union = area_a + area_b - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def _frames_read(boxes: DataFrame, frames: DataFrame | None, name: str) -> DataFrame:
    """Frames read of each recording; a frame without any text counts, but only `frames(video_id, n_frames)` knows it."""
    if frames is None:
        return boxes.groupBy("video_id").agg(F.countDistinct("frame").alias(name))
    return frames.select("video_id", F.col("n_frames").alias(name))


def fixed_boxes(boxes: DataFrame, s: Settings = DEFAULT, frames: DataFrame | None = None) -> DataFrame:
    """Distinct `(video_id, text, box)` that are part of the screen layout: the same text at nearly the same place in
    at least half of the other frames. Text that scrolls does not stay.

    Whether a box is fixed depends on its text and geometry only, so equal boxes of all frames are one. Boxes that overlap
    enough have similar places, so each box meets only those of its text that are near it from top to bottom.
    """
    ratio = s.region_fixed_iou
    frames = _frames_read(boxes, frames, "_frames")
    enough = s.region_fixed_ratio * (F.col("_frames") - 1)
    seen = boxes.filter(F.col("video_id").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0)).select(
        "video_id", "text", "frame", *GEOMETRY)
    # A text that is in too few frames cannot be fixed anywhere. That leaves out nearly all chat before any pairing.
    steady = (
        seen.groupBy("video_id", "text").agg(F.countDistinct("frame").alias("_in")).join(frames, "video_id")
        .filter((F.col("_frames") > 1) & (F.col("_in") - 1 >= enough)).groupBy("video_id", "text").agg(F.min("_frames").alias("_frames"))
    )
    # The boxes of a text meet once, and all that is made of pairs of them stays inside their group.
    kept = seen.filter("ymin IS NOT NULL AND ymax IS NOT NULL").join(steady, ["video_id", "text"])
    schema = T.StructType([*(kept.schema[c] for c in ("video_id", "text", *GEOMETRY)), T.StructField("same_frames", T.LongType())])
    return kept.groupBy("video_id", "text").applyInArrow(_fixed_in(ratio, s.region_fixed_ratio), schema)


def _fixed_in(ratio: float, enough: float):
    """The fixed boxes among those of one text."""
    # Centres of two boxes that overlap by `ratio` differ by at most this share of either height. The slack keeps pairs
    # whose overlap is exactly at the limit.
    share = max(1.0 - ratio, 0.5 / ratio - 0.5)

    def fixed(boxes: pa.Table) -> pa.Table:
        found = np.stack([boxes.column(c).to_numpy() for c in GEOMETRY])
        centre = (found[3] + found[1]) / 2
        known = np.where(np.isnan(found), -np.inf, found)  # a box without a left or right edge equals only itself
        order = np.lexsort((*known, centre))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (known[:, order[1:]] != known[:, order[:-1]]).any(axis=0)
        shape = np.empty(len(order), dtype=np.int64)
        shape[order] = np.cumsum(first) - 1
        rows = order[first]  # one row for each distinct box, from the top down
        xmin, ymin, xmax, ymax = found[:, rows]
        centre, reach, area = centre[rows], np.maximum(ymax - ymin, 1e-6) * share + 1e-9, (xmax - xmin) * (ymax - ymin)
        frame = boxes.column("frame").combine_chunks().dictionary_encode().indices
        read = np.flatnonzero(frame.is_valid().to_numpy(zero_copy_only=False))
        frame, of = frame.drop_null().to_numpy(), shape[read]
        in_frames = np.zeros(len(rows), dtype=np.int64)
        # Pairs and (box, frame) marks are made in pieces, so that a text with very many boxes needs no more memory.
        n_frames, high = int(frame.max()) + 1 if len(frame) else 0, max(1, PIECE // len(rows))
        wide = max(1, min(n_frames, high))
        for left in range(0, n_frames, wide):
            marks = np.zeros((len(rows), wide), dtype=np.float32)
            mine = (frame >= left) & (frame < left + wide)
            marks[of[mine], frame[mine] - left] = 1
            for a in range(0, len(rows), high):
                b = min(a + high, len(rows))
                low, top = np.searchsorted(centre, (centre[a:b] - reach[a:b]).min()), np.searchsorted(centre, (centre[a:b] + reach[a:b]).max(), "right")
                width, height = (np.maximum(0.0, np.minimum(to[a:b, None], to[None, low:top]) - np.maximum(at[a:b, None], at[None, low:top]))
                                 for at, to in ((xmin, xmax), (ymin, ymax)))
                inter = width * height
                union = area[a:b, None] + area[None, low:top] - inter
                near = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0) >= ratio
                near |= np.arange(a, b)[:, None] == np.arange(low, top)[None, :]
                in_frames[a:b] += (near.astype(np.float32) @ marks[low:top] > 0).sum(axis=1)
        # A box is in its own frame, so the number of *other* frames is one less than that of all frames it is seen in.
        chosen = np.flatnonzero((in_frames > 0) & (in_frames - 1 >= enough * (boxes.column("_frames")[0].as_py() - 1)))
        out = boxes.select(["video_id", "text", *GEOMETRY]).take(pa.array(rows[chosen]))
        return out.append_column("same_frames", pa.array(in_frames[chosen] - 1, pa.int64()))
    return fixed


def moving_boxes(boxes: DataFrame, s: Settings = DEFAULT, frames: DataFrame | None = None) -> DataFrame:
    """Boxes that are not part of the screen layout."""
    return without_fixed(boxes, fixed_boxes(boxes, s, frames))


def without_fixed(boxes: DataFrame, fixed: DataFrame) -> DataFrame:
    gone = fixed.drop("same_frames")
    return boxes.join(gone, ["video_id", "text", *GEOMETRY], "left_anti")


def left_groups(boxes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Add `group_left`, the left edge of the first box of the group: a box joins a group while its left edge is within
    the gap of the group's *first* box, so a group cannot grow without end."""
    gap = s.region_left_gap
    start = F.struct(F.lit(None).cast("double").alias("left"), F.array().cast("array<double>").alias("lefts"))

    def step(acc: Column, x: Column) -> Column:
        opens = acc["left"].isNull() | (x - acc["left"] > gap)
        return F.when(opens, F.struct(x.alias("left"), F.concat(acc["lefts"], F.array(x)).alias("lefts"))).otherwise(acc)

    # The fold keeps only first edges, at most one per gap of the screen's width, so its cost grows with the distinct edges.
    lefts = boxes.filter("xmin IS NOT NULL").select("video_id", "xmin").distinct().groupBy("video_id").agg(
        F.array_sort(F.collect_list("xmin")).alias("_xs")).withColumn("_lefts", F.aggregate("_xs", start, step)["lefts"])
    edges = lefts.select("video_id", F.explode("_xs").alias("xmin"), "_lefts").select(
        "video_id", "xmin", F.array_max(F.filter("_lefts", lambda left: left <= F.col("xmin"))).alias("group_left"))
    # Boxes meet their edge, not their recording, so a recording is spread over tasks; distinct edges are hashed, so that
    # the boxes, which are far more, are not sorted.
    return boxes.join(edges.hint("shuffle_hash"), ["video_id", "xmin"]).select(*boxes.columns, "group_left")


def _rows_of(centres: Column, height: Column, s: Settings) -> Column:
    """Rows of text among sorted centres: a row starts when a centre is too far below the first one of its row."""
    start = F.struct(F.lit(0).alias("rows"), F.lit(None).cast("double").alias("at"))

    def step(acc: Column, c: Column) -> Column:
        starts = acc["at"].isNull() | (c - acc["at"] > height * s.region_row_gap)
        return F.when(starts, F.struct((acc["rows"] + 1).alias("rows"), c.alias("at"))).otherwise(acc)

    return F.aggregate(centres, start, step)["rows"]


def count_rows(boxes: DataFrame, keys: list[str], height: str, s: Settings = DEFAULT) -> DataFrame:
    """Rows of text per `keys`. `height` is a column with the typical box height of the key."""
    centre = (F.col("ymin") + F.col("ymax")) / 2
    return boxes.groupBy(*keys).agg(
        F.array_sort(F.collect_set(centre)).alias("_centres"), F.first(height).alias("_h")).select(
        *keys, _rows_of(F.col("_centres"), F.col("_h"), s).alias("rows"))


def refined_groups(grouped: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Boxes of the largest groups that look like chat: usual height, and part of the largest block of their frame."""
    # The state of a median holds each distinct height once, so the boxes go into it straight from their join.
    sizes = grouped.select("video_id", "group_left", (F.col("ymax") - F.col("ymin")).alias("_height")).groupBy(
        "video_id", "group_left").agg(F.count("*").alias("_size"), F.percentile("_height", F.lit(0.5)).alias("median_height"))
    # Groups are at least one gap apart, so a recording has at most 1 / gap of them.
    order = Window.partitionBy("video_id").orderBy(F.col("_size").desc(), "group_left")
    largest = sizes.withColumn("group_order", F.row_number().over(order)).filter(
        F.col("group_order") <= s.region_top_groups).drop("_size")
    height, usual = F.col("ymax") - F.col("ymin"), F.col("median_height")
    fitting = grouped.join(largest, ["video_id", "group_left"]).filter(
        (height >= usual * s.region_height_low) & (height <= usual * s.region_height_high))
    frame = ["video_id", "group_left", "frame"]
    # One row per top edge: how many boxes start there, and where the last of them ends.
    edges = fitting.groupBy(*frame, "ymin").agg(
        F.count("*").alias("_n"), F.first("median_height").alias("_h"),
        F.max_by("ymax", F.struct("xmin", "box_idx")).alias("_bottom"))
    down = Window.partitionBy(*frame).orderBy("ymin")
    starts = F.when(F.col("ymin") - F.lag("_bottom").over(down) > F.col("_h") * s.region_chunk_gap, 1).otherwise(0)
    blocks = (
        edges.withColumn("_starts", starts)
        .withColumn("_block", F.sum("_starts").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*frame, "_block").agg(F.sum("_n").alias("_n"), F.min("ymin").alias("_top"), F.max("ymin").alias("_low"))
    )
    best = blocks.groupBy(*frame).agg(F.max_by(
        F.struct("_top", "_low"), F.struct(F.col("_n"), -F.col("_block"))).alias("_b"))
    return (
        fitting.join(best, frame)
        .filter((F.col("ymin") >= F.col("_b._top")) & (F.col("ymin") <= F.col("_b._low"))).drop("_b")
    )


def group_scores(refined: DataFrame, boxes: DataFrame, s: Settings = DEFAULT, frames: DataFrame | None = None) -> DataFrame:
    """Score of each group: rows of text times the share of the frames read that it is seen in."""
    frames = _frames_read(boxes, frames, "frames")
    keys = ["video_id", "group_left"]
    rows = count_rows(refined, keys + ["group_order", "frame", "median_height"], "median_height", s)
    scored = rows.groupBy(*keys, "group_order", "median_height").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("seen_frames"))
    return scored.join(frames, "video_id").withColumn(
        "score", F.col("rows") * (F.col("seen_frames") / F.col("frames")))


def best_groups(scores: DataFrame) -> DataFrame:
    """The group with the highest score of each recording, the larger group on ties."""
    rest = [c for c in scores.columns if c != "video_id"]
    best = F.max_by(F.struct(*rest), F.struct(F.round("score", 9), -F.col("group_order")))
    return scores.groupBy("video_id").agg(best.alias("_g")).select("video_id", "_g.*")


def best_bands(refined: DataFrame, best: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Boxes of the best group that lie in its band with the most rows, all frames laid over each other."""
    mine = refined.join(best.select("video_id", "group_left"), ["video_id", "group_left"])
    edges = mine.groupBy("video_id", "ymin").agg(F.max("ymax").alias("_bottom"), F.first("median_height").alias("_h"))
    down = Window.partitionBy("video_id").orderBy("ymin")
    above = F.max("_bottom").over(down.rowsBetween(Window.unboundedPreceding, -1))
    bands = (
        edges.withColumn("_starts", F.when(F.col("ymin") - above > F.col("_h") * s.region_band_gap, 1).otherwise(0))
        .withColumn("band", F.sum("_starts").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .select("video_id", "ymin", "band")
    )
    placed = mine.join(bands, ["video_id", "ymin"])
    rows = count_rows(placed, ["video_id", "band", "frame"], "median_height", s).groupBy("video_id", "band").agg(
        F.sum("rows").alias("band_rows"))
    chosen = rows.groupBy("video_id").agg(F.max_by(
        F.struct("band", "band_rows"), F.struct(F.col("band_rows"), -F.col("band"))).alias("_b")).select(
        "video_id", F.col("_b.band").alias("band"), F.col("_b.band_rows").alias("band_rows"))
    return placed.join(chosen, ["video_id", "band"])


def bounding_region(boxes: DataFrame, margin_x: float, margin_y: float) -> DataFrame:
    return boxes.groupBy("video_id").agg(
        rounded(clamp(F.min("ymin") - margin_y)).alias("region_ymin"),
        rounded(clamp(F.min("xmin") - margin_x)).alias("region_xmin"),
        rounded(clamp(F.max("ymax") + margin_y)).alias("region_ymax"),
        rounded(clamp(F.max("xmax") + margin_x)).alias("region_xmax"))


def voted_region(boxes: DataFrame) -> DataFrame:
    """Region by majority: the third of the screen with most boxes, right before left before middle on ties."""
    centre = (F.col("xmin") + F.col("xmax")) / 2
    votes = [F.count("*").alias("_n"), F.count_if(centre < fv.VOTE_LEFT).alias("_left"),
             F.count_if((centre >= fv.VOTE_LEFT) & (centre <= fv.VOTE_RIGHT)).alias("_middle"),
             F.count_if(centre > fv.VOTE_RIGHT).alias("_right")]
    side = (
        F.when(F.col("_n") < fv.VOTE_LEAST_BOXES, "default")
        .when((F.col("_right") >= F.col("_left")) & (F.col("_right") >= F.col("_middle")), "right")
        .when((F.col("_left") >= F.col("_right")) & (F.col("_left") >= F.col("_middle")), "left")
        .otherwise("middle")
    )
    # Votes and all three regions are collected in one pass, so the boxes are read and grouped once.
    low, high = fv.VOTE_MIDDLE
    sides = {"right": centre > fv.VOTE_RIGHT_FROM, "left": centre < fv.VOTE_LEFT_TO,
             "middle": (centre >= low) & (centre <= high)}
    sums = []
    for name, inside in sides.items():
        sums += [F.min(F.when(inside, F.col("ymin"))).alias(f"{name}_ymin"),
                 F.min(F.when(inside, F.col("xmin"))).alias(f"{name}_xmin"),
                 F.max(F.when(inside, F.col("ymax"))).alias(f"{name}_ymax"),
                 F.max(F.when(inside, F.col("xmax"))).alias(f"{name}_xmax")]
    whole = [F.min("ymin").alias("all_ymin"), F.min("xmin").alias("all_xmin"), F.max("ymax").alias("all_ymax"),
             F.max("xmax").alias("all_xmax")]
    bounds = boxes.groupBy("video_id").agg(*votes, *sums, *whole)

    def pick(edge: str, margin: float, fallback: float) -> Column:
        value = F.col(f"all_{edge}")
        for name in sides:
            value = F.when(F.col("side") == name, F.coalesce(f"{name}_{edge}", f"all_{edge}")).otherwise(value)
        return F.when(F.col("side") == "default", F.lit(fallback)).otherwise(rounded(clamp(value + margin)))

    ymin, xmin, ymax, xmax = fv.DEFAULT_REGION
    return bounds.withColumn("side", side).select(
        "video_id", "side", pick("ymin", -fv.VOTE_MARGIN_Y, ymin).alias("region_ymin"),
        pick("xmin", -fv.VOTE_MARGIN_X, xmin).alias("region_xmin"),
        pick("ymax", fv.VOTE_MARGIN_Y, ymax).alias("region_ymax"), pick("xmax", fv.VOTE_MARGIN_X, xmax).alias("region_xmax"))


def chat_regions(boxes: DataFrame, s: Settings = DEFAULT, frames: DataFrame | None = None, videos: DataFrame | None = None,
                 early: DataFrame | None = None) -> DataFrame:
    """Chat region of each recording: the best column of text lines, or the majority vote if that has too few rows.

    `frames(video_id, n_frames)` tells how many frames were read, `early` has the boxes of the frames that vote (else all
    boxes do), and a recording of `videos(video_id)` without any of these boxes gets the default region.
    """
    # Both tables are small next to the boxes and read several times below, so they are written once.
    fixed = cut_lineage(fixed_boxes(boxes, s, frames))
    refined = cut_lineage(refined_groups(left_groups(without_fixed(boxes, fixed), s), s))
    best = best_groups(group_scores(refined, boxes, s, frames)).filter(F.col("rows") >= s.region_min_rows)
    found = bounding_region(best_bands(refined, best, s), s.region_margin_x, s.region_margin_y)
    voted = voted_region(boxes if early is None else early)
    edges = ["region_ymin", "region_xmin", "region_ymax", "region_xmax"]
    named = found.select("video_id", *[F.col(e).alias(f"_{e}") for e in edges])
    both = voted.join(named, "video_id", "left" if early is None else "full")
    if videos is not None:
        both = videos.select("video_id").distinct().join(both, "video_id", "left")
    default = dict(zip(edges, fv.DEFAULT_REGION))
    return both.select(
        "video_id", F.when(F.col("_region_ymin").isNotNull(), "lines").otherwise(
            F.concat(F.lit("vote_"), F.coalesce("side", F.lit("default")))).alias("method"),
        *[F.coalesce(f"_{e}", e, F.lit(default[e])).alias(e) for e in edges])
