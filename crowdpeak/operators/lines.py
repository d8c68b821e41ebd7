"""Chat lines: which ones are new in a scene, how many of them a window has, and how alike they are."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdpeak.functions.grams import counted, gram_codes, text_slices
from crowdpeak.operators.buckets import slot_of, with_previous
from crowdpeak.settings import Settings

DEFAULT = Settings()
#: Windows of a recording that are summed up in one group. Their slots reach a few slots back into the block before.
BLOCK = 32


def previous_scene(scenes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Add the lines of the scene before, or an empty array if that scene is too far away or there is none."""
    return with_previous(scenes, "t", {"prev_lines": "lines", "prev_t": "t"}, s.scene_gap_sec).withColumn(
        "prev_lines", F.coalesce("prev_lines", F.array().cast("array<string>")))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length: the engine-side measure, used where an exact block match is not needed."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def _block_match_flags(threshold: float):
    @F.pandas_udf(T.BooleanType())
    def known(line: pd.Series, previous: pd.Series) -> pd.Series:
        def seen(text, others):
            for other in others:
                # Two cheap upper bounds settle most pairs. The order of the arguments matters to the measure.
                matcher = difflib.SequenceMatcher(None, text, other)
                if (matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold
                        and matcher.ratio() >= threshold):
                    return True
            return False
        return pd.Series([seen(a, b) for a, b in zip(line, previous)], dtype=bool)
    return known


def new_lines(scenes: DataFrame, s: Settings = DEFAULT, exact: bool = False) -> DataFrame:
    """`(video_id, t, line_no, line)` for every line that is not similar to any line of the scene before.

    Similarity is by edit distance, on the engine side. With `exact` it is the ratio of matching blocks: a line that is
    equal to an earlier one is dropped, and a scene without a predecessor is passed, on the engine side, and only the rest
    reaches Python, in Arrow batches.
    """
    rows = previous_scene(scenes, s).select(
        "video_id", "t", "prev_lines", F.posexplode("lines").alias("line_no", "line"))
    rows = rows.filter(~F.array_contains("prev_lines", F.col("line")))
    if exact:
        # The ratio is at most 2 * shorter / (both lengths), so only lines of similar length are handed to Python.
        n, m = F.length("line"), lambda p: F.length(p)
        rows = rows.withColumn("prev_lines", F.filter("prev_lines", lambda p: (
            2.0 * F.least(n, m(p)) / (n + m(p)) >= s.line_similarity)))
        close = _block_match_flags(s.line_similarity)(F.col("line"), F.col("prev_lines"))
    else:
        close = F.exists("prev_lines", lambda p: edit_similarity(F.col("line"), p) >= s.line_similarity)
    return rows.filter(~close).drop("prev_lines")


def _slots(lines: DataFrame, s: Settings) -> DataFrame:
    """Add the slot `j`, and `first`, the first window that holds the line: one earlier for a line on the edge of its slot."""
    steps = int(s.window_sec // s.step_sec)
    j = slot_of(F.col("t"), s.step_sec)
    edge = F.col("t") == F.col("j") * F.lit(s.step_sec)
    return lines.withColumn("j", j).withColumn("first", F.when(edge, F.col("j") - steps).otherwise(F.col("j") - (steps - 1)))


def _before_end(placed: DataFrame, videos: DataFrame) -> DataFrame:
    """Lines up to the end of their recording. Lengths are joined to slots, and lines to the slots, by `(video_id, j)`."""
    ends = videos.select("video_id", F.col("duration_sec").alias("_end"))
    slots = (placed.groupBy("video_id", "j").agg(F.min("t").alias("_first")).join(ends, "video_id")
             .filter(F.col("_first") <= F.col("_end")).select("video_id", "j", "_end"))
    return placed.join(slots, ["video_id", "j"]).filter(F.col("t") <= F.col("_end")).drop("_end")


def _window_sums(sizes: tuple[int, ...]):
    """Sums of the windows of a block, from the distinct lines of its slots."""
    def sums(block: pa.Table) -> pa.Table:
        video, slots = block.column("video_id").slice(0, 1).combine_chunks(), block.column("j").to_numpy()
        firsts, many = block.column("first").to_numpy(), block.column("_n").to_numpy()
        begin = block.column("block")[0].as_py() * BLOCK
        # Lines of one slot and edge are one part: they are in the same windows.
        parts, of = np.unique(np.stack([slots, firsts]), axis=1, return_inverse=True)
        of = of.ravel()
        vectors = np.zeros(parts.shape[1])
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        order = np.argsort(of, kind="stable")
        texts = block.column("_body").take(pa.array(order)).to_pylist()
        for start, some in text_slices(texts):
            rows = order[start : start + len(some)]
            owners, grams = gram_codes(some, sizes)
            owner, gram, n = counted(owners, grams)
            length = np.sqrt(np.bincount(owner, weights=n.astype(np.float64) ** 2, minlength=len(some)))
            weight = n / length[owner] * many[rows][owner]
            np.add.at(vectors, of[rows], np.where(length > 0, many[rows], 0))
            part = of[rows][owner]
            for p in np.unique(part):
                mine = part == p
                found, place = np.unique(gram[mine], return_inverse=True)
                held.setdefault(int(p), []).append((found, np.bincount(place, weights=weight[mine])))
        lines = np.bincount(of, weights=many, minlength=parts.shape[1])
        rows = []
        for k in range(begin, begin + BLOCK):
            inside = np.flatnonzero((parts[0] >= k) & (parts[1] <= k))
            if not len(inside):
                continue
            both = [x for p in inside for x in held.get(int(p), [])]
            square = 0.0
            if both:
                _, place = np.unique(np.concatenate([g for g, _ in both]), return_inverse=True)
                square = float((np.bincount(place, weights=np.concatenate([w for _, w in both])) ** 2).sum())
            rows.append((k, int(lines[inside].sum()), float(vectors[inside].sum()), square))
        return pa.table({"video_id": video.take(pa.array(np.zeros(len(rows), dtype=np.int64))), "k": pa.array([r[0] for r in rows], pa.int64()),
                         "chat_freq": pa.array([r[1] for r in rows], pa.int64()), "_vectors": pa.array([r[2] for r in rows], pa.float64()),
                         "_square": pa.array([r[3] for r in rows], pa.float64())})
    return sums


def line_scores(lines: DataFrame, windows: DataFrame, scenes: DataFrame | None = None,
                clip_to: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Number of new lines (`chat_freq`) and their mean pairwise cosine (`chat_conc`) for each window.

    With unit vectors, the sum over all pairs is (|sum of vectors|^2 - number of vectors) / 2, so no pair of lines is
    ever formed: every n-gram adds its weight to its slot, slots to their windows, and the sums are squared. That is done
    where the lines of a block of windows meet, so lines are shuffled and their n-grams are not. A line without spaces that
    is too short for an n-gram counts but has no vector. `has_lines` marks recordings in `scenes`.
    """
    placed = _slots(lines.select("video_id", "t", "line"), s)
    if clip_to is not None:
        placed = _before_end(placed, clip_to)
    body = F.regexp_replace(F.lower(F.replace(F.col("line"), F.lit(" "), F.lit(""))), r"(?U)\s\s+", " ")
    # Equal lines of a slot are one row; the windows of a recording meet in blocks, with the few slots before each block.
    counts = placed.select("video_id", "j", "first", body.alias("_body")).filter(
        "video_id IS NOT NULL AND j >= 0 AND _body IS NOT NULL").groupBy("video_id", "j", "first", "_body").agg(F.count("*").alias("_n"))
    blocks = counts.withColumn("block", F.explode(F.sequence(
        F.floor(F.greatest("first", F.lit(0)) / BLOCK), F.floor(F.col("j") / BLOCK))))
    schema = T.StructType([placed.schema["video_id"], *(T.StructField(n, t) for n, t in (
        ("k", T.LongType()), ("chat_freq", T.LongType()), ("_vectors", T.DoubleType()), ("_square", T.DoubleType())))])
    sums = blocks.groupBy("video_id", "block").applyInArrow(_window_sums(s.line_ngrams), schema)
    m = F.col("chat_freq")
    conc = (F.coalesce("_square", F.lit(0.0)) - F.coalesce("_vectors", F.lit(0.0))) / (m * (m - 1))
    out = (
        windows.join(sums, ["video_id", "k"], "left")
        .withColumn("chat_freq", F.coalesce("chat_freq", F.lit(0)))
        .withColumn("chat_conc", F.when(m >= s.line_min_count, conc))
        .drop("_square", "_vectors")
    )
    if scenes is None:
        return out.withColumn("has_lines", F.lit(True))
    present = scenes.select("video_id").distinct().withColumn("has_lines", F.lit(True))
    return out.join(present, "video_id", "left").withColumn("has_lines", F.coalesce("has_lines", F.lit(False)))
