"""Buckets, regions, emotion rules, data sets, jobs and sources on small tables."""

import random

from pyspark.sql import functions as F

from crowdpeak.functions import emotion, text
from crowdpeak.operators import buckets, dataset, jobs, regions, report
from crowdpeak.sources import ingest, tables


def test_asof_against_brute_force(spark):
    rng = random.Random(1)
    right = [(v, float(rng.randrange(3000)), i) for i, v in enumerate(rng.choices(["hot", "b"], [9, 1], k=400))]
    left = [(v, rng.uniform(0, 3000), i) for i, v in enumerate(rng.choices(["hot", "b", "none"], k=300))]
    out = buckets.asof_last(spark.createDataFrame(left, "video_id string, cur double, id int"),
                            spark.createDataFrame(right, "video_id string, t double, n int"), "n", "cur", tie="n")
    got = {r.id: r.last_value for r in out.collect()}
    for v, cur, i in left:
        before = [(t, n) for w, t, n in right if w == v and t <= cur]
        assert got[i] == (max(before)[1] if before else None)


def test_first_rows_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randrange(10**6), i) for i in range(3000)] + [("cold", rng.randrange(10**6), i) for i in range(5)]
    df = spark.createDataFrame(rows, "video_id string, time_ms long, n int")
    got = ingest.first_messages(df, 700, tie="n").collect()
    for key in ("hot", "cold"):
        want = sorted((t, n) for k, t, n in rows if k == key)[:700]
        assert sorted((r.row_no, r.time_ms, r.n) for r in got if r.video_id == key) == [
            (i + 1, t, n) for i, (t, n) in enumerate(want)]


def test_previous_row_across_buckets(spark):
    rows = [("a", float(t)) for t in (0, 5, 595, 600, 606, 1199, 1207, 1214)]
    out = buckets.with_previous(spark.createDataFrame(rows, "video_id string, t double"), "t", {"p": "t"}, 7.5)
    assert sorted((r.t, r.p) for r in out.collect()) == [
        (0, None), (5, 0), (595, None), (600, 595), (606, 600), (1199, None), (1207, None), (1214, 1207)]


def test_interval_joins_against_brute_force(spark):
    rng = random.Random(3)
    points = [("a", rng.choice([rng.uniform(0, 500), 10.0 * rng.randrange(50)]), i) for i in range(300)]
    spans = [("a", 10.0 * s, 10.0 * s + rng.choice([0, 30, 130])) for s in rng.sample(range(45), 12)]
    p = spark.createDataFrame(points, "video_id string, t double, id int")
    s = spark.createDataFrame(spans, "video_id string, start_time double, end_time double")
    pairs = sorted((r.id, r.start_time) for r in buckets.interval_join(p, s).collect())
    assert pairs == sorted((i, a) for _, t, i in points for _, a, b in spans if a <= t <= b)
    assert sorted(r.id for r in buckets.points_in_any(p, s).collect()) == sorted({i for i, _ in pairs})


def random_boxes(seed, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = (rng.randrange(1, 9) / 64, rng.randrange(1, 9) / 64, rng.choice([1, 2, 3, 4, 8, 16]) / 64,
                      rng.choice([1, 2, 3, 4, 8]) / 64)
        out.append(("a", rng.randrange(6), i, x, y, x + w, y + h, rng.choice(["x", "y", ""])))
    return out


BOX = ("video_id string, frame int, box_idx int, xmin double, ymin double, xmax double, ymax double, text string")


def test_fixed_boxes_against_all_pairs(spark):
    boxes = random_boxes(4)

    def overlap(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        inter = max(0.0, w) * max(0.0, h)
        union = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - inter
        return inter / union

    frames = len({b[1] for b in boxes})
    moving = set()
    for a in boxes:
        same = {b[1] for b in boxes if b[1] != a[1] and b[7] == a[7] and overlap(a, b) >= 0.5}
        if not (a[7] and len(same) >= 0.5 * (frames - 1)):
            moving.add(a[2])
    got = {r.box_idx for r in regions.moving_boxes(spark.createDataFrame(boxes, BOX)).collect()}
    assert got == moving and 0 < len(moving) < len(boxes)


def test_few_boxes_give_the_default_region(spark):
    row = regions.voted_region(spark.createDataFrame(random_boxes(5, 2), BOX)).first()
    assert (row.side, row.region_ymin, row.region_xmin, row.region_ymax, row.region_xmax) == ("default", 0.15, 0.65, 0.95, 0.98)


def test_chat_column_is_found(spark):
    rng = random.Random(6)
    boxes = [("a", f, f * 100 + i, 0.7 + rng.choice([0, 0.01]), 0.3 + 0.03 * i, 0.9, 0.32 + 0.03 * i, f"line {f} {i}")
             for f in range(10) for i in range(12)]
    boxes += [("a", f, f * 100 + 50, 0.1, 0.05, 0.3, 0.07, "title") for f in range(10)]
    row = regions.chat_regions(spark.createDataFrame(boxes, BOX)).first()
    assert row.method == "lines"
    assert (row.region_ymin, row.region_xmin, row.region_ymax, row.region_xmax) == (0.25, 0.68, 0.7, 0.92)


def test_left_edges_group_by_the_first_edge(spark):
    boxes = [("a", 0, i, x, 0.1, x + 0.1, 0.2, "t") for i, x in enumerate([0.10, 0.12, 0.14, 0.16, 0.30])]
    out = {r.xmin: r.group_left for r in regions.left_groups(spark.createDataFrame(boxes, BOX)).collect()}
    assert out == {0.10: 0.10, 0.12: 0.10, 0.14: 0.14, 0.16: 0.14, 0.30: 0.30}


def test_boxes_meet_their_edges_unsorted(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), i, rng.choice([None, rng.randrange(40) / 64]), 0.1, 0.9, 0.1 + rng.choice([1, 2, 3]) / 64, "t")
            for i in range(300)]
    grouped = regions.left_groups(spark.createDataFrame(rows, BOX))
    want = {}
    for video in ("a", "b"):
        left = None
        for x in sorted({r[3] for r in rows if r[0] == video and r[3] is not None}):
            left = x if left is None or x - left > 0.03 else left
            want.update({r[2]: left for r in rows if r[0] == video and r[3] == x})
    assert {r.box_idx: r.group_left for r in grouped.collect()} == want and grouped.count() == len(want)
    for r in regions.refined_groups(grouped).collect():
        mine = sorted(b[6] - b[4] for b in rows if b[0] == r.video_id and want.get(b[2]) == r.group_left)
        assert abs(r.median_height - (mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2) < 1e-12
    # Neither the join with the edges nor the median sorts or hashes every box: that took 1.2 GB in a task of 4 million boxes.
    plan = regions.refined_groups(grouped)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [video_id" in plan and "_height" not in "".join(x for x in plan.splitlines() if " HashAggregate(" in x)


def even(spark, texts):
    return spark.createDataFrame([(i, t, [0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.4]) for i, t in enumerate(texts)],
                                 "id int, chat_text string, probs array<double>")


def test_context_rules(spark):
    out = {r.chat_text: [round(x, 4) for x in r.probs] for r in emotion.context_boost(
        even(spark, ["나이스 ㅋㅋ", "에휴 ㅋ", "에휴", "ㅠㅠ", "?? 뭐지", "그냥"])).collect()}
    assert out["그냥"] == [0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.4]
    assert out["나이스 ㅋㅋ"] == [0.4, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]
    raw = [0.01, 0.205, 0.345, 0.1, 0.1, 0.1, 0.05]
    assert out["에휴 ㅋ"] == [round(x / sum(raw), 4) for x in raw]
    raw = [0.1, 0.1, 0.5, 0.1, 0.1, 0.1, 0.01]
    assert out["에휴"] == [round(x / sum(raw), 4) for x in raw]
    assert out["ㅠㅠ"][3] == 0.4 and out["?? 뭐지"][1] == 0.4


def test_guardrails(spark):
    out = {r.chat_text: (r.pred_label_idx, r.confidence) for r in emotion.guardrails(
        even(spark, ["???", "!!", "대박이야??", "대박!", "뇌절", "극혐", "  ", "음"])).collect()}
    assert out == {"???": (1, 85.0), "!!": (0, 85.0), "대박이야??": (1, 75.0), "대박!": (0, 85.0), "뇌절": (2, 80.0),
                   "극혐": (4, 80.0), "음": (6, 40.0)}


def test_quality_lines_and_repeats(spark):
    df = spark.createDataFrame([("와 진짜 대박",), ("가 나 다",), ("123 !!",), ("ㅋㅋㅋ",), ("안녕 뷁",), ("",)], "line string")
    assert [r.good for r in df.select(text.is_quality_line(F.col("line")).alias("good")).collect()] == [
        True, False, False, True, True, False]
    said = spark.createDataFrame([("아이고 아이고, 아이고! 아이고 네 아이고",), ("- - - - -",)], "s string")
    assert [r.c for r in said.select(text.collapse_repeats(F.col("s")).alias("c")).collect()] == [
        "아이고 아이고, 아이고! 네 아이고", "- - -"]


def test_times_and_links(spark):
    raw = spark.createDataFrame([(x,) for x in ["12.5", "-1", "1e3", "", ".5", "7."]], "x string")
    assert [r.t for r in raw.select(text.seconds_or_zero(F.col("x")).alias("t")).collect()] == [12.5, 0.0, 0.0, 0.0, 0.5, 7.0]
    links = spark.createDataFrame([(u,) for u in [
        "https://youtu.be/AbC_1", "https://www.youtube.com/shorts/XyZ?x=1", "https://www.youtube.com/watch?v=Q-1&t=3",
        "https://chzzk.naver.com/video/123"]], "u string")
    got = links.select(text.share_link_id(F.col("u")).alias("s"), text.recording_number(F.col("u")).alias("n"),
                       text.platform_of(F.col("u")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("AbC_1", None, "youtube"), ("XyZ", None, "youtube"), ("Q-1", None, "youtube"),
                                       (None, "123", "chzzk")]


def test_split_and_oversampling(spark):
    rows = [(i, f"m{i}", 0 if i < 900 else 1 if i < 960 else 6) for i in range(1003)]
    df = spark.createDataFrame(rows, "id long, chat_message string, label int")
    split = dataset.stratified_split(df, "id")
    counts = {(r.label, r.is_test): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
    assert counts == {(0, True): 180, (0, False): 720, (1, True): 12, (1, False): 48, (6, True): 9, (6, False): 34}
    grown = dataset.oversample(df, "id")
    assert {r.label: r["count"] for r in grown.groupBy("label").count().collect()} == {0: 1200, 1: 1200, 6: 43}


def test_first_copy_wins(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, "b", 3)], "id long, chat_message string, label int")
    assert {(r.id, r.label) for r in dataset.first_of_each(df, "chat_message", "id").collect()} == {(1, 2), (2, 3)}


def test_cancelled_stays_cancelled(spark):
    rows = [("a", "queued", 1), ("a", "cancelled", 2), ("a", "failed", 3), ("b", "queued", 1), ("b", "done", 2)]
    out = jobs.current_states(spark.createDataFrame(rows, "video_id string, status string, updated_at long"))
    assert {r.video_id: r.status for r in out.collect()} == {"a": "cancelled", "b": "done"}


def test_reaction_score_edge_cases(spark):
    flat = [("flat", float(t), 10.0) for t in range(0, 100, 2)]
    chats = spark.createDataFrame(flat + [("sparse", 500.0, 1.0)], "video_id string, t double, joy_pct double")
    found = spark.createDataFrame([("flat", 0.0, 60.0, 70.0), ("nochat", 0.0, 30.0, 42.0)],
                                  "video_id string, start_time double, end_time double, final_highlight_score double")
    videos = spark.createDataFrame([("flat",), ("nochat",), ("sparse",)], "video_id string")
    out = {r.video_id: r.score for r in report.reaction_score(chats, found, videos).collect()}
    assert out == {"flat": 50.0, "nochat": 42.0, "sparse": 0.0}


def test_chat_file_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "talk_extracted_ocr_chats.csv"
    path.write_text('﻿timestamp,frame,chat_text\n4.0,120,"와, 대박"\nx,1,네\n', encoding="utf-8")
    got = tables.read_chat_csv(spark, str(path)).collect()
    assert [tuple(r) for r in got] == [("talk", 4.0, 120, "와, 대박"), ("talk", 0.0, 1, "네")]


def test_label_files_without_the_columns_are_skipped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time_ms,chat_message,label\n1,hi,2\n2,yo,.\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("label,chat_message\n5,no\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("label,text\n5,no\n", encoding="utf-8")
    raw = ingest.read_label_files(spark, str(tmp_path / "*.csv"))
    assert raw.count() == 3
    assert sorted((r.chat_message, r.label) for r in dataset.clean_labels(raw).collect()) == [("hi", 2), ("no", 5)]


def test_chat_files_with_other_column_orders_and_bad_frames(spark, tmp_path):
    from crowdpeak.sources import tables

    (tmp_path / "a_extracted_ocr_chats.csv").write_text("timestamp,frame,chat_text\n1.5,10,hello\n2,n/a,you\n")
    (tmp_path / "b_extracted_ocr_chats.csv").write_text("chat_text,timestamp,frame\nthere,3,12.0\n")
    got = sorted(tuple(r) for r in tables.read_chat_csv(spark, str(tmp_path)).select("video_id", "t", "chat_text").collect())
    assert got == [("a", 1.5, "hello"), ("a", 2.0, "you"), ("b", 3.0, "there")]


def test_labels_out_of_range_are_dropped(spark):
    from crowdpeak.operators import dataset

    raw = spark.createDataFrame([("a", "5e9"), ("b", "inf"), ("c", "99999999999"), ("d", "3"), ("e", "nan"), ("f", "6.9")],
                                "chat_message string, label string")
    assert sorted(tuple(r) for r in dataset.clean_labels(raw).collect()) == [("d", 3), ("f", 6)]
    assert {(r.label, r.rows) for r in dataset.label_statistics(raw).collect()} == {(3, 1), (6, 1)}


def test_a_batch_without_candidates_takes_back_those_of_the_batch_before(spark):
    from crowdpeak.streaming import live

    written = spark.createDataFrame([("v", 0, 1.0), ("w", 0, 2.0)], "video_id string, batch_id long, start_time double")
    touched = spark.createDataFrame([("v", 0), ("w", 0), ("v", 1)], "video_id string, batch_id long")
    assert [r.video_id for r in live.latest_candidates(written, touched).collect()] == ["w"]


def test_first_rows_without_a_limit_numbers_all(spark):
    from pyspark.sql import functions as F

    from crowdpeak.operators.buckets import first_rows

    df = spark.range(50).withColumn("k", F.lit("a"))
    got = first_rows(df, "k", ["id"], None, F.floor(F.col("id") / 7).cast("long"))
    assert sorted((r.id, r.row_no) for r in got.collect()) == [(i, i + 1) for i in range(50)]


def test_frames_without_text_count_as_read(spark):
    label = [("a", f, 0, 0.1, 0.1, 0.2, 0.15, "live") for f in range(4)]
    other = [("a", f, 1, 0.6, 0.1 * f, 0.7, 0.1 * f + 0.05, f"text {f}") for f in range(6)]
    boxes = spark.createDataFrame(label + other, BOX)

    def read(n):
        return spark.createDataFrame([("a", n)], "video_id string, n_frames long")

    assert [r.text for r in regions.fixed_boxes(boxes).collect()] == ["live"]
    assert [r.text for r in regions.fixed_boxes(boxes, frames=read(6)).collect()] == ["live"]
    assert regions.fixed_boxes(boxes, frames=read(20)).collect() == []


def test_recordings_without_boxes_get_the_default_region(spark):
    boxes = spark.createDataFrame([("a", 0, 0, 0.8, 0.1, 0.9, 0.15, "hi")], BOX)
    videos = spark.createDataFrame([("a",), ("none",)], "video_id string")
    for early in (None, boxes.filter("frame > 5")):
        rows = regions.chat_regions(boxes, videos=videos, early=early).collect()
        assert sorted(r.video_id for r in rows) == ["a", "none"]
        assert {r.method for r in rows} == {"vote_default"} and len({tuple(r)[1:] for r in rows}) == 1


def test_fixed_boxes_meet_once_by_text(spark, monkeypatch):
    rng = random.Random(11)
    rows = [("a", f, 10 * f + i, rng.randrange(4) / 10, rng.randrange(6) / 10, None, None, "hud") for f in range(5) for i in range(10)]
    rows = [(*r[:5], None if r[2] % 17 == 0 else r[3] + 0.2, r[4] + 0.1, r[7]) for r in rows] + [(None, 1, 1, 0.0, 0.0, 1.0, 1.0, "hud"), ("a", None, 2, 0.0, 0.0, 0.2, 0.1, "hud")]
    boxes = spark.createDataFrame(rows, BOX)
    fixed = regions.fixed_boxes(boxes)
    plan = fixed._jdf.queryExecution().executedPlan().toString()
    assert "class" not in plan  # boxes are shuffled once and not once for each cell they ask in
    got = {tuple(r) for r in fixed.collect()}
    monkeypatch.setattr(regions, "PIECE", 7)  # pairs in pieces of a row each: the same
    assert {tuple(r) for r in regions.fixed_boxes(boxes).collect()} == got and got

    def overlap(a, b):
        if a == b:
            return 1.0
        if None in a + b:
            return 0.0
        inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)

    want = set()
    for shape in {r[3:7] for r in rows if r[0]}:
        frames = {r[1] for r in rows if r[0] and r[1] is not None and overlap(shape, r[3:7]) >= 0.5}
        if len(frames) - 1 >= 2:
            want.add(("a", "hud", *shape, len(frames) - 1))
    assert got == want


def test_gram_counts_are_those_of_spark_ml(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer

    from crowdpeak.functions.gram_features import GramCounts

    rng = random.Random(11)
    letters = "abcXYZ 09\n\tÄßéİ漢字ひらがな😀𝄞"
    rows = [(i, "".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 40, 300])))) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, chat_message string")
    plain = Pipeline(stages=[
        RegexTokenizer(inputCol="chat_message", outputCol="_chars", gaps=False, pattern=r"(?s).", toLowercase=True, minTokenLength=1),
        NGram(n=2, inputCol="_chars", outputCol="_two"), NGram(n=3, inputCol="_chars", outputCol="_three"),
        SQLTransformer(statement="SELECT *, concat(_two, _three) AS _grams FROM __THIS__"),
        HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=1 << 14)]).fit(df).transform(df)
    counted = GramCounts(inputCol="chat_message", outputCol="_tf", numFeatures=1 << 14)
    assert {r.i: r._tf for r in counted.transform(df).collect()} == {r.i: r._tf for r in plain.collect()}
    assert counted.transform(spark.createDataFrame([(None,)], "chat_message string")).first()._tf.numNonzeros() == 0


def test_classifier_counts_n_grams_in_arrow_batches(spark):
    rows = [(i, ("good " if i % 2 else "bad ") * (1 + i % 5), i % 2) for i in range(60)] + [(60, None, 0), (61, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, chat_message string, label int")
    out = dataset.classify(dataset.train_classifier(df.filter("doc_id < 40")), df)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == list(range(62)) and all(abs(sum(r.probs) - 1) < 1e-6 for r in got)
    assert all(r.prediction == r.label for r in got if r.doc_id < 60)
    # No list of n-grams as text is made of a text: that took 2.3 seconds for each megabyte.
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
