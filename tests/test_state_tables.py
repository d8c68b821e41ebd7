"""The count classifier against plain counts, the job log against all its events, left groups of many edges."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from crowdpeak.operators import bayes, regions
from crowdpeak.operators.jobs import current_states
from crowdpeak.sources.job_log import JobLog


def test_bayes_equals_plain_counts(spark):
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("abcé " if k else "xyz ") for _ in range(rng.randrange(0, 9)))
    rows = [(word(i % 3 == 0), i % 3) for i in range(60)] + [("", 1), (None, 2), ("abc", None)]
    tests = [(i, word(i % 2)) for i in range(20)] + [(20, None), (21, ""), (22, "Ω"), (23, "ABC")]
    grams = lambda t: [t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)]
    kept = [(t, y) for t, y in rows if t is not None and y is not None]
    counts = {y: Counter(g for t, z in kept if z == y for g in grams(t.lower())) for y in range(3)}
    known = len(set().union(*counts.values()))
    want = {}
    for i, t in tests:
        found = grams((t or "").lower())
        for y in range(3):
            total = sum(counts[y].values()) + known
            want[i, y] = math.log(sum(z == y for _, z in kept) / len(kept)) + sum(math.log((counts[y][g] + 1) / total) for g in found)
    model = bayes.train_bayes(spark.createDataFrame(rows, "chat_message string, label int"))
    got = bayes.bayes_scores(model, spark.createDataFrame(tests, "doc_id long, chat_message string"), "doc_id").collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.score - want[r.doc_id, r.label]) < 1e-9
        best = max(range(3), key=lambda y: (round(want[r.doc_id, y], 9), -y))
        assert r.prediction == best


def test_job_log_reads_only_what_it_needs(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"j{rng.randrange(40)}", rng.choice(["queued", "done", "cancelled", "failed"]), i) for i in range(300)]
    events = spark.createDataFrame(rows, "video_id string, status string, updated_at long").withColumn(
        "created_at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.substring("video_id", 2, 2).cast("int") % 10, F.lit(5)))
    log = JobLog(spark, str(tmp_path))
    pick = lambda df: sorted(tuple(r) for r in df.select("video_id", "status", "updated_at", "created_at").collect())
    for part in range(4):
        log.append(events.filter(F.col("updated_at") % 4 == part), F.to_date(F.lit(f"2024-01-0{part + 1}")))
        assert pick(log.current()) == pick(current_states(events.filter(F.col("updated_at") % 4 <= part)))
        if part in (0, 2):
            log.compact()
            log.compact()  # nothing new: nothing happens
    log.compact()
    now = F.to_timestamp_ntz(F.lit("2024-01-06 09:00:00"))
    want = current_states(events)
    cut = "TIMESTAMP_NTZ '2024-01-06 05:00:00'"
    gone = log.expired(now)
    assert pick(gone) == pick(want.filter(f"created_at < {cut}")) and pick(gone)
    plan = gone._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_day" in plan and "created_day#" in plan.split("PartitionFilters:")[1].split("]")[0]
    log.forget(now)
    assert pick(log.current()) == pick(want.filter(f"created_at >= {cut}"))


def test_a_compaction_that_failed_is_run_again(spark, tmp_path):
    log = JobLog(spark, str(tmp_path))
    events = spark.createDataFrame([("a", "queued", 1), ("a", "done", 2), ("b", "cancelled", 1), ("b", "done", 3)], "video_id string, status string, updated_at long").withColumn(
        "created_at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    log.append(events, F.to_date("created_at"))
    log.compact()
    (tmp_path / "compacted" / "0").unlink()  # as if it had stopped before its mark
    log.compact()
    assert sorted((r.video_id, r.status) for r in log.current().collect()) == [("a", "done"), ("b", "cancelled")]


def test_left_groups_of_a_million_edges(spark):
    n = 1_000_000
    boxes = spark.range(n).select(F.lit("v").alias("video_id"), (F.col("id") / n).alias("xmin"))
    got = regions.left_groups(boxes).groupBy("group_left").agg(F.count("*").alias("n"), F.min("xmin").alias("low"), F.max("xmin").alias("high")).orderBy("group_left").collect()
    assert sum(r.n for r in got) == n
    for a, b in zip(got, got[1:]):
        assert a.low == a.group_left and a.high - a.group_left <= 0.03 < b.group_left - a.group_left


def test_bayes_shuffles_no_n_gram_of_a_text(spark):
    rows = [(i, "abcd " * (i % 7) + "xyz" * (i % 3), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, chat_message string, label int")
    model = bayes.train_bayes(df)
    whole = bayes.bayes_scores(model, df, "doc_id")
    small = bayes.bayes_scores(model, df, "doc_id", slice_chars=20)  # a slice per text or two: the same scores
    pick = lambda d: sorted((r.doc_id, r.label, round(r.score, 9), r.prediction) for r in d.collect())
    assert pick(whole) == pick(small) and len(pick(whole)) == 80
    assert dict(model.grams.dtypes)["gram"] == "bigint"  # counted in whole numbers inside tasks, not exploded as text
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan
