"""Keyed state between micro-batches and the end of a broadcast, against batch results over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from crowdpeak.operators import grid
from crowdpeak.streaming import live

SCHEMA = "video_id string, t double, joy_pct double"


def some_chats(n=400, seed=1):
    rng = random.Random(seed)
    return [(f"v{rng.randrange(3)}", rng.choice([rng.randrange(40) * 5.0, round(rng.uniform(0, 200), 3)]), round(rng.uniform(0, 100), 2)) for _ in range(n)]


def slots_by_key(df):
    return {(r.video_id, r.j): (r.n, round(r.total, 6), r.top, r.edge_n, r.edge_top, r.last_t, round(r.spread + 1e-7, 4)) for r in df.collect()}


def test_slot_state_adds_each_batch_once_and_drops_old_parts(spark, tmp_path):
    rows = some_chats()
    parts = [spark.createDataFrame(rows[i::3], SCHEMA) for i in range(3)]
    state = live.SlotState(spark, f"{tmp_path}/slots", buckets=2)
    for i in (0, 1, 1, 2, 2):  # batches 1 and 2 are run again, as after a failure
        got = state.add(grid.slot_sums(parts[i], "joy_pct"), i)
        want = spark.createDataFrame([r for k in range(i + 1) for r in rows[k::3]], SCHEMA)
        assert slots_by_key(got) == slots_by_key(grid.slot_sums(want, "joy_pct"))
    kept = {p.parent.name for p in (tmp_path / "slots").glob("batch=*/bucket=*")}
    assert kept == {"batch=1", "batch=2"}


def test_a_batch_that_was_not_finished_is_not_read(spark, tmp_path):
    rows = spark.createDataFrame(some_chats(), SCHEMA)
    state = live.SlotState(spark, f"{tmp_path}/slots", buckets=2)
    sums = grid.slot_sums(rows, "joy_pct")
    state.add(sums, 0)
    (tmp_path / "slots" / "batch=0" / "_SUCCESS").unlink()
    assert slots_by_key(state.add(sums, 1)) == slots_by_key(sums)


def test_slots_give_the_statistics_and_windows_of_the_rows(spark):
    rows = spark.createDataFrame(some_chats() + [("still", 3.0, 7.0), ("still", 400.0, 7.0)], SCHEMA)
    slots = grid.slot_sums(rows, "joy_pct")
    fields = ["video_id", "total_chats", "duration_sec", "mean_joy", "std_joy", "calculated_threshold"]
    key = lambda df: sorted(tuple(r) for r in df.select(fields).collect())
    assert key(grid.stats_of_slots(slots)) == key(grid.video_stats(rows))
    sums = lambda df: sorted((r.video_id, r.k, r.n, round(r.total, 6), r.top) for r in df.collect())
    assert sums(grid.windows_of_slots(slots)) == sums(grid.closed_window_sums(rows, "joy_pct"))


def test_a_refresh_reads_no_chat_rows_of_earlier_batches(spark, tmp_path):
    """What a batch reads are its own rows and files of the slot state: earlier input may be gone."""
    refresh = live.candidate_refresh(live.SlotState(spark, f"{tmp_path}/slots", buckets=2), f"{tmp_path}/out")
    rows = some_chats()
    for i in range(2):
        spark.createDataFrame(rows[i::2], SCHEMA).write.parquet(f"{tmp_path}/in{i}")
        refresh(spark.read.parquet(f"{tmp_path}/in{i}"), i)
        for f in (tmp_path / f"in{i}").iterdir():
            f.unlink()
    read = spark.read.option("recursiveFileLookup", "true")
    last = live.latest_candidates(read.parquet(f"{tmp_path}/out/candidates"), read.parquet(f"{tmp_path}/out/touched"))
    whole = spark.createDataFrame(rows, SCHEMA)
    stats = grid.video_stats(whole)
    from crowdpeak.operators import candidates as cand
    want = cand.first_stage(cand.chat_candidates(grid.chat_scores(whole, grid.window_grid(stats), stats)))
    pick = lambda df: sorted((r.video_id, r.start_time, r.end_time, r.window_score, r.chat_count) for r in df.collect())
    assert pick(last) == pick(want) and pick(want)


@pytest.mark.parametrize("begin_sec", [0.0, 7.3])
def test_broadcast_ends_after_silence(spark, tmp_path, begin_sec):
    rng = random.Random(4)
    t = sorted([0.0, 30.0, 35.0, *[round(rng.uniform(0, 90), 2) for _ in range(30)], *[round(rng.uniform(300, 372), 2) for _ in range(20)]])
    rows = [("a", begin_sec + x, 1.0 * i) for i, x in enumerate(t)]
    silent = [("b", begin_sec + 372 + 650, 1.0)]  # moves the watermark on, so that `a` ends
    late = [("a", begin_sec + 372 + 700, 50.0), ("b", begin_sec + 5000, 1.0), (None, begin_sec + 20_000, 1.0)]
    live.use_keyed_state(spark)
    try:
        for part in (rows[:25], rows[25:], silent, late):
            spark.createDataFrame(part, "video_id string, s double, joy_pct double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            raw = spark.readStream.schema("video_id string, s double, joy_pct double").parquet(f"{tmp_path}/in").select(
                "video_id", "joy_pct", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long")).alias("ts"), F.timestamp_micros(F.lit(int(begin_sec * 1e6))).alias("begin"))
            live.broadcast_windows(raw, silence_sec=600).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option(
                "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    chats = spark.createDataFrame([("a", x, 1.0 * i) for i, x in enumerate(t)], SCHEMA)
    stats = grid.video_stats(chats)
    pick = lambda df: sorted((r.k, r.start_sec, r.end_sec, r.chat_count, round(r.chat_score, 6)) for r in df.collect())
    assert pick(spark.read.parquet(f"{tmp_path}/out").filter("video_id = 'a'")) == pick(grid.chat_scores(chats, grid.window_grid(stats), stats))
