"""Live chat: windowed scores with late data, removal of replays, and refresh of candidates per micro-batch."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from crowdpeak.operators import candidates as cand
from crowdpeak.operators import grid
from crowdpeak.settings import Settings

DEFAULT = Settings()


def live_windows(chats: DataFrame, time: str = "ts", joy: str = "joy_pct", start: str | None = None,
                 late: str = "30 seconds", s: Settings = DEFAULT) -> DataFrame:
    """Sliding chat scores of a stream `(video_id, ts, joy_pct)`; rows later than `late` are dropped.

    A stream window excludes its end. Windows here include it, so the window is one microsecond, the resolution of a
    timestamp, longer. `start` is a column with the start of the broadcast; windows before it are left out.
    """
    keys = ["video_id"] + ([start] if start else [])
    length, step = f"{s.window_sec:g} seconds 1 microsecond", f"{s.step_sec:g} seconds"
    out = (
        chats.withWatermark(time, late)
        .groupBy(*keys, F.window(time, length, step))
        .agg(F.count("*").alias("chat_count"), F.avg(joy).alias("avg_joy"), F.max(joy).alias("max_joy"))
        .withColumn("window_start", F.col("window.start"))
        .withColumn("chat_score", F.col("avg_joy") * s.joy_mean_weight + F.col("max_joy") * s.joy_max_weight)
        .drop("window")
    )
    return out.filter(F.col("window_start") >= F.col(start)) if start else out


class BroadcastEnd(StatefulProcessor):
    """Windows of one recording from its closed slots, and its end after silence.

    State are the slots that windows still need, the next window, and the last chat. A window goes out when the watermark
    has passed it and a chat at or after its start shows that it is not cut. A timer runs `silence_ms` after the last chat;
    when it fires the broadcast is over: its length is known, the remaining windows go out, the last one cut, and only the
    mark that it is closed stays. Chat that comes later is not counted.
    """

    def __init__(self, silence_ms: int, s: Settings = DEFAULT):
        self.silence_ms, self.s = silence_ms, s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "j long", "n long, total double, top double, edge_n long, edge_total double, edge_top double")
        self.seen = handle.getValueState("seen", "begin_ms long, next_k long, last_ms long, last_t double, closed boolean")

    def _window(self, held: dict[int, tuple], k: int, end: float) -> Row:
        steps = int(self.s.window_sec // self.s.step_sec)
        parts = [held[j][:3] for j in range(k, k + steps) if j in held]
        if k + steps in held and held[k + steps][3]:
            parts.append(held[k + steps][3:])
        n = sum(p[0] for p in parts)
        tops = [p[2] for p in parts if p[2] is not None]
        avg = math.fsum(p[1] or 0.0 for p in parts) / n if n else 0.0
        score = avg * self.s.joy_mean_weight + max(tops) * self.s.joy_max_weight if tops else 0.0
        return Row(k=k, start_sec=k * self.s.step_sec, end_sec=end, chat_count=n, avg_joy=avg, chat_score=score)

    def _tuple(self, r: Any) -> tuple:
        return r.n, r.total, r.top, r.edge_n, r.edge_total, r.edge_top

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self.seen.get()
        begin, next_k, last_ms, last_t, closed = state if state is not None else (None, 0, 0, 0.0, False)
        if closed:
            return
        held = {k[0]: tuple(v) for k, v in self.slots.iterator()}
        before = last_ms
        for r in rows:
            begin = r.begin_ms
            new, old = self._tuple(r), held.get(r.j)
            if old is not None:  # a slot may come in two parts where a broadcast does not begin on a slot of the clock
                new = tuple(y if x is None else x if y is None else max(x, y) if i in (2, 5) else x + y for i, (x, y) in enumerate(zip(old, new)))
            held[r.j] = new
            self.slots.updateValue((r.j,), new)
            last_ms, last_t = max(last_ms, r.last_ms), max(last_t, r.last_t)
        if last_ms != before:
            if before:
                self.handle.deleteTimer(before + self.silence_ms)
            self.handle.registerTimer(last_ms + self.silence_ms)
        mark, step = timerValues.getCurrentWatermarkInMs(), self.s.step_sec
        while next_k * step <= last_t and begin + (next_k * step + self.s.window_sec + 2 * step) * 1000 <= mark:
            yield self._keyed(key, self._window(held, next_k, next_k * step + self.s.window_sec))
            if next_k in held:
                self.slots.removeKey((next_k,))
            next_k += 1
        self.seen.update((begin, next_k, last_ms, last_t, False))

    def _keyed(self, key: Any, window: Row) -> Row:
        return Row(video_id=key[0], **window.asDict())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        begin, next_k, last_ms, last_t, closed = self.seen.get()
        if closed or expiredTimerInfo.getExpiryTimeInMs() != last_ms + self.silence_ms:
            return
        s = self.s
        duration = math.floor((last_t + s.duration_margin_sec + 1e-9) * 100 + 0.5) / 100
        reach = duration + s.step_sec - s.window_sec
        count = min(math.floor(reach / s.step_sec) + 1, math.ceil(duration / s.step_sec)) if reach >= 0 else 0
        held = {k[0]: tuple(v) for k, v in self.slots.iterator()}
        for k in range(next_k, count):
            yield self._keyed(key, self._window(held, k, min(k * s.step_sec + s.window_sec, duration)))
        self.slots.clear()
        self.seen.update((begin, count, last_ms, last_t, True))

    def close(self) -> None:
        pass


def broadcast_windows(chats: DataFrame, silence_sec: float = 600.0, time: str = "ts", joy: str = "joy_pct", begin: str = "begin",
                      late: str = "30 seconds", s: Settings = DEFAULT) -> DataFrame:
    """All windows of `grid.window_grid` from a stream `(video_id, ts, begin, joy_pct)`, also empty ones and the cut last one.

    `begin` is the start of the broadcast. Chat is first summed up per slot (partial sums leave each task), so the keyed
    state sees at most two rows per slot of a recording. A broadcast is over when the watermark has passed its last chat by
    `silence_sec`; other recordings, or rows without `video_id`, move the watermark on. The session needs a state store
    with column families: see `use_keyed_state`.
    """
    since = (F.unix_micros(time) - F.unix_micros(begin)) / F.lit(1e6)
    j = F.floor(since / s.step_sec).cast("long")
    edge = (F.unix_micros(time) - F.unix_micros(begin)) % F.lit(int(s.step_sec * 1_000_000)) == 0
    slots = (
        chats.withWatermark(time, late).filter("video_id IS NOT NULL")
        .groupBy("video_id", F.unix_millis(begin).alias("begin_ms"), j.alias("j"), F.window(time, f"{s.step_sec:g} seconds"))
        .agg(F.count("*").alias("n"), F.sum(joy).alias("total"), F.max(joy).alias("top"), F.count_if(edge).alias("edge_n"),
             F.sum(F.when(edge, F.col(joy))).alias("edge_total"), F.max(F.when(edge, F.col(joy))).alias("edge_top"),
             F.max(since).alias("last_t"), F.max(F.unix_millis(time)).alias("last_ms"))
        .select("*", F.window_time("window").alias("slot_time")).drop("window")
    )
    return slots.groupBy("video_id").transformWithState(
        BroadcastEnd(int(silence_sec * 1000), s),
        "video_id string, k long, start_sec double, end_sec double, chat_count long, avg_joy double, chat_score double",
        outputMode="append", timeMode="eventTime")


def use_keyed_state(spark: SparkSession) -> None:
    """Streams started afterwards keep their state in the store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def without_replays(chats: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each (recording, time, message) once, as long as a repeat arrives within `late` of the first."""
    return chats.withWatermark(time, late).dropDuplicatesWithinWatermark(["video_id", "time_ms", "chat_message"])


class SlotState:
    """Slot sums of recordings between micro-batches: a table in `folder`, in `buckets` parts by recording.

    A batch reads the parts of the recordings it touches, adds its own sums and writes these parts anew under its number.
    It reads only what batches before it wrote, so a batch that is run again after a failure adds its rows once. The part
    before is kept for that; older ones are deleted. No chat row is kept or read again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = self.place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, path, name: str) -> list[int]:
        """Numbers of the folders `name=<number>`. Of batches there are a few at a time, of parts at most `buckets`."""
        if not self.files.exists(path):
            return []
        found = [f.getPath().getName() for f in self.files.listStatus(path)]
        return sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}="))

    def _path(self, batch: int, bucket: int | None = None):
        tail = f"batch={batch}" + ("" if bucket is None else f"/bucket={bucket}")
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{tail}")

    def _versions(self, batch_id: int) -> dict[int, list[int]]:
        """For each part the whole batches before `batch_id` that wrote it, the last one first."""
        out: dict[int, list[int]] = {}
        for batch in reversed(self._numbers(self.place, "batch")):
            whole = self.files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch}/_SUCCESS"))
            if batch < batch_id and whole:
                for bucket in self._numbers(self._path(batch), "bucket"):
                    out.setdefault(bucket, []).append(batch)
        return out

    def add(self, sums: DataFrame, batch_id: int) -> DataFrame:
        """Adds the slot sums of a batch; returns all slots of the recordings in it."""
        keyed = sums.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(self.buckets)).cast("int"))
        touched = [r.bucket for r in keyed.select("bucket").distinct().collect()]
        versions = self._versions(batch_id)
        before = [f"{self.folder}/batch={versions[b][0]}/bucket={b}" for b in touched if b in versions]
        whole = keyed
        if before:
            known = self.spark.read.option("basePath", self.folder).parquet(*before).drop("batch")
            whole = keyed.unionByName(known.select(keyed.columns))
        merged = grid.merge_slots(whole).withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(self.buckets)).cast("int"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={batch_id}")
        for bucket in touched:
            for old in versions.get(bucket, [])[1:]:
                self.files.delete(self._path(old, bucket), True)
        return self.spark.read.schema(merged.schema).parquet(f"{self.folder}/batch={batch_id}").drop("bucket").join(
            sums.select("video_id").distinct(), "video_id", "left_semi")


def candidate_refresh(state: SlotState, sink: str, s: Settings = DEFAULT):
    """A `foreachBatch` function: recompute the candidates of the recordings a micro-batch touches.

    Thresholds and merged intervals depend on the whole recording, and so on all its slot sums, which `state` holds: a
    batch costs its own rows and the slots of the recordings it touches, however many rows came before. It overwrites its
    own folder in `sink`, so a batch that is run again does not repeat its rows.
    """
    def refresh(batch: DataFrame, batch_id: int) -> None:
        slots = state.add(grid.slot_sums(batch, "joy_pct", s=s), batch_id)
        stats = grid.stats_of_slots(slots, s)
        windows = grid.scored_windows(grid.windows_of_slots(slots, s), grid.window_grid(stats, s), s)
        found = cand.first_stage(cand.chat_candidates(windows), s)
        number = F.lit(batch_id).cast("long")
        found.withColumn("batch_id", number).write.mode("overwrite").parquet(f"{sink}/candidates/batch_{batch_id}")
        stats.select("video_id").withColumn("batch_id", number).write.mode("overwrite").parquet(f"{sink}/touched/batch_{batch_id}")
    return refresh


def latest_candidates(written: DataFrame, touched: DataFrame) -> DataFrame:
    """Candidates of the last batch that touched each recording; none if that batch found none."""
    last = touched.groupBy("video_id").agg(F.max("batch_id").alias("batch_id"))
    return written.join(last, ["video_id", "batch_id"], "left_semi")
