"""Job events as an append-only log with a compacted state: retention and lookups read days, not the whole history.

`events/day=…/segment=…` holds what was appended; `state/created_day=…` holds the last event of each job, by the day the job
was made, which never changes. A compaction reads the segments after the last one it took in and the state of the days
their jobs were made on, and overwrites those days. Taking an event in twice changes nothing, so a compaction that failed
half-way is simply run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdpeak.operators.jobs import current_states
from crowdpeak.session import cut_lineage
from crowdpeak.settings import Settings

DEFAULT = Settings()


class JobLog:
    """Log and state in `folder`. Events have at least `video_id`, `status`, `updated_at` and `created_at` of their job.

    One writer at a time appends or compacts; readers see whole segments and whole days."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda tail: path(f"{folder}/{tail}")
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, tail: str) -> list[str]:
        place = self._path(tail)
        return [f.getPath().getName() for f in self.files.listStatus(place)] if self.files.exists(place) else []

    def _last(self, tail: str) -> int:
        """The highest number among the marks in a folder, -1 without any."""
        return max((int(n) for n in self._names(tail) if n.isdigit()), default=-1)

    def append(self, events: DataFrame, day: Column) -> None:
        """Adds events as the next segment, under `day` (any date that events of a period share), one file each."""
        segment = self._last("appended") + 1
        events.withColumn("day", day.cast("date")).withColumn("segment", F.lit(segment)).repartition("day").write.mode(
            "append").partitionBy("day", "segment").parquet(f"{self.folder}/events")
        self.files.create(self._path(f"appended/{segment}"), True).close()

    def events(self, after: int = -1) -> DataFrame:
        """Events of whole segments after a number."""
        read = self.spark.read.parquet(f"{self.folder}/events")
        return read.filter((F.col("segment") > after) & (F.col("segment") <= self._last("appended")))

    def state(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/state") if self._names("state") else None

    @staticmethod
    def _plain(events: DataFrame) -> DataFrame:
        return events.drop("day", "segment").withColumn("created_day", F.to_date("created_at"))

    def compact(self) -> None:
        """Takes the segments since the last compaction into the state of the days their jobs were made on."""
        last, upto = self._last("compacted"), self._last("appended")
        if last == upto:
            return
        fresh = current_states(self._plain(self.events(last)))
        known = self.state()
        if known is not None:
            days = [r.created_day for r in fresh.select("created_day").distinct().collect()]
            fresh = current_states(fresh.unionByName(known.filter(F.col("created_day").isin(days)).select(fresh.columns)))
        cut_lineage(fresh).repartition("created_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "created_day").parquet(f"{self.folder}/state")
        self.files.create(self._path(f"compacted/{upto}"), True).close()

    def current(self) -> DataFrame:
        """The state of all jobs, with the events that are not compacted yet."""
        late, known = self._plain(self.events(self._last("compacted"))), self.state()
        both = late if known is None else known.unionByName(late.select(known.columns))
        return current_states(both).drop("created_day")

    def _cutoff(self, now: Column, s: Settings) -> Column:
        return now - F.make_dt_interval(hours=F.lit(s.retention_hours))

    def expired(self, now: Column, s: Settings = DEFAULT) -> DataFrame:
        """Jobs made too long ago, from the compacted state: only days up to the cut are read."""
        cutoff = self._cutoff(now, s)
        return self.state().filter((F.col("created_day") <= F.to_date(cutoff)) & (F.col("created_at") < cutoff)).drop("created_day")

    def forget(self, now: Column, s: Settings = DEFAULT) -> None:
        """Removes expired jobs from the state: whole days by their folder, the day of the cut by writing it again."""
        cutoff = self._cutoff(now, s)
        day = self.spark.range(1).select(F.to_date(cutoff).cast("string")).first()[0]
        kept = cut_lineage(self.state().filter((F.col("created_day") == F.lit(day).cast("date")) & (F.col("created_at") >= cutoff)))
        for name in self._names("state"):
            if name.startswith("created_day=") and name.split("=")[1] <= day:
                self.files.delete(self._path(f"state/{name}"), True)
        kept.write.mode("append").partitionBy("created_day").parquet(f"{self.folder}/state")
