"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crowdpeak.session import cut_lineage, shared_folder

#: With this setting Spark deletes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """`df` computed once and kept by checkpoint() in the folder of spark.checkpoint.dir.

    Row numbers and partition layouts taken from the result stay as they are when executors are lost. Nothing reads the
    shuffle files behind `df` again once it is written, so they go at once and not when the driver next collects."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df.select("*"))
    finally:
        conf.set(CLEANUP, before)


def hashable(df: DataFrame) -> list[str]:
    """Columns that Spark can hash: all but maps and variants, at any depth."""
    return [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def free_name(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of `df` has (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


class Steps:
    """Tables written one after the other in the folder of spark.checkpoint.dir; each takes the place of the one before.

    Parquet holds small whole numbers in far fewer bytes than checkpoint(), and a table that nothing reads any more is
    deleted at once. The last table stays, since the result is read from it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.k = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        """`df` as a written table. Afterwards nothing may read the table put before."""
        path = f"{self.folder}/{self.k}"
        df.write.parquet(path)
        if self.k:
            self._delete(f"{self.folder}/{self.k - 1}")
        self.k += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
