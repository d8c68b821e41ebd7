"""Records of many CSV files with headers of their own, in one scan that splits large files.

A task that reads a piece of a file knows neither the header nor whether the piece starts inside quotes. Both follow from
one row per piece: the number of quotes in it, and the first line of the file. So lines are placed by (file, piece) once;
the pieces are summed up and put in order from the same exchange; and each line meets its own piece again. Headers never
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Marks that stand for a comma between cells while a record is cut; MARK in a text is followed by OWN meanwhile.
MARK, OWN, COMMA = "\x01", "\x02", "\x03"


def cells_of(record: Column) -> Column:
    """Cells of a record: quoted ones without their quotes, doubled quotes as one.

    Pieces between quotes are outside and inside by turns, so only commas in every other piece part cells."""
    pieces = F.split(F.replace(record, F.lit(MARK), F.lit(MARK + OWN)), '"', -1)
    parted = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(MARK + COMMA))).otherwise(p)), '"')
    return F.transform(F.split(parted, MARK + COMMA, -1), lambda c: F.replace(F.when(
        F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) > 1),
        F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c), F.lit(MARK + OWN), F.lit(MARK)))


def csv_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, header, cells) of every record of the files, header and cells as arrays of strings.

    A record may go over several lines inside quotes, also from one piece of a file into the next. Empty lines are no
    records. A byte order mark is dropped. Quotes count wherever they stand, so an odd one in a cell without quotes joins
    its record with those up to the next odd one."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    lines = (
        spark.read.option("recursiveFileLookup", "true").text(paths)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"),
                F.monotonically_increasing_id().alias("no"))
        .repartition("file", "piece")
    )
    counted = lines.withColumn("quotes", quotes)
    in_order = Window.partitionBy("file").orderBy("piece")
    pieces = counted.groupBy("file", "piece").agg(
        F.sum("quotes").alias("_sum"), F.min_by("value", "no").alias("_first"), F.min("no").alias("_head")).select(
        "file", "piece", (F.sum("_sum").over(in_order) - F.col("_sum")).alias("before"),
        F.first("_first").over(in_order).alias("header"), F.when(F.col("piece") == 0, F.col("_head")).alias("head_no"))
    upto = Window.partitionBy("file", "piece").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("run", F.sum("quotes").over(upto)).join(pieces, ["file", "piece"])
    after = F.col("before") + F.col("run")
    header = cells_of(F.regexp_replace("header", "^﻿", ""))
    rows = placed.filter("head_no IS NULL OR no <> head_no").select(
        "file", "piece", "no", "value", header.alias("header"),
        ((after - F.col("quotes")) % 2 != 0).alias("inside"), (after % 2 != 0).alias("open"))
    whole = rows.filter("NOT inside AND NOT open AND value <> ''").select("file", "header", F.col("value").alias("record"))
    # Lines of longer records, which are few: each record is known by its first line.
    parts = rows.filter("inside OR open")
    along = Window.partitionBy("file").orderBy("piece", "no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = parts.withColumn("record_no", F.last(F.when(~F.col("inside"), F.col("no")), ignorenulls=True).over(along))
    joined = started.groupBy("file", "record_no").agg(
        F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("piece", "no", "value"))).alias("lines")).select(
        "file", "header", F.array_join(F.transform("lines", lambda line: line["value"]), "\n").alias("record"))
    return whole.unionByName(joined).select("file", "header", cells_of(F.col("record")).alias("cells"))


def cell(name: str) -> Column:
    """The cell under a name; null where the file has no such column or the record ends before it."""
    at = F.array_position("header", name)
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def cell_or(name: str, place: Column) -> Column:
    """The cell under a name, or at `place` (from 0) where the file has no such column."""
    at = F.array_position("header", name)
    return F.get("cells", F.when(at > 0, at - 1).otherwise(place).cast("int"))
