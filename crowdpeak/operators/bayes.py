"""A text classifier made of counts: multinomial Bayes over character n-grams, trained and applied by aggregation alone.

Nothing is fitted on the driver, and any SQL engine can repeat the result. The model is two tables: how often each n-gram
occurs in each class, and the size of each class.

N-grams are counted inside tasks, and no row is made for an n-gram of a text. Rows are scored in slices of texts: a slice
asks the model for its distinct n-grams and gets back their counts, so what is shuffled is the texts once, compressed, and
the n-grams of a slice once, however many of its texts hold them. The model is never in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from crowdpeak.functions.grams import counted, gram_codes, text_slices
from crowdpeak.session import cut_lineage

#: Characters of texts that ask the model at once.
SLICE_CHARS = 8 << 20


class BayesModel(NamedTuple):
    grams: DataFrame  # gram (as of `functions.grams`), classes: array of (label, n), at most one entry per class
    classes: DataFrame  # label, prior (log), spread (log of the class's n-grams plus all distinct ones)


def _gram_counts(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(label, gram, n) of all n-grams of `rows(label, _text)`; counts leave each task already added up by slices."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = pc.dictionary_encode(batch.column(0))
            number = labels.indices.to_numpy(zero_copy_only=False)
            for start, texts in text_slices(batch.column(1).to_pylist()):
                owners, grams = gram_codes(texts, sizes)
                label, gram, n = counted(number[start + owners].astype(np.int64), grams)
                yield pa.record_batch({"label": labels.dictionary.take(pa.array(label)), "gram": gram, "n": n})

    schema = T.StructType([rows.schema["label"], T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    return rows.select("label", F.lower("_text").alias("_text")).mapInArrow(count, schema).groupBy("label", "gram").agg(F.sum("n").alias("n"))


def train_bayes(labelled: DataFrame, text: str = "chat_message", label: str = "label", sizes: tuple[int, ...] = (2, 3)) -> BayesModel:
    """Counts of `labelled(text, label)`; every count is raised by one when it is used. Rows without text or label are left out."""
    rows = labelled.select(F.col(label).alias("label"), F.col(text).alias("_text")).filter("label IS NOT NULL AND _text IS NOT NULL")
    counts = cut_lineage(_gram_counts(rows, sizes))  # one row per class and distinct n-gram, read several times
    sizes_of = counts.groupBy("label").agg(F.sum("n").alias("total"))
    priors = cut_lineage(rows.groupBy("label").agg(F.count("*").alias("rows")))
    distinct, everything = counts.agg(F.count_distinct("gram")).scalar(), priors.agg(F.sum("rows")).scalar()
    classes = priors.join(sizes_of, "label", "left").select(
        "label", F.log(F.col("rows") / everything).alias("prior"), F.log(F.coalesce("total", F.lit(0)) + distinct).alias("spread"))
    return BayesModel(counts.groupBy("gram").agg(F.collect_list(F.struct("label", "n")).alias("classes")), classes)


def _sliced(rows: DataFrame, most: int) -> DataFrame:
    """A row (slice, rows) for each slice of consecutive rows `(key, _text)`, compressed; a longer text is a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held))
            return pa.record_batch({"slice": pa.array([number], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            start = 0
            for i, n in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
                if size and size + n > most:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield packed()
                    start, number, held, size = i, number + 1, [], 0
                size += n + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield packed()

    return rows.mapInArrow(run, "slice long, rows binary")


def _hits(model: BayesModel, rows: DataFrame, key: str, sizes: tuple[int, ...], most: int) -> DataFrame:
    """(key, label, _hit): what the known n-grams of the rows with a key add to the score of a class."""
    # The slices are kept, so that their numbers stay the same when an executor is lost.
    slices = cut_lineage(_sliced(rows.select(key, F.lower("_text").alias("_text")), most))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts = pa.ipc.open_stream(held.as_buffer()).read_all().column(1).to_pylist()
                parts = [np.unique(gram_codes(some, sizes)[1]) for _, some in text_slices(texts)]
                grams = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)
                yield pa.record_batch({"slice": pa.array(np.full(len(grams), number, dtype=np.int64)), "gram": grams})

    known = slices.mapInArrow(ask, "slice long, gram long").join(model.grams, "gram").select("slice", "gram", F.inline("classes")).select(
        "slice", "gram", "label", F.log(F.col("n") + F.lit(1.0)).alias("weight"))
    label_type = known.schema["label"].dataType
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("label", label_type), T.StructField("_hit", T.DoubleType())])

    def score(mine: pa.Table, given: pa.Table) -> pa.Table:
        if not mine.num_rows or not given.num_rows:
            return pa.table({"k": [], "label": [], "_hit": []}).cast(empty)
        held = pa.ipc.open_stream(mine.column("rows")[0].as_buffer()).read_all()
        encoded = given.column("label").combine_chunks().dictionary_encode()
        grams, place = np.unique(given.column("gram").to_numpy(), return_inverse=True)
        weight = np.zeros((len(encoded.dictionary), len(grams)))
        weight[encoded.indices.to_numpy(), place] = given.column("weight").to_numpy()
        hits = np.zeros((held.num_rows, len(weight)))
        for start, texts in text_slices(held.column(1).to_pylist()):
            owners, found = gram_codes(texts, sizes)
            at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
            same = grams[at] == found
            pair, n = np.unique(owners[same] * np.int64(len(grams)) + at[same], return_counts=True)
            owner, gram = pair // len(grams), pair % len(grams)
            for c, of_class in enumerate(weight):
                hits[start : start + len(texts), c] = np.bincount(owner, weights=n * of_class[gram], minlength=len(texts))
        every, classes = np.repeat(np.arange(held.num_rows), len(weight)), np.tile(np.arange(len(weight)), held.num_rows)
        return pa.table([held.column(0).take(pa.array(every)), encoded.dictionary.take(pa.array(classes)), pa.array(hits.ravel())], names=empty.names)

    empty = to_arrow_schema(schema)
    scored = slices.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(score, schema)
    return cut_lineage(scored.groupBy(key, "label").agg(F.sum("_hit").alias("_hit")))  # a few numbers a row, read twice


def bayes_scores(model: BayesModel, df: DataFrame, key: str, text: str = "chat_message", sizes: tuple[int, ...] = (2, 3),
                 slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(key, label, score, prediction): the log score of every class for every row, and the class with the highest one.

    `key` must tell the rows apart. A null or empty text is scored by the priors; equal scores go to the smaller label. An
    n-gram that a class lacks counts one for it and so adds nothing but its share of the spread; only n-grams the model
    knows are joined."""
    rows = df.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    length = F.length("_text")
    many = sum((F.greatest(length - (n - 1), F.lit(0)) for n in sizes), F.lit(0))
    hits = _hits(model, rows, key, sizes, slice_chars)
    classes = model.classes.agg(F.collect_list(F.struct("label", "prior", "spread"))).scalar()  # one entry per class
    every = rows.select(key, many.alias("_many"), F.inline(classes))
    scored = every.join(hits, [key, "label"], "left").withColumn(
        "score", F.col("prior") + F.coalesce("_hit", F.lit(0.0)) - F.col("_many") * F.col("spread")).select(key, "label", "score")
    best = scored.groupBy(key).agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("prediction"))
    return scored.join(best, key)
