"""Counts of character n-grams as a Spark ML stage: one Arrow function from texts to sparse vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdpeak.functions.grams import hashed_counts, text_slices

SIZES = (2, 3)
#: Characters counted at once: their arrays stay in a processor's cache.
SLICE_CHARS = 1 << 18


class GramCounts(Transformer, HasInputCol, HasOutputCol, HasNumFeatures):
    """The same vectors as `RegexTokenizer` by characters, `NGram` of two and of three, and `HashingTF`; null is empty.

    Only a capital sigma next to a digit may differ: `lower` tells the end of a word by Unicode's rule, the tokenizer by Java's."""

    def __init__(self, inputCol: str, outputCol: str, numFeatures: int) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, numFeatures=numFeatures)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        buckets = self.getNumFeatures()

        @F.arrow_udf(VectorUDT())
        def vectors(texts: pa.Array) -> pa.Array:
            sizes, indices, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for _, some in text_slices(texts.to_pylist(), SLICE_CHARS):
                owner, bucket, n = hashed_counts(some, SIZES, buckets)
                sizes.append(np.bincount(owner, minlength=len(some)))
                indices.append(bucket)
                values.append(n)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32())
            many = len(texts)
            return pa.StructArray.from_arrays([
                pa.array(np.zeros(many, dtype=np.int8)), pa.array(np.full(many, buckets, dtype=np.int32)),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(indices).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values).astype(np.float64)))],
                names=["type", "size", "indices", "values"])

        return dataset.withColumn(self.getOutputCol(), vectors(F.lower(self.getInputCol())))
