"""Labelled chat for training: clean, deduplicate, split, oversample, and a classifier on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdpeak.functions.text import strip
from crowdpeak.session import cut_lineage
from crowdpeak.settings import Settings

DEFAULT = Settings()


def clean_labels(raw: DataFrame, message: str = "chat_message", label: str = "label") -> DataFrame:
    """Rows with a message and a whole label 0-6; anything that is not a number is dropped, fractions are cut."""
    number = F.col(label).cast("string").try_cast("double")
    # The range is tested before the cast: a label of any size or an infinite one is dropped, not an error.
    kept = raw.filter(F.col(message).isNotNull() & (number > -1) & (number < 7))
    return kept.withColumn(label, number.try_cast("int"))


def label_statistics(raw: DataFrame, message: str = "chat_message", label: str = "label") -> DataFrame:
    """Rows per label, with the number of rows before and after cleaning, in one pass over the raw rows."""
    number = F.col(label).cast("string").try_cast("double")
    valid = F.col(message).isNotNull() & (number > -1) & (number < 7)
    per = raw.groupBy(F.when(valid, number.try_cast("int")).alias("label")).agg(F.count("*").alias("rows"))
    everything = Window.partitionBy(F.lit(0))
    return (
        per.withColumn("raw_rows", F.sum("rows").over(everything))
        .withColumn("clean_rows", F.sum(F.when(F.col("label").isNotNull(), F.col("rows"))).over(everything))
        .filter("label IS NOT NULL")
    )


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The earliest row of each key. A minimum, not a window: copies are reduced before they are shuffled, so a
    message that makes up a third of the table costs one row per map task."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*[F.col(f"_row.{c}").alias(c) if c != key else F.col(key) for c in df.columns])


def split_key(row_id: Column, seed: int) -> Column:
    """A reproducible pseudo-random whole number below 2^31 for a row number: the first 32 bits of md5, without the
    top one, so that any SQL engine can repeat it."""
    digest = F.md5(F.concat(row_id.cast("long").cast("string"), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 2_147_483_648).cast("long")


def stratified_split(df: DataFrame, row_id: str, label: str = "label", s: Settings = DEFAULT) -> DataFrame:
    """Mark each row `is_test`; every label gives the same share, and the shares add up to the rounded-up total.

    Rows are ordered by a pseudo-random key inside their label. A label may be most of the table, so rows are not
    sorted by label: counts per label and key range tell which range the cut falls in, and only that range is sorted.
    """
    keyed = df.withColumn("_key", split_key(F.col(row_id), s.split_seed)).withColumn(
        "_range", F.floor(F.col("_key") / 65_536).cast("long"))
    counts = keyed.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(label).agg(F.sum("_n").alias("_size"))
    everything = Window.partitionBy(F.lit(0))
    share = F.col("_size") * F.lit(s.split_test_share)
    total = F.ceil(F.sum("_size").over(everything) * F.lit(s.split_test_share))
    # One row per label from here: the whole parts first, the rest by largest remainder.
    quota = (
        sizes.withColumn("_whole", F.floor(F.round(share, 6)))
        .withColumn("_left", total - F.sum("_whole").over(everything))
        .withColumn("_turn", F.row_number().over(everything.orderBy(
            F.round(F.round(share, 6) - F.col("_whole"), 6).desc(), label)))
        .select(label, (F.col("_whole") + F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0)).alias("_quota"))
    )
    upto = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).join(quota, label)
        .withColumn("_need", F.col("_quota") - F.col("_before"))
    )
    decided = keyed.join(ranges.select(label, "_range", "_n", "_need"), [label, "_range"])
    in_range = Window.partitionBy(label, "_range").orderBy("_key", row_id)
    # Ranges wholly on one side of the cut need no order; at most one range per label does.
    sure = decided.filter((F.col("_need") <= 0) | (F.col("_need") >= F.col("_n"))).withColumn(
        "is_test", F.col("_need") > 0)
    cut = decided.filter((F.col("_need") > 0) & (F.col("_need") < F.col("_n"))).withColumn(
        "is_test", F.row_number().over(in_range) <= F.col("_need"))
    return sure.unionByName(cut).drop("_key", "_range", "_n", "_need")


def oversample(df: DataFrame, row_id: str, label: str = "label", neutral: int = 6, s: Settings = DEFAULT) -> DataFrame:
    """Raise each small class to a fixed size by drawing with replacement; other rows pass unchanged.

    Only classes below the target are numbered, so at most `target` rows of a class meet in one task. `draw_no` is
    null for a row that was not drawn; `shuffle_key` orders the result at random when sorted by it.
    """
    target = s.oversample_to
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    small = sizes.filter((F.col("_n") < target) & (F.col(label) != neutral))
    slots = small.select(label, "_n", F.explode(F.sequence(F.lit(1), F.lit(target))).alias("draw_no")).withColumn(
        "_pick", split_key(F.col("draw_no") * 31 + F.col(label), s.split_seed) % F.col("_n"))
    numbered = df.join(small.select(label), label, "left_semi").withColumn(
        "_pick", F.row_number().over(Window.partitionBy(label).orderBy(row_id)) - 1)
    drawn = numbered.join(slots.select(label, "_pick", "draw_no"), [label, "_pick"]).drop("_pick")
    rest = df.join(small.select(label), label, "left_anti").withColumn("draw_no", F.lit(None).cast("int"))
    order = split_key(F.col(row_id) * 1201 + F.coalesce("draw_no", F.lit(0)), s.split_seed + 1)
    return drawn.unionByName(rest).withColumn("shuffle_key", order)


def corpus(texts: DataFrame, text: str = "text", position: str = "position") -> DataFrame:
    """Distinct trimmed texts with the position of their first occurrence; sort by it for the file order."""
    return (
        texts.withColumn(text, strip(F.col(text))).filter(F.length(text) > 0)
        .groupBy(text).agg(F.min(position).alias(position))
    )


def macro_f1(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class true positives and F1, and their mean over the classes that occur."""
    pairs = predictions.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"),
                 F.lit(0).cast("long").alias("hit")))).alias("e")).select("e.*")
    classes = each.groupBy("label").agg(F.sum("hit").alias("true_positives"), F.sum("actual").alias("actual"),
                                        F.sum("said").alias("predicted"))
    f1 = 2 * F.col("true_positives") / (F.col("actual") + F.col("predicted"))
    scored = classes.withColumn("f1", f1)
    return scored.withColumn("macro_f1", F.avg("f1").over(Window.partitionBy(F.lit(0))))


def train_classifier(labelled: DataFrame, text: str = "chat_message", label: str = "label", features: int = 1 << 14):
    """Character 2-3-gram TF-IDF and multinomial logistic regression; returns the fitted pipeline model.

    The n-grams are counted once: the vectors are kept for the passes of the weights and of the regression."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF

    from crowdpeak.functions.gram_features import GramCounts

    counts = GramCounts(inputCol=text, outputCol="_tf", numFeatures=features)
    counted = cut_lineage(counts.transform(labelled.select(label, text)).drop(text))
    fitted = Pipeline(stages=[
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, probabilityCol="_probability", maxIter=20,
                           regParam=0.01),
    ]).fit(counted)
    return PipelineModel([counts, *fitted.stages])


def classify(model, df: DataFrame) -> DataFrame:
    """Add `probs` and `prediction` of a model made by `train_classifier`."""
    from pyspark.ml.functions import vector_to_array

    keep = df.columns
    scored = model.transform(df)
    return scored.select(*keep, vector_to_array("_probability").alias("probs"),
                         F.col("prediction").cast("int").alias("prediction"))


def classify_with(df: DataFrame, load: Callable[[], Callable[[pd.Series], list[list[float]]]],
                  text: str = "chat_text") -> DataFrame:
    """Add `probs` from any external model. `load` runs once per task and returns a function from a batch of texts to
    probability vectors; a blank text is given to the model as three dots."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", probs array<double>"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            texts = batch[text].fillna("").str.strip()
            yield batch.assign(probs=list(predict(texts.where(texts != "", "..."))))

    return df.mapInPandas(score, schema)
