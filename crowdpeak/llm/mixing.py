"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdpeak.llm.store import free_name, hashable
from crowdpeak.llm.text import WORD

WEIGHTS = (5, 2, 1)
#: The key range of a source is cut into 2 ** BLOCK_BITS blocks, which are sorted and summed apart.
BLOCK_BITS = 12
KEY_BITS = 60


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """60 bits of md5 over the id: the same order in each run and in each engine."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size) -> also target: shares of the whole by weight, none above `most` times its size.

    Weights go to the sources by code point, null last, and repeat. What a full source can't take is shared again by
    weight. In ascending order of size over weight the full ones come first, so the level at which the water stands
    follows from running sums, in whole numbers, without iteration. One row per source goes through one task."""
    names = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    wide = (sizes.withColumn("rank", F.row_number().over(names)).withColumn("weight", pick.cast("decimal(38,0)"))
            .withColumn("cap", F.col("source_size").cast("decimal(38,0)") * most))
    ratio = [F.col("cap").cast("double") / F.col("weight").cast("double"), F.col("rank")]
    everything = Window.partitionBy()
    fill = Window.orderBy(*ratio)
    dec = lambda c: c.cast("decimal(38,0)")
    wide = (wide.withColumn("total", dec(F.sum("source_size").over(everything)))
            .withColumn("caps_before", dec(F.sum("cap").over(fill)) - F.col("cap"))
            .withColumn("weights_from", dec(F.sum("weight").over(everything)) - dec(F.sum("weight").over(fill)) + F.col("weight"))
            .withColumn("full", F.expr("CAST(cap AS DOUBLE) * CAST(weights_from AS DOUBLE) "
                                       "<= CAST(total - caps_before AS DOUBLE) * CAST(weight AS DOUBLE)"))
            .withColumn("left", F.col("total") - F.coalesce(dec(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything)), dec(F.lit(0))))
            .withColumn("open", dec(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))))
    level = F.expr("CAST(left AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(open AS DOUBLE)")
    return wide.select("source", "source_size",
                       F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(level, F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 11,
        source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with `size`, `source_size`, `target`, `taken` (words, repeats counted) and `copies` (rows of the mix).

    Each source has a budget, its target to the nearest word. Whole passes over the source are taken while they fit;
    of the last pass, rows in hash-random order up to the budget, the row at the cut in part: `taken` counts exactly,
    `copies` counts that row once more. Columns of these names in `docs` are replaced. A null source is a source; a
    null or empty text has size 0 and is in no copy; rows alike in everything are interchangeable; an empty table
    gives an empty table. A source holding any share of the rows is sorted and summed in 2 ** BLOCK_BITS key ranges."""
    made = ("size", "source_size", "target", "taken", "copies")
    base = docs.drop(*[c for c in docs.columns if c.lower() in made and c not in (source, doc_id, text)])
    key, block, tie, src, before, upto = free_name(base, "mix_key", "mix_block", "mix_tie", "mix_source", "mix_before", "mix_upto")
    rows = (base.withColumn("size", n_words(F.col(text))).withColumn(key, random_key(F.col(doc_id), seed))
            .withColumn(block, F.shiftright(F.col(key), KEY_BITS - BLOCK_BITS).cast("int"))
            .withColumn(tie, F.xxhash64(*[F.col(c) for c in hashable(base)])))
    blocks = rows.groupBy(F.col(source).alias(src), block).agg(F.sum("size").alias("block_size"))
    targets = source_targets(blocks.groupBy(F.col(src).alias("source")).agg(F.sum("block_size").alias("source_size")), weights, most)
    running = Window.partitionBy(src).orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (blocks.withColumn(before, F.sum("block_size").over(running) - F.col("block_size"))
               .join(targets.withColumnRenamed("source", "t_source"), F.col(src).eqNullSafe(F.col("t_source")))
               .select(src, F.col(block).alias(upto), before, "source_size", "target"))
    inside = (Window.partitionBy(source, block).orderBy(key, doc_id, "size", tie)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    budget = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - passes * F.col("source_size")
    partly = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col(before)))
    return (rows.withColumn(key, F.sum("size").over(inside) - F.col("size"))
            .join(offsets, F.col(source).eqNullSafe(F.col(src)) & (F.col(block) == F.col(upto)))
            .withColumn(before, F.col(before) + F.col(key))
            .withColumn("taken", (passes * F.col("size") + partly).cast("long"))
            .withColumn("copies", F.when(F.col("size") > 0, passes + F.when(partly > 0, 1).otherwise(0)).otherwise(0).cast("int"))
            .select(*base.columns, "size", "source_size", "target", "taken", "copies"))


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every row as often as `copies` says, with the columns of `docs`."""
    made = {"size", "source_size", "target", "taken", "copies"}
    used = {settings.get(k, k) for k in ("source", "doc_id", "text")}
    apart = {c: free_name(docs, f"mix_own_{c}")[0] for c in docs.columns if c.lower() in made and c not in used}
    nth = free_name(docs, "mix_copy")[0]
    kept = mix(docs.withColumnsRenamed(apart), **settings).where("copies > 0")
    kept = kept.withColumn(nth, F.explode(F.expr("sequence(1, copies)")))
    return kept.select(*[F.col(apart.get(c, c)).alias(c) for c in docs.columns])
