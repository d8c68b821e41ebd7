"""A uniform shuffle into shards of exact sizes: a hypergeometric communication matrix between parts and shards."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdpeak.llm.store import free_name, hashable

#: Rows that one part permutes, at the mean; and the least number of parts.
PART_ROWS = 100_000
LEAST_PARTS = 256
#: The second permutation of a shard is sorted in 2 ** SLOT_BITS ranges of the random key.
SLOT_BITS = 8


def hypergeometric(rng: random.Random, draws: int, good: int, bad: int) -> int:
    """How many of `draws` balls taken without replacement are good: one uniform number, inverted from the mode outward.

    Probabilities of the neighbours follow by ratio, so the work is some standard deviations, not the whole range."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma

    def choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    at_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - at_mode
    down, up, p_down, p_up = mode, mode, at_mode, at_mode
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(parts: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """matrix[p][s]: rows that part p sends to shard s, drawn as a uniform shuffle of all rows would.

    Row sums are the sizes of the parts, column sums the sizes of the shards, which differ by one at most."""
    rng = random.Random(seed)
    total = sum(parts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = []
    for n in parts:
        row, left, rest = [], n, sum(room)
        for s in range(n_shards):
            rest -= room[s]
            k = hypergeometric(rng, left, room[s], rest)
            row.append(k)
            left -= k
        room = [a - b for a, b in zip(room, row)]
        out.append(row)
    return out


def shard(docs: DataFrame, n_shards: int = 8, seed: int = 6) -> DataFrame:
    """`docs` with `shard` (0 to n_shards - 1) and `slot` (0, 1, ... without gaps within a shard), all rows kept.

    A part is a hash of the whole row, so it stays the same when a lost task is run again. The driver sees the number
    of rows of each part (one number per 100,000 rows) and draws how many of them go to each shard. A part permutes its
    rows by a random key and deals them out by those numbers; a shard permutes what it got by another key. Rows alike
    in everything are interchangeable; a row of nulls is a row; an empty table gives an empty table. Own columns named
    shard or slot are replaced; map columns do not take part in the hash."""
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    h, part, key, nth, ends, block, skip = free_name(base, "sh_hash", "sh_part", "sh_key", "sh_nth", "sh_ends", "sh_block", "sh_skip")
    spark = docs.sparkSession
    hashed = base.withColumn(h, F.xxhash64(F.lit(seed), *[F.col(c) for c in hashable(base)]))
    n_parts = max(LEAST_PARTS, -(-hashed.count() // PART_ROWS))
    # the remainder is taken of another hash, so that the order inside a part does not depend on the part
    rows = hashed.withColumn(part, F.pmod(F.xxhash64(F.lit("part"), F.col(h)), F.lit(n_parts)).cast("int"))
    sizes = {r[0]: r[1] for r in rows.groupBy(part).count().toLocalIterator()}  # one number a part
    matrix = communication_matrix([sizes.get(p, 0) for p in range(n_parts)], n_shards, seed)
    cuts = []
    for p, row in enumerate(matrix):
        upto, total = [], 0
        for k in row:
            total += k
            upto.append(total)
        cuts.append({"p": p, "e": upto})
    plan = (spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(cuts)), "array<struct<p:int,e:array<bigint>>>")).alias("x"))
            .select(F.col("x.p").alias(part), F.col("x.e").alias(ends)))
    first = Window.partitionBy(part).orderBy(F.xxhash64(F.lit("first"), F.col(h)), h)
    dealt = (rows.withColumn(nth, F.row_number().over(first)).join(plan, part)
             .withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(nth))))
             .withColumn(key, F.xxhash64(F.lit("second"), F.col(h), F.lit(seed)))
             .withColumn(block, F.shiftrightunsigned(F.col(key), 64 - SLOT_BITS).cast("int")))
    shard_, block_ = free_name(dealt, "sh_shard", "sh_of")
    within = Window.partitionBy(shard_).orderBy(block_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (dealt.groupBy(F.col("shard").alias(shard_), F.col(block).alias(block_)).agg(F.count("*").alias("n"))
               .select(shard_, block_, (F.sum("n").over(within) - F.col("n")).alias(skip)))
    second = Window.partitionBy("shard", block).orderBy(key, h)
    return (dealt.withColumn(nth, F.row_number().over(second))
            .join(offsets, (F.col("shard") == F.col(shard_)) & (F.col(block) == F.col(block_)))
            .select(*base.columns, "shard", (F.col(skip) + F.col(nth) - 1).cast("long").alias("slot")))
