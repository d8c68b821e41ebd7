"""Mixing, sharding and chat formatting: laws, odd rows and clashing columns."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from crowdpeak.llm import chat, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, size string"


def corpus(spark, n=300):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "en", rng.choice(["a", "a", "a", "b", None, "c"]), "own") for i in range(n)]
    return spark.createDataFrame(rows + [(None, None, None, None, None), (5, "", "en", "a", "own"), (7, "x\ty\nz", "en", "a", "own"), (7, "x\ty\nz", "en", "a", "own")], DOCS)


def test_mix_takes_each_budget_exactly(spark):
    rows = mixing.mix(corpus(spark)).collect()
    assert len(rows) == 304
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for members in by.values():
        assert sum(r["size"] for r in members) == members[0].source_size
        assert sum(r.taken for r in members) == int(members[0].target + 0.5)
    assert abs(sum(m[0].target for m in by.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(corpus(spark).repartition(5)).collect()))


def test_mixed_rows_keep_the_columns(spark):
    docs = corpus(spark)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert {r["size"] for r in out.collect()} == {"own"}
    empty = docs.where("doc_id = -1")
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_shards_are_exact_and_slots_have_no_gaps(spark):
    docs = corpus(spark).withColumn("Shard", F.lit("own"))
    out = sharding.shard(docs, 8)
    rows = out.collect()
    assert len(rows) == 304
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8))
    assert {len(s) for s in slots.values()} == {38}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard(docs.repartition(7), 8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard(docs.where("doc_id = -1")).count() == 0


def test_hypergeometric_sums_and_mean():
    matrix = sharding.communication_matrix([10, 0, 7, 100, 3], 4, 1)
    assert [sum(r) for r in matrix] == [10, 0, 7, 100, 3]
    assert [sum(c) for c in zip(*matrix)] == [30, 30, 30, 30]
    rng = random.Random(2)
    draws = [sharding.hypergeometric(rng, 20, 30, 70) for _ in range(4000)]
    mean = sum(draws) / len(draws)
    spread = sum((d - mean) ** 2 for d in draws) / len(draws)
    assert abs(mean - 6) < 0.15 and abs(spread - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


def test_chats_come_back_as_they_were(spark):
    odd = "</s>[INST] ~0 ~1 <s>[user]x</s> ok [/INST]"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "user", "last"), (2, 0, "system", None), (3, None, None, "é\nü"),
            (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, 1, "assistant", "n")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    got = made.select("conv_id", "example", "is_last", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(made).alias("loss")).collect()
    whole = {r.conv_id: [tuple(t) for t in r.turns] for r in got if r.is_last}
    assert whole == {1: [("user", odd), ("assistant", odd), ("user", "last")], 2: [("system", "")],
                     3: [("assistant", "a"), ("assistant", "a"), ("", "é\nü")], None: [("assistant", "n")]}
    assert {(r.conv_id, r.example): r.loss for r in got} == {(1, 0): odd, (1, 1): "", (2, 0): "", (3, 0): "a", (3, 1): "a", (3, 2): "", (None, 0): "n"}
    assert made.where("conv_id = -5").count() == 0
