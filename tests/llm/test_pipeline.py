"""The stages of the pipeline on a small corpus and on an empty table."""

import random
from pathlib import Path

import pytest

import corpus_pipeline

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="the tables are not here")


def test_stages_keep_the_columns_also_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    empty = docs.where("doc_id = -1")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, PATH)
        assert out.count() == 0
        assert out.columns[: len(docs.columns)] == docs.columns, name


def test_repeated_and_missing_ids_lose_nothing_clean_and_keep_nothing_leaking(spark, tmp_path):
    rng = random.Random(19)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    item, a, b, c, d = (text(n) for n in (30, 40, 50, 60, 70))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, a), (1, b), (None, c), (None, c), (None, d), (2, f"{d} end"), (3, f"{text(20)} {item}"), (3, text(45)), (None, f"{item} {text(20)}"),
            (None, text(46)), (4, None), (None, ""), (5, text(3))]
    docs = spark.createDataFrame([(i, t, "de") for i, t in rows], "doc_id long, text string, leak_key string")
    once = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
    clean = corpus_pipeline.drop_leaks(spark, once, str(tmp_path))
    key = lambda r: (r[0] or 0, r[1] or "")
    first = [r for k, r in enumerate(rows) if k not in (3, 4)]  # the second copy, and the near copy without an id
    assert sorted(((r.doc_id, r.text) for r in once.collect()), key=key) == sorted(first, key=key)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted((r for r in first if not r[1] or item not in r[1]), key=key)
    assert clean.columns == docs.columns


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, PATH).collect()
    per = {}
    for r in out:
        per.setdefault(r.shard, []).append(r.slot)
    assert sorted(per) == list(range(8)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
