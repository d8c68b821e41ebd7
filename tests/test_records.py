"""CSV records from files of different headers, cut into pieces anywhere, against the standard reader of whole files."""

import csv
import io
import random

import pytest

from crowdpeak.sources.records import cell, csv_records


def written(rows):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_MINIMAL, lineterminator="\n").writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_equals_whole_files(spark, tmp_path, piece):
    rng = random.Random(piece)
    heads = {"a": ["t", "x", "note"], "b": ["note", "t", "x"], "c": ["na,me", 'quo"te', "note"], "d": ["t"], "e": ["t", "x"]}
    want = []
    for name, head in heads.items():
        body = [[rng.choice(["", "1", "x,y", 'say "hi"', "two\nlines", "a\n\nb,\n\"", "é" * 9, " pad ", "\x01\x02", "a\x01,\x03", '"' * 20_000]) for _ in head] for _ in range(0 if name == "e" else 40)]
        (tmp_path / f"{name}.csv").write_text(("﻿" if name == "b" else "") + written([head, *body]), encoding="utf-8", newline="")
        with open(tmp_path / f"{name}.csv", encoding="utf-8-sig", newline="") as file:
            want += [(name, tuple(head), tuple(r)) for r in list(csv.reader(file))[1:] if r]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(piece))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = csv_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.file.split("/")[-1][0], tuple(r.header), tuple(r.cells)) for r in got) == sorted(want)


def test_cells_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"la,bel",text\n1,"x\n""y"""\n2\n', encoding="utf-8")
    got = csv_records(spark, str(tmp_path)).select(cell("la,bel").alias("a"), cell("text").alias("b"), cell("none").alias("c")).collect()
    assert sorted(tuple(r) for r in got) == [("1", 'x\n"y"', None), ("2", None, None)]


def test_one_scan_and_one_exchange_of_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,x\n1,2\n", encoding="utf-8")
    made = csv_records(spark, str(tmp_path))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan text") == 1 or "ReusedExchange" in plan


def test_a_file_each_is_written_by_many_tasks(spark, tmp_path):
    import os

    from crowdpeak.checks.feeds import write_one_each

    docs = spark.createDataFrame([(str(i), f'{{"a":\n {i}}}') for i in range(300)] + [("7", '{"a":\n 7}'), (None, "{}")], "video_id string, value string")
    folder = str(tmp_path / "files")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one each", "files")
    write_one_each(docs, folder)
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("one each") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) in tasks
    assert sorted(os.listdir(folder)) == sorted(f"{i}.json" for i in range(300))
    assert (tmp_path / "files" / "7.json").read_text() == '{"a":\n 7}\n\n' * 2
    assert spark.read.json(folder, multiLine=True).agg({"a": "count"}).first()[0] == 300


def test_files_of_a_document_each_are_read_in_rounds(spark, tmp_path):
    from crowdpeak.checks.feeds import write_one_each
    from crowdpeak.sources.tables import in_rounds, read_series_json

    assert in_rounds([("a", 2), ("b", 2), ("c", 3), ("d", 9), ("e", 1)], 4) == [["a", "b"], ["c"], ["d"], ["e"]]
    body = '{"recommended_joy_threshold":\n %d, "time_series_data": [{"timestamp": %d, "chat_text": "é", "more": 1.10}]}'
    docs = spark.createDataFrame(
        [(str(i), body % (i, i)) for i in range(100)] + [("7", body % (7, 7)), (None, "{}"), ("a b", "{}"), ("broken", "{\n"), ("none", None)],
        "video_id string, value string")
    write_one_each(docs, str(tmp_path / "flat"))
    made = write_one_each(docs, str(tmp_path / "files"), most=5)
    assert sum(n for _, n in made) == 103 and max(n for _, n in made) <= 5
    assert {f: len(list((tmp_path / "files" / f.split("/")[-1]).iterdir())) for f, _ in made} == dict(made)
    rounds = in_rounds(made, 20)
    assert len(rounds) > 4
    got, want = read_series_json(spark, rounds), read_series_json(spark, str(tmp_path / "flat"))
    for one, other in zip(got, want):
        text = [c if c != "point" else "to_json(point)" for c in one.columns]
        assert sorted(map(str, one.selectExpr(*text).collect())) == sorted(map(str, other.selectExpr(*text).collect()))
        assert not [f for f in one.inputFiles() if f.endswith(".json")]
    empty = write_one_each(docs.limit(0), str(tmp_path / "empty"), most=5)
    assert [t.count() for t in read_series_json(spark, in_rounds(empty))] == [0, 0]


def test_the_driver_does_not_keep_a_file_for_each_document(spark, tmp_path):
    from crowdpeak.checks.feeds import both_forms

    rows = [(i, 0, "user", f"a {i}\nb") for i in range(200)] + [(None, 0, "user", "x"), (3, None, "user", "x"), (4, 1, "user", None), (5, 0, "user", "a 5\nb")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = both_forms(spark, str(tmp_path))
    assert len(out.inputFiles()) < 100
    files = {(r.video_id, r.t, r.chat_text) for r in out.collect() if r.kind == "file"}
    assert {(str(i * 8), float(k), text) for i in range(200) for k, text in enumerate((f"a {i}", "b"))} <= files
