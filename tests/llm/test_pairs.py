"""Near duplicates of texts and of vectors, and components, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from crowdpeak.llm import embeddings, graph, jaccard


def components(nodes, links):
    least = {x: x for x in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    got = graph.connected_components(spark.createDataFrame(links + [(None, 3), (7, 7)], "a long, b long"))
    want = components({x for p in links for x in p}, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {x: c for x, c in want.items() if x in touched}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.choice([1, 3, 14])):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts)] = " ".join(copy)
    for odd in (None, "", " \n", "one two", "One  TWO", "a b c d e", "A b c d e\t"):
        texts[len(texts)] = odd
    rows = [(i, t, "x") for i, t in texts.items()]
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]]
    want = components(sets, links)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, n_shingles string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted((i, len(s), want[i]) for i, s in sets.items())


def test_jaccard_of_nothing_and_of_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_shingles, r.component_id or -1) for r in got) == [(0, -1), (2, 4), (2, 4), (2, 4)]


def test_rows_without_id_bridge_groups_and_one_row_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(120)]
    one, two, three = words, words[:-6] + [f"x{i}" for i in range(6)], [f"y{i}" for i in range(12)] + words[12:-6] + [f"x{i}" for i in range(6)]
    other = [f"z{i}" for i in range(40)]
    sets = [shingles(" ".join(t)) for t in (one, two, three)]
    share = lambda a, b: len(a & b) / len(a | b)
    assert share(sets[0], sets[1]) >= 0.8 and share(sets[1], sets[2]) >= 0.8 > share(sets[0], sets[2])
    rows = [(3, " ".join(one), "a"), (None, " ".join(two), "b"), (7, " ".join(three), "c"), (3, " ".join(other), "d"),
            (None, " ".join(other[:20]), "e"), (None, " ".join(other[:20]), "e"), (5, None, "f"), (None, "", "g"), (3, " ".join(one), "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(table).collect()}
    assert got == {(3, 116): 3, (None, 116): 3, (7, 116): 3, (3, 36): 3, (None, 16): None, (5, 0): 5, (None, 0): None}
    kept = sorted(r.row for r in jaccard.one_of_each(table).collect())
    assert kept == ["a", "d", "e", "f", "g"]
    assert jaccard.one_of_each(table).columns == table.columns
    assert jaccard.one_of_each(table.where("row = 'q'")).count() == 0


def test_row_filter_holds_every_key(spark):
    keys = spark.range(3000).select("id", F.lit("t").alias("text"), F.col("id").alias("doc_id"))
    keys = keys.select(jaccard.row_key(keys).alias("row"))
    bits = np.unpackbits(jaccard.row_filter(keys, 1 << 17), bitorder="little")
    places = np.array([k % (1 << 17) for r in keys.collect() for k in r.row])
    assert bits[places].all() and bits.sum() == len(np.unique(places))


def test_divide_skip_counts():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 300, size=n)) for n in (5, 80, 120, 200, 200, 40)]
    for q in sets:
        for needed in (1, 3, 30, len(q)):
            want = {k: len(np.intersect1d(s, q)) for k, s in enumerate(sets)}
            assert jaccard.occurrences(sets, q, needed) == {k: c for k, c in want.items() if c >= needed}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 64))
    x = np.concatenate([x, *[x[:20] + rng.standard_normal((20, 64)) * s for s in (0.1, 0.2, 0.3)], x[:5] * 3, x[:5]])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] * 64, [None] * 64, [1.0] * 3]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(2000, [1.0, 1.0, 1.0], 1), (None, [1.0, 0.0, 1.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int"), block=16).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near)))])
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows)
    found = sum(by[i].n_links for i in range(len(x))) / near.sum()
    assert 0.97 <= found <= 1
    assert sum(by[i].component_id != want[i] for i in range(len(x))) <= 1
    assert all(by[1000 + k].n_links == 0 and by[1000 + k].component_id == 1000 + k and by[1000 + k].kept for k in range(6))
    assert by[1006].n_links == 1 and by[2000].component_id == 1006 and not by[2000].kept
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sets_that_meet_only_late_on_a_common_list_are_not_paired(spark):
    """Pipeline, near duplicates: a list that 80 sets hold in a late place makes no rows; the one similar pair on it stays."""
    rows = [(999, k, 20, 4, k, 1) for k in range(80)] + [(500 + at, k, 20, at, k, 1) for k in (100, 101) for at in range(4)]
    rows += [(999, k, 20, 4, k, 1) for k in (100, 101)]
    placed = spark.createDataFrame(rows, "token long, id long, n long, at int, component long, members int")
    assert [tuple(r) for r in jaccard._asked(placed, 80).select("group", "id", "c").collect()] == [(101, 100, 5)]
