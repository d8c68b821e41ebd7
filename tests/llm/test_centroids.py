"""Centroid clustering against plain rounds, and its bound against points drawn from spheres."""

import hashlib
import random

import numpy as np

from crowdpeak.llm import centroids
from crowdpeak.llm.queries import op13_drift_tightening


def plain(vectors, k, rounds, scale=64):
    rows = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in vectors]
    starts = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in starts[:k]]

    def assigned():
        out = []
        for i, v in rows:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assigned()
        for c in range(len(centres)):
            mine = [v for (_, v), (_, own, _) in zip(rows, at) if own == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return assigned(), centres


def test_equals_plain_rounds_with_ties_repeats_and_odd_rows(spark):
    rng = random.Random(13)
    middles = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(6)]
    kept = [(i, [np.float32(m + rng.gauss(0, 0.3)).item() for m in middles[i % 6]]) for i in range(400)]
    kept += [(7, kept[7][1]), (7, kept[9][1]), (1000, [0.0] * 5), (1001, [0.5] * 5), (1002, [-0.5] * 5), (None, kept[3][1]), (1003, [2.0e6, 0.0, 0.0, 0.0, 0.0])]
    odd = [(2000, None), (2001, []), (2002, [1.0] * 4), (2003, [1.0, None, 1.0, 1.0, 1.0]), (2004, [float("nan")] * 5),
           (2005, [float("inf")] + [0.0] * 4), (2006, [3.0e30] + [0.0] * 4)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in kept + odd], "vec_id long, embedding array<float>, cluster string, distance int").repartition(5)
    for k, rounds in ((7, 5), (1, 2), (3, 0), (500, 2)):
        got, centres = centroids.cluster(table, k=k, rounds=rounds, dims=5)
        want, want_centres = plain(kept, k, rounds)
        assert centres.tolist() == want_centres
        assert sorted((r.vec_id or -1, r.cluster, r.distance) for r in got.collect()) == sorted((i or -1, c, d) for i, c, d in want)


def test_loss_over_a_sphere_is_bounded_and_below_full_drift():
    rng = np.random.default_rng(3)
    tighter = 0
    for _ in range(60):
        old = rng.normal(size=(6, 4)) * 10
        new = old + rng.normal(size=(6, 4)) * rng.choice([0.1, 1, 5])
        new[rng.integers(6)] = old[0] * 0 + 1
        radius = rng.uniform(0, 8, size=6)
        got = centroids.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        for c in range(6):
            x = rng.normal(size=(500, 4))
            x = old[c] + x / np.sqrt((x**2).sum(axis=1))[:, None] * radius[c] * rng.uniform(0, 1, size=(500, 1)) ** 0.25
            others = [j for j in range(6) if j != c]
            loss = max((np.sqrt(((x - old[j]) ** 2).sum(axis=1)) - np.sqrt(((x - new[j]) ** 2).sum(axis=1))).max() for j in others)
            assert loss <= got[c] <= drift[others].max() * (1 + 1e-6)
            tighter += got[c] < 0.9 * drift[others].max()
    assert tighter > 60


def test_distances_beyond_double_precision():
    v = np.array([[1 << 27, 3], [-(1 << 27), 2]])
    assert centroids.squared_distances(v, np.array([[-(1 << 27), 1]])).tolist() == [[(1 << 56) + 4], [1]]


def test_query_of_nothing(spark, tmp_path):
    for rows in ([], [(1, [1.0] * 3), (2, None)]):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        got = op13_drift_tightening(spark, str(tmp_path))
        assert got.count() == 0
        assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}


def test_steps_keep_one_table(spark):
    from crowdpeak.llm.store import Steps

    steps = Steps(spark)
    a = steps.put(spark.range(5))
    b = steps.put(a.selectExpr("id + 1 AS id"))
    assert sorted(r.id for r in b.collect()) == [1, 2, 3, 4, 5]
    files = spark._jvm.org.apache.hadoop.fs.Path(steps.folder)
    assert [s.getPath().getName() for s in files.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(files)] == ["1"]
