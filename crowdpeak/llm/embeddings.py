"""Near-duplicate vectors by cross-polytope hashing: fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdpeak.llm.graph import connected_components
from crowdpeak.llm.store import settle

#: Tables, hash functions joined to one code in a table, and codes under which a vector stands in each table.
TABLES, HASHES, PROBES = 6, 2, 4
#: Vectors of one block; a larger bucket is compared block by block.
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length is a power of two), without scaling."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform: a random rotation but for scale."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice((-1.0, 1.0), size=d))
    return y / np.sqrt(float(d)) ** 3


def codes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 2) -> np.ndarray:
    """(rows, tables, probes) of bucket codes of unit vectors, the home bucket first.

    A hash is the nearest of the 2d signed axes after a rotation. The other probes swap the hash for the next nearest
    axes where the loss in height is least, alone or in two hashes at once."""
    out = np.empty((len(x), tables, probes), dtype=np.int64)
    for t in range(tables):
        top, loss = [], []
        for k in range(hashes):
            y = rotate(x, seed + 1000 * t + k)
            d = y.shape[1]
            near = min(d, probes)
            axis = np.argpartition(-np.abs(y), near - 1, axis=1)[:, :near]
            height = np.take_along_axis(np.abs(y), axis, axis=1)
            by = np.argsort(-height, axis=1, kind="stable")
            axis, height = np.take_along_axis(axis, by, axis=1), np.take_along_axis(height, by, axis=1)
            top.append(2 * axis + (np.take_along_axis(y, axis, axis=1) < 0))
            loss.append(height[:, :1] - height)
        code, cost = top[0].astype(np.int64), loss[0]
        for k in range(1, hashes):
            code = (code[:, :, None] * (2 * d) + top[k][:, None, :]).reshape(len(x), -1)
            cost = (cost[:, :, None] + loss[k][:, None, :]).reshape(len(x), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            code, cost = np.take_along_axis(code, best, axis=1), np.take_along_axis(cost, best, axis=1)
        out[:, t, :] = np.pad(code[:, :probes], ((0, 0), (0, probes - min(probes, code.shape[1]))), mode="edge")
    return out


def _unit(column: pa.Array) -> np.ndarray:
    """List column of one length -> unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.max(np.abs(x), axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signed(vectors: DataFrame, settings: dict) -> DataFrame:
    """(id, keys): the bucket keys of each vector, table by table. Vectors of another length have other keys."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                for at in range(0, len(part), 4096):
                    piece = part.slice(at, 4096)
                    found = codes(_unit(piece.column(1)), **settings)
                    n, tables, probes = found.shape
                    # one number for length, table and code; a clash could only add candidates
                    keys = (found * np.int64(64) + np.arange(tables)[None, :, None]) * np.int64(100_003) + np.int64(d)
                    yield pa.record_batch({"id": piece.column(0), "keys": pa.array(list(keys.reshape(n, -1)), pa.list_(pa.int64()))})

    return vectors.mapInArrow(sign, "id long, keys array<long>")


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (key, lo, hi, side, id, copies, vector, keys), together by (key, lo, hi) -> per block: (a, b, n).

    b null: vector a has n direct links, copies counted, that this block is the first to see. b given: a link, one for
    each vector and block, enough to connect what the block connects."""
    def compare(a_ids, a_x, a_m, a_k, b_ids, b_x, b_m, b_k, key, same):
        counts_a, counts_b = np.zeros(len(a_ids), dtype=np.int64), np.zeros(len(b_ids), dtype=np.int64)
        tied_a, tied_b, roots = np.full(len(a_ids), -1), np.full(len(b_ids), -1), []
        links = []
        for at in range(0, len(a_ids), 256):
            near = a_x[at : at + 256] @ b_x.T >= threshold
            if same:
                near &= np.arange(len(b_ids))[None, :] > np.arange(at, at + len(near))[:, None]
            i, j = np.nonzero(near)
            for cut in range(0, len(i), 50_000):
                p, q = i[cut : cut + 50_000] + at, j[cut : cut + 50_000]
                earlier = np.zeros(len(p), dtype=bool)
                for c in range(a_k.shape[1]):  # keys stand in one order: the first key of `a` that `b` has too is the pair's
                    earlier |= (a_k[p, c][:, None] == b_k[q]).any(axis=1) & (a_k[p, c] != key) & (a_k[p, c] < key)
                p, q = p[~earlier], q[~earlier]
                np.add.at(counts_a, p, b_m[q])
                np.add.at(counts_b, q, a_m[p])
                links.append((p, q))
        if same:
            counts_a += counts_b
        return counts_a, counts_b, links

    def spanning(n: int, pairs: list) -> list[tuple[int, int]]:
        """Links that connect what all pairs connect: each node is tied to the smallest index of its group."""
        least = np.arange(n)
        while True:
            before = least.copy()
            for p, q in pairs:
                low = np.minimum(least[p], least[q])
                np.minimum.at(least, p, low)
                np.minimum.at(least, q, low)
            least = least[least]
            if (least == before).all():
                return [(i, int(k)) for i, k in enumerate(least) if k != i]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            key, lo, hi = current
            sides = [[r for r in held if r[0] == s] for s in (0, 1)]
            if lo == hi:
                sides[1] = sides[0]
            if not sides[0] or not sides[1] or (lo == hi and len(sides[0]) < 2):
                return
            (a_ids, a_m, a_x, a_k), (b_ids, b_m, b_x, b_k) = (
                (np.array([r[1] for r in s]), np.array([r[2] for r in s]), np.stack([r[3] for r in s]), np.stack([r[4] for r in s])) for s in sides)
            n_a, n_b, links = compare(a_ids, a_x, a_m, a_k, b_ids, b_x, b_m, b_k, key, lo == hi)
            if not any(len(p) for p, _ in links):
                return
            shift = 0 if lo == hi else len(a_ids)
            ids = a_ids if lo == hi else np.concatenate((a_ids, b_ids))
            tied = spanning(len(ids), [(p, q + shift) for p, q in links])
            n = n_a if lo == hi else np.concatenate((n_a, n_b))
            some = np.flatnonzero(n)
            yield pa.record_batch({
                "a": pa.array(np.concatenate((ids[some], ids[[i for i, _ in tied]])), pa.int64()),
                "b": pa.array([None] * len(some) + [int(ids[k]) for _, k in tied], pa.int64()),
                "n": pa.array(np.concatenate((n[some], np.zeros(len(tied), dtype=np.int64))), pa.int64())})

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            vectors, keys = batch.column(6), batch.column(7)
            for i, (key, lo, hi, side, name, copies) in enumerate(zip(*columns)):
                if (key, lo, hi) != current:
                    if held:
                        yield from flush()
                    current, held = (key, lo, hi), []
                x = vectors[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
                x = x / np.max(np.abs(x))
                held.append((side, name, copies, x / np.linalg.norm(x), keys[i].values.to_numpy(zero_copy_only=False)))
        if held:
            yield from flush()

    return rows.select("key", "lo", "hi", "side", "id", "copies", "vector", "keys").mapInArrow(blocks, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK, tables: int = TABLES,
                    hashes: int = HASHES, probes: int = PROBES, seed: int = 2) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding), one row per row.

    Vectors link when they share a bucket and their cosine, in double precision, is `threshold` or more. n_links counts
    the other vectors linked directly, component_id is the smallest vec_id reachable. Null, empty and zero vectors and
    those with null or non-finite components link with nothing; so do vectors of different lengths. Equal vectors are
    compared once for all, whatever their number. A null vec_id is never the smallest. An empty table stays empty.

    Only keys of buckets with two or more vectors are followed up. A large bucket is cut into blocks by a hash and each
    pair of blocks is a unit of work, so a bucket with a third of all vectors is spread over many tasks; what a unit
    gives back is linear in its vectors. A pair is counted in the first bucket it shares."""
    usable = ("embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) and "
              "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    good = vectors.select("vec_id", F.expr("transform(embedding, x -> double(x))").alias("embedding"))
    good = good.withColumn("vector", F.when(F.coalesce(F.expr(usable), F.lit(False)), F.expr("transform(embedding, x -> x + 0.0d)"))).select("vec_id", "vector")
    classes = settle(good.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
                     .withColumn("id", F.monotonically_increasing_id()))
    signed = settle(_signed(classes.select("id", "vector"), {"tables": tables, "hashes": hashes, "probes": probes, "seed": seed}))
    entries = signed.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    buckets = entries.groupBy("key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    at = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = entries.join(buckets, "key").withColumn("at", at)
    units = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", "id", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), (F.col("at") > F.col("other")).cast("int").alias("side"))
    full = units.join(classes.select("id", "vector", "copies"), "id").join(signed.withColumnRenamed("id", "sid"), F.col("id") == F.col("sid"))
    dealt = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    seen = settle(_compared(dealt, threshold))
    links = seen.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    component = connected_components(seen.where("b is not null").select("a", "b"))
    own = (classes.join(links, "id", "left").join(component, classes["id"] == component["node"], "left")
           .select("vector", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = own.join(least, "component").select("vector", "n_links", "component_id")
    return (good.join(found, "vector", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", F.when(F.col("vector").isNull(), F.col("vec_id"))).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("vec_id").isNotNull()))
