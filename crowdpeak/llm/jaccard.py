"""Jaccard join of n-gram sets by T-occurrence search: short inverted lists are merged, long ones probed (DivideSkip).

A set of n shingles and a partner with Jaccard similarity t or more share at least T = ceil(t * n) shingles. Lists are
ordered by length, so that whatever is shared by many documents comes last. Of the n lists of a set, leave out the
T - 1 longest: a partner must be on one of the others. Those short lists give the candidates (a shuffle by shingle);
a candidate is then searched for in blocks: short lists are merged with a heap, candidates that occur often enough
there are looked up in the long lists by binary search.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdpeak.llm.graph import connected_components
from crowdpeak.llm.store import free_name, settle
from crowdpeak.llm.text import WORD, shingle_sets, slices, utf8, word_hashes

#: Lists are ordered by the summed length of all lists in their bucket; so many buckets there are, whatever the input.
BUCKET_BITS = 16
#: Shingles that one search block holds in the mean, and bits of the filter over rows at most.
BLOCK_SHINGLES, FILTER_BITS = 400_000, 27
#: Members that stand for a list, and candidates that each class is compared with, in each round before what is left is
#: searched among whole components.
STARS = (1, 3)


def row_key(docs: DataFrame):
    """128 bits that tell rows apart by id and text; never null. Rows alike in both have one key."""
    return F.struct(*[F.xxhash64(F.lit(k), F.lit(k) + F.col("doc_id").isNull().cast("int"), "doc_id", "text").alias(f"k{k}") for k in (1, 2)])


def first_pass(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, row, n_shingles, print, counts): for each row its key, the size and a 128-bit fingerprint of its set, counts
    null; and for each task a row of nulls with the number of shingles in each of 2 ** BUCKET_BITS buckets."""
    key = pa.struct([("k1", pa.int64()), ("k2", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = word_hashes(), np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("row", key), ("n_shingles", pa.int64()), ("print", pa.binary()), ("counts", pa.list_(pa.int64()))])
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(utf8(part.column(1)), memo, n)
                total += np.bincount(np.concatenate(sets) >> (63 - BUCKET_BITS), minlength=len(total))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2).cast(key), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()),
                    pa.nulls(len(sets), pa.list_(pa.int64()))], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, key), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                          pa.array([total], pa.list_(pa.int64()))], schema=schema)

    return docs.select("doc_id", "text", row_key(docs).alias("row")).mapInArrow(
        count, "doc_id long, row struct<k1:long,k2:long>, n_shingles long, print binary, counts array<long>")


def fingerprint(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def bucket_counts(passed: DataFrame) -> list[int]:
    """How many shingles of all documents fall into each bucket: 2 ** BUCKET_BITS numbers for any input."""
    out = [0] * (1 << BUCKET_BITS)
    rows = passed.where("counts is not null").select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, total in rows.collect():
        out[bucket] = total
    return out


def renumbering(counts: list[int]) -> np.ndarray:
    """New numbers of the buckets, those with few shingles first."""
    order = np.argsort(np.asarray(counts, dtype=np.int64), kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank


def ordered(sets: list[np.ndarray], rank: np.ndarray) -> list[np.ndarray]:
    """The sets with the bucket bits of each shingle renumbered (one to one), ascending: short lists first."""
    low = np.int64((1 << (63 - BUCKET_BITS)) - 1)
    return [np.sort((rank[s >> (63 - BUCKET_BITS)] << (63 - BUCKET_BITS)) | (s & low)) for s in sets]


def least_overlap(n, percent: int = 80):
    """T of a set of n shingles."""
    return -((-percent * n) // 100)


class Block:
    """Inverted lists of some sets: for each shingle the ascending places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.lengths = [len(s) for s in sets]
        values = np.concatenate(sets)
        by = np.argsort(values, kind="stable")
        self.values, self.owners = values[by], np.repeat(np.arange(len(sets)), self.lengths)[by]

    def lists(self, query: np.ndarray) -> list[list[int]]:
        """The lists of the query's shingles that are not empty, short ones first."""
        lo, hi = np.searchsorted(self.values, query, "left"), np.searchsorted(self.values, query, "right")
        some = np.flatnonzero(hi > lo)
        return sorted((self.owners[lo[k] : hi[k]].tolist() for k in some), key=len)

    def occurrences(self, query: np.ndarray, needed: int) -> dict[int, int]:
        """DivideSkip: {place of a set: shingles shared with the query}, of all sets that share `needed` or more.

        The longest lists are set apart, at most needed - 1 and fewer the longer they are; the others are merged
        through a heap. A set on as many of them as can still reach `needed` is looked up in the lists set apart."""
        lists = self.lists(query)
        if needed < 1 or len(lists) < needed:
            return {}
        apart = min(needed - 1, int(needed / (0.01 * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - apart], lists[len(lists) - apart:]
        out: dict[int, int] = {}
        current, seen = -1, 0

        def close(found: int, times: int) -> None:
            left = len(long)
            if times < needed - left:
                return
            for posting in reversed(long):
                left -= 1
                k = bisect_left(posting, found)
                times += k < len(posting) and posting[k] == found
                if times + left < needed:
                    return
            out[found] = times

        for found in heapq.merge(*short):
            if found == current:
                seen += 1
                continue
            if current >= 0:
                close(current, seen)
            current, seen = found, 1
        if current >= 0:
            close(current, seen)
        return out


def occurrences(sets: list[np.ndarray], query: np.ndarray, needed: int) -> dict[int, int]:
    return Block(sets).occurrences(query, needed) if sets else {}


def short_lists(docs: DataFrame, rank: np.ndarray, n: int, percent: int) -> DataFrame:
    """(print, n, short) of each row with a set: the shingles of its short lists."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            for part in slices(batch):
                mine = [s for s in shingle_sets(utf8(part.column(0)), memo, n) if len(s)]
                short = [s[: len(s) - least_overlap(len(s), percent) + 1] for s in ordered(mine, rank)]
                yield pa.record_batch({"print": pa.array([fingerprint(s) for s in mine], pa.binary()), "n": pa.array([len(s) for s in mine], pa.int64()),
                                       "short": pa.array(short, pa.list_(pa.int64()))})

    return docs.select("text").mapInArrow(sets, "print binary, n long, short array<long>")


def row_filter(wanted: DataFrame, size: int) -> np.ndarray:
    """Packed bits, two set for each row key of `wanted` (row), made on the executors in pieces of 32,768 bits."""
    place = F.explode(F.array(*[F.pmod(f"row.k{k}", F.lit(size)) + 1 for k in (1, 2)])).alias("place")
    pieces = (wanted.select(place).groupBy(F.bitmap_bucket_number("place").alias("piece"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")))
    out = np.zeros(size // 8, dtype=np.uint8)
    for piece, bits in pieces.collect():  # at most 2 ** FILTER_BITS bits in all
        out[(piece - 1) * 4096 : piece * 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out


def whole_sets(docs: DataFrame, wanted: DataFrame, rank: np.ndarray, n: int) -> DataFrame:
    """(print, all): whole ordered sets of at least the rows whose key is in `wanted` (row).

    A bit filter over the keys, of at most 2 ** FILTER_BITS bits, spares most other texts; it may let some through."""
    size = 1 << min(FILTER_BITS, max(16, (16 * wanted.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(row_filter(wanted, size))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = word_hashes(), np.unpackbits(shared.value, bitorder="little").astype(bool)
        for batch in batches:
            one, two = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for part in slices(batch.filter(pa.array(known[one] & known[two]))):
                mine = shingle_sets(utf8(part.column(0)), memo, n)
                some = [s for s in mine if len(s)]
                yield pa.record_batch({"print": pa.array([fingerprint(s) for s in some], pa.binary()),
                                       "all": pa.array([s.tobytes() for s in ordered(some, rank)], pa.binary())})

    keyed = docs.select("text", row_key(docs).alias("row")).select("text", *[F.pmod(f"row.k{k}", F.lit(size)).alias(f"b{k}") for k in (1, 2)])
    return keyed.mapInArrow(sets, "print binary, all binary")


def search(docs: DataFrame, index: DataFrame, queries: DataFrame, classes: DataFrame, rank: np.ndarray, n: int, percent: int,
           one: bool = False) -> DataFrame:
    """(a, b): queries a of (group, id) and sets b of the index (group, id) of the same group that reach the similarity.

    Neither table repeats a row. A distinct() here would be done where a join by group has put the rows, a hot group in
    one task.

    The index of a group is cut into parts of bounded size; each of its sets goes to one part, each query to all parts.
    A part is a block of inverted lists, in which its queries are searched one by one. With `one`, a query gives at
    most one link in each part."""
    index, queries = settle(index.select("group", "id")), settle(queries.select("group", "id"))
    sizes = classes.select("id", "n", "print", "rep")
    index, queries = index.join(sizes, "id"), queries.join(sizes, "id")
    parts = index.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    placed = (index.join(parts, "group").select("print", "rep", "group", "id", F.lit(False).alias("asks"), F.pmod(F.hash("id"), F.col("parts")).alias("part"))
              .union(queries.join(parts, "group").select("print", "rep", "group", "id", F.lit(True), F.explode(F.expr("sequence(0, parts - 1)")))))
    sets = whole_sets(docs, placed.select(F.col("rep.row").alias("row")).distinct(), rank, n).dropDuplicates(["print"])
    dealt = (sets.join(placed, "print").select("group", "part", "asks", "id", "all")
             .repartition("group", "part").sortWithinPartitions("group", "part", "asks", "id"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, held, block = None, [], [], None
        for batch in batches:
            asked, found = [], []
            for group, part, asks, name, every in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (group, part) != current:
                    current, ids, held, block = (group, part), [], [], None
                if not asks:
                    ids.append(name)
                    held.append(np.frombuffer(every, dtype=np.int64))
                    continue
                if block is None:
                    if not held:
                        continue
                    block, held = Block(held), []
                query = np.frombuffer(every, dtype=np.int64)
                hits = block.occurrences(query, least_overlap(len(query), percent))
                links = [ids[k] for k, shared in hits.items() if 100 * shared >= percent * (len(query) + block.lengths[k] - shared) and ids[k] != name]
                for other in links[:1] if one else links:
                    asked.append(name)
                    found.append(other)
            yield pa.record_batch({"a": pa.array(asked, pa.int64()), "b": pa.array(found, pa.int64())})

    return dealt.mapInArrow(find, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of (doc_id, text): groups of documents linked at `percent` or more.

    One row per row of `docs`. component_id is the smallest doc_id that can be reached by links. Texts without words
    (null, empty, white space) have no shingles, link with nothing and are their own component. Equal sets are one
    class, whatever their number, and meet as one. Rows with a null doc_id link like all others; a null is no smallest
    id: a component has the smallest id that is there, or null. Repeated ids count as rows. An empty table gives an empty
    table."""
    rows, own = _classes(docs, n, percent)
    least = own.groupBy("component").agg(F.min("rep.doc_id").alias("component_id"))
    found = own.join(least, "component").select("print", "component_id")
    return (rows.join(found, "print", "left")
            .select("doc_id", "n_shingles", F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group of linked documents, that with the smallest doc_id (nulls last).

    Rows are told apart by id and text, so that different texts under one id, and texts under none, are decided on one by
    one. Of rows alike in both, any one stays. Texts without words are in no group and all stay. Extra columns stay."""
    key, = free_name(docs, "row")
    _, own = _classes(docs, n, percent)
    chosen = own.groupBy("component").agg(F.min("rep").alias("rep")).select(
        F.struct(*[F.coalesce(f"rep.row.{k}", F.lit(0).cast("long")).alias(k) for k in ("k1", "k2")]).alias(key))  # as the keys, without nulls
    keyed, worded = docs.withColumn(key, row_key(docs)), F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = keyed.where(worded).join(chosen, key, "left_semi").dropDuplicates([key])
    return kept.select(*docs.columns).union(docs.where(~worded))


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n_shingles, print) of each row, and (print, rep, component) of each class of equal sets. rep is the row
    of the class with the smallest doc_id (nulls last), as (none, doc_id, row).

    In some rounds a few members of each short list stand for it, and each class is compared with the few with which
    it shares most lists (rows in proportion to postings, not to pairs). Where members of a list are then still in
    several components, those of the smaller ones are searched among all members of the larger ones, in blocks."""
    docs = docs.select("doc_id", "text")
    passed = settle(first_pass(docs, n))
    rank = renumbering(bucket_counts(passed))
    rows = passed.where("counts is null").select("doc_id", "row", "n_shingles", "print")
    reps = rows.where("print is not null").groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("rep"))
    short = short_lists(docs, rank, n, percent).groupBy("print").agg(F.first("n").alias("n"), F.first("short").alias("short"))
    classes = settle(short.withColumn("id", F.monotonically_increasing_id()))
    lists = Window.partitionBy("token")
    shared = settle(classes.select("id", "n", F.posexplode("short").alias("at", "token"))
                    .withColumn("size", F.count("*").over(lists)).where("size > 1").select("token", "id", "n", "at"))
    classes = settle(classes.drop("short").join(reps, "print"))
    placed, component = shared.withColumn("component", F.col("id")).withColumn("members", F.lit(1)), None
    for turn, centers in enumerate(STARS):
        # some members stand for a list, those of the largest components first; smaller components are held against them
        order = Window.partitionBy("token").orderBy(F.desc("members"), F.xxhash64(F.lit(turn), "id"))
        heads = (placed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= centers)
                 .select("token", F.col("id").alias("a"), F.struct("members", "component").alias("head")))
        stars = (placed.withColumnRenamed("id", "b").join(heads, "token").where("component <> head.component")
                 .where(F.struct("members", "component") < F.col("head")).groupBy("a", "b").agg(F.count("*").alias("c")))
        seek = Window.partitionBy("b").orderBy(F.desc("c"), "a")
        best = _near(stars, classes, percent, seen_of=4).withColumn("nth", F.row_number().over(seek)).where(F.col("nth") <= centers)
        best = settle(best.select("a", "b"))
        links = search(docs, best.select(F.col("a").alias("group"), F.col("b").alias("id")), best.select(F.col("a").alias("group"), F.col("a").alias("id")).distinct(),
                       classes, rank, n, percent)
        if component is not None:
            links = links.union(component.select(F.col("node").alias("a"), F.col("component").alias("b")))
        component = connected_components(links)
        placed = settle(_still_split(shared, component))
    # what is left: a document of a smaller component is searched among the members of each larger one on its lists
    queries = settle(_within_reach(_asked(placed, percent), placed, classes, percent))
    index = placed.select(F.col("component").alias("group"), "id").distinct().join(queries.select("group").distinct(), "group", "left_semi")
    more = search(docs, index, queries, classes, rank, n, percent, one=True)
    component = connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    own = classes.join(component, classes["id"] == component["node"], "left").select("print", "rep", F.coalesce("component", "id").alias("component"))
    return rows, own


def _still_split(shared: DataFrame, component: DataFrame) -> DataFrame:
    """(token, id, n, at, component, members) of the lists whose members are in several components."""
    sized = component.join(component.groupBy("component").agg(F.count("*").cast("int").alias("members")), "component")
    placed = (shared.join(sized.withColumnRenamed("node", "id"), "id", "left")
              .select("token", "id", "n", "at", F.coalesce("component", "id").alias("component"), F.coalesce("members", F.lit(1)).alias("members")))
    split = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    return placed.join(split, "token", "left_semi")


def _asked(placed: DataFrame, percent: int) -> DataFrame:
    """(group, id, c): sets `id` of smaller components that may reach the similarity with a member of a larger one, `group`,
    and c, the short lists on which they meet.

    Of the lists that two similar sets share, the first in the order of all lists comes before place n - O + 1 in either
    set, where n is its size and O the overlap that the two sizes ask for. So sets meet on early lists only, which are
    the less common ones."""
    overlap = F.ceil(percent * (F.col("n") + F.col("other")) / (100 + percent) - 1e-9)
    mine = placed.select("token", "id", "n", "at", F.struct("members", "component").alias("mine"))
    groups = placed.groupBy("token", F.struct("members", "component").alias("head"), F.col("n").alias("other")).agg(F.min("at").alias("first"))
    pairs = (mine.join(groups, "token").where(F.col("mine") < F.col("head"))
             .where(f"100 * least(n, other) >= {percent} * greatest(n, other)")
             .where((F.col("at") <= F.col("n") - overlap) & (F.col("first") <= F.col("other") - overlap))
             .select(F.col("head.component").alias("group"), "id").distinct())
    lists = placed.select("token", F.col("component").alias("group")).distinct()
    return (pairs.join(placed.select("token", "id"), "id").join(lists, ["token", "group"], "left_semi")
            .groupBy("group", "id").agg(F.count("*").alias("c")))


def _within_reach(asked: DataFrame, placed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(group, id) of the rows (group, id, c) whose set may reach the similarity with a member of the component `group`.

    c, the short lists on which the set meets the component, is at least what it shares with any one member. What a
    member must share follows from its size as in `_near`; of the sizes that the component has and the similarity
    allows, the least and the greatest ask for least."""
    sizes = classes.select("id", "n")
    ranges = (placed.select(F.col("component").alias("group"), "id").distinct().join(sizes, "id")
              .groupBy("group").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    rows = (asked.join(sizes, "id").join(ranges, "group").withColumn("lo", F.greatest(F.col("lo"), F.col("n") * (percent / 100)))
            .withColumn("hi", F.least(F.col("hi"), F.col("n") * (100 / percent))).where("lo <= hi + 1e-9"))
    needs = [percent / (100 + percent) * (F.col("n") + F.col(x)) - percent / 100 * F.greatest("n", x) for x in ("lo", "hi")]
    return rows.where(F.col("c") >= F.least(*needs) - 1e-6).select("group", "id")


def _near(pairs: DataFrame, classes: DataFrame, percent: int, seen_of: int = 1) -> DataFrame:
    """Pairs (a, b, c) that may reach the similarity by their sizes and by c, the short lists they share.

    With O the overlap that the similarity asks for: of the two sets, let `a` be the one whose short lists end first.
    What both share outside is at most the T - 1 lists that `a` leaves out, so c must be O - T + 1 or more.

    Where c counts only some of the lists, one in `seen_of` of those needed is asked for."""
    sizes = classes.select("id", "n")
    near = (pairs.join(sizes.withColumnsRenamed({"id": "a", "n": "a_n"}), "a").join(sizes.withColumnsRenamed({"id": "b", "n": "b_n"}), "b")
            .where(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"))
    overlap = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100 + percent) - 1e-9)
    left_out = F.ceil(percent * F.greatest("a_n", "b_n") / 100 - 1e-9) - 1
    return near.where(F.col("c") * seen_of >= overlap - left_out).select("a", "b", "c")
