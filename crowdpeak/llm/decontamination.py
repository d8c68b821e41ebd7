"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passage with the test item.

The n-grams of a test item that fewest documents hold are its seeds. Where a document holds a seed, the passage around
it is aligned word by word with the item, so that edited copies are found and scored too. Items are the query set:
they are held in every task, in blocks of bounded size; documents are read once to count and once to align.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crowdpeak.llm.text import slices, split_all, utf8

#: Words of a seed, share of an item's n-grams that are seeds (the rarest ones), bytes of items held at once.
SEED_WORDS, SEED_SHARE, BLOCK_BYTES = 3, 0.7, 16 << 20
#: Alignment: a word that agrees, one that differs, one left out or put in; score that marks a leak, as a share of the item's own.
MATCH, MISMATCH, GAP, LEAK = 2, -1, -1, 0.4
#: Whatever the share, a run of so many words verbatim is a leak, and an alignment that scores as much and this share of
#: what its own words could. Items below SHORT words must be there whole.
PASSAGE, IDENTITY, SHORT = 13, 0.75, 8
#: Words of passages aligned at once (one longer passage goes alone).
CELLS = 1 << 18


class Items:
    """Words of test items as numbers, and where their n-grams are."""

    def __init__(self, items: list[tuple[int, bytes]], n: int):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.words = []
        for _, text in items:
            words, _ = split_all([text])
            self.words.append(np.array([self.vocabulary.setdefault(_bare(w), len(self.vocabulary)) for w in words], dtype=np.int64))
        self.n = n
        grams, item, place = [], [], []
        for k, w in enumerate(self.words):
            g = self.grams(w, min(n, len(w))) if len(w) else np.zeros(0, dtype=np.int64)
            grams.append(g)
            item.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        self.gram, self.item, self.place = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (grams, item, place))
        by = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[by], self.item[by], self.place[by]
        self.distinct = np.unique(self.gram)
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})

    def grams(self, w: np.ndarray, n: int) -> np.ndarray:
        """One number for each run of n words, never that of a shorter run; -1 where a word is in no item."""
        size = np.int64(len(self.vocabulary) + 1)
        out, ok = np.zeros(max(0, len(w) - n + 1), dtype=np.int64), np.ones(max(0, len(w) - n + 1), dtype=bool)
        for k in range(n):
            part = w[k : k + len(out)]
            out = out * size + part + 1
            ok &= part >= 0
        return np.where(ok, out, -1)

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, at = split_all(texts)
        get = self.vocabulary.get
        return np.fromiter((get(_bare(w), -1) for w in words), dtype=np.int64, count=len(words)), at


def _bare(word: bytes) -> bytes:
    """A word without the marks around it."""
    return word.strip(b".,;:!?\"'()[]*%$#&|-") or word


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its passage, all at once: (score, first word, last word of the passage).

    Gaps cost the same for each word. Cells are worked off by row; within a row a gap along the passage is a running
    maximum. Where an alignment begins travels with its score."""
    n, rows, width = len(items), max(map(len, items)), max(map(len, passages))
    a, b = np.full((n, rows), -2, dtype=np.int64), np.full((n, width), -1, dtype=np.int64)
    for k, (x, y) in enumerate(zip(items, passages)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    best, first, last = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    column = np.arange(width)
    h, origin = np.zeros((n, width + 1), dtype=np.int64), np.tile(np.arange(width + 1), (n, 1))
    for i in range(rows):
        agree = np.where(a[:, i][:, None] == b, MATCH, MISMATCH)
        up, diagonal = h[:, 1:] + GAP, h[:, :-1] + agree
        top = np.maximum(np.maximum(up, diagonal), 0)
        source = np.where(top == 0, column[None, :] + 1, np.where(diagonal >= up, origin[:, :-1], origin[:, 1:]))
        # along the passage: max over j' <= j of top[j'] + GAP * (j - j')
        level = top - GAP * column
        run = np.maximum.accumulate(level, axis=1)
        at = np.maximum.accumulate(np.where(level == run, column, -1), axis=1)
        h, origin = np.zeros_like(h), origin.copy()
        h[:, 1:] = run + GAP * column
        origin[:, 1:] = np.take_along_axis(source, at, axis=1)
        origin[:, 0] = 0
        j = h.argmax(axis=1)
        value = h[np.arange(n), j]
        better = value > best
        best[better], last[better], first[better] = value[better], j[better] - 1, origin[np.arange(n), j][better]
    return best, first, last


def longest_runs(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Longest run of words that an item and its passage share verbatim, all at once: (words, first word in the passage)."""
    n, rows, width = len(items), max(map(len, items), default=0), max(map(len, passages), default=0)
    a, b = np.full((n, rows), -2, dtype=np.int64), np.full((n, width), -1, dtype=np.int64)
    for k, (x, y) in enumerate(zip(items, passages)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    best, last, run = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros((n, width + 1), dtype=np.int64)
    for i in range(rows):
        run[:, 1:] = np.where(a[:, i][:, None] == b, run[:, :-1] + 1, 0)
        j = run.argmax(axis=1)
        value = run[np.arange(n), j]
        last = np.where(value > best, j, last)
        best = np.maximum(best, value)
    return best, last - best


def alike(windows: list, lengths: np.ndarray) -> Iterator[list]:
    """The windows (text, item, start, stop) in batches of bounded size, in which neither items nor passages differ by more
    than a factor of two in length, so that filling up the shorter ones costs no more than that."""
    def size(x) -> tuple[int, int]:
        return int(lengths[x[1]]).bit_length(), (x[3] - x[2]).bit_length()

    for (_, bits), some in groupby(sorted(windows, key=size), size):
        batch, many = list(some), max(1, CELLS >> bits)
        for cut in range(0, len(batch), many):
            yield batch[cut : cut + many]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of at most about BLOCK_BYTES of text; one block is on the driver at a time."""
    held, size = [], 0
    for item, text in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        b = text.encode()
        if held and size + len(b) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((item, b))
        size += len(b)
    if held:
        yield held


def _gram_counts(docs: DataFrame, items) -> dict[int, int]:
    """In how many documents each n-gram of the items is. At most as many rows as the items have n-grams."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = items.value
        total = np.zeros(len(mine.distinct) + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                w, at = mine.numbers(utf8(part.column(0)))
                found, owner, _ = _hits(mine, w, at, mine.distinct)
                pair = np.unique(np.stack((owner, found)), axis=1) if len(found) else np.zeros((2, 0), dtype=np.int64)
                np.add.at(total, pair[1], 1)
        some = np.flatnonzero(total)
        yield pa.record_batch({"k": some.astype(np.int64), "n": total[some]})

    rows = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return dict(rows.collect())


def _hits(items: Items, w: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in `wanted`, text, place) of the wanted n-grams (sorted) in texts given as word numbers."""
    found = [np.zeros((3, 0), dtype=np.int64)]
    for n in items.sizes if len(wanted) else ():
        g = items.grams(w, n)
        k = np.searchsorted(wanted, g)
        k[k == len(wanted)] = 0
        place = np.flatnonzero((wanted[k] == g) & (g >= 0))
        owner = np.searchsorted(at, place, side="right") - 1
        inside = place + n <= at[owner + 1]
        found.append(np.stack((k[place][inside], owner[inside], place[inside])))
    return tuple(np.concatenate(found, axis=1))


def find_leaks(docs: DataFrame, benchmark: DataFrame, leak: float = LEAK, n: int = SEED_WORDS, seed_share: float = SEED_SHARE,
               carry: str | None = None) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): documents that hold a passage aligned with a test item.

    score is the alignment score over that of the item with itself; the words are counted from 0 in the document. A leak
    has a score of at least `leak`, or else PASSAGE words of the item verbatim or an alignment that long and close to
    it, so that the passage that counts does not grow with the item. Items below SHORT words must be there whole.
    One row for each row of `docs` and item, the best passage. Words are lower-cased (A-Z) and stripped of marks. The
    seeds of an item are the rarest of its n-grams, by rank within the item, so an item that a large part of the corpus
    holds keeps its seeds too, and the rarest in each short stretch of it, so that no PASSAGE words are without; the
    seed of an item shorter than n words is all of it. Null and empty items have none and find nothing; null and empty texts hold
    nothing; a null doc_id is carried, and so is the column `carry` of `docs`, as `carried`. Of passages of a document
    that score alike for an item, the first one counts. Repeated documents and items give repeated
    rows. Empty tables give an empty table. Extra columns are not looked at."""
    spark, out = docs.sparkSession, None
    docs = docs.select("text", "doc_id", *([F.col(carry).alias("carried")] if carry else []))
    for block in _blocks(benchmark):
        items = Items(block, n)
        shared = spark.sparkContext.broadcast(items)
        counts = _gram_counts(docs, shared)
        seen = np.array([counts.get(k, 0) for k in range(len(items.distinct))], dtype=np.int64)
        times = seen[np.searchsorted(items.distinct, items.gram)] if len(items.gram) else items.gram
        seed = np.zeros(len(items.gram), dtype=bool)
        for k in range(len(items.words)):
            mine = np.flatnonzero(items.item == k)
            order = mine[np.argsort(times[mine], kind="stable")]
            seed[order[: math.ceil(len(mine) * seed_share)]] = True
            stretch, rank = items.place[order] // max(1, (PASSAGE - n + 1) // 2), np.arange(len(order))
            by = np.lexsort((rank, stretch))
            seed[order[by[np.flatnonzero(np.diff(stretch[by], prepend=-1))]]] = True
        found = _aligned(docs, shared, spark.sparkContext.broadcast(seed), leak)
        out = found if out is None else out.union(found)
    return out if out is not None else _aligned(docs, spark.sparkContext.broadcast(Items([], n)), spark.sparkContext.broadcast(np.zeros(0, dtype=bool)), leak)


def _aligned(docs: DataFrame, shared, seeds, leak: float) -> DataFrame:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, chosen = shared.value, seeds.value
        gram, item, place = items.gram[chosen], items.item[chosen], items.place[chosen]
        wanted = np.unique(gram)
        for batch in batches:
            for part in slices(batch):
                w, at = items.numbers(utf8(part.column(0)))
                k, owner, where = _hits(items, w, at, wanted)
                if not len(k):
                    continue
                lo, hi = np.searchsorted(gram, wanted[k], "left"), np.searchsorted(gram, wanted[k], "right")
                rep = np.repeat(np.arange(len(k)), hi - lo)
                which = np.repeat(lo, hi - lo) + np.arange(len(rep)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                lengths = np.array([len(x) for x in items.words])
                target = item[which]
                slack = lengths[target] // 4 + 4
                start = np.maximum(at[owner[rep]], where[rep] - place[which] - slack)
                stop = np.minimum(at[owner[rep] + 1], where[rep] - place[which] + lengths[target] + slack)
                by = np.lexsort((start, target, owner[rep]))
                windows: list[list[int]] = []  # hits of one document and item whose windows overlap are one window
                for i in by:
                    d, t, a, b = int(owner[rep[i]]), int(target[i]), int(start[i]), int(stop[i])
                    last = windows[-1] if windows else None
                    if last and last[0] == d and last[1] == t and a <= last[3] and b - last[2] <= 4 * int(lengths[t]) + 64:
                        last[3] = max(last[3], b)
                    else:
                        windows.append([d, t, a, b])
                best: dict[tuple[int, int], tuple] = {}
                for some in alike(windows, lengths):
                    scores, first, last_word = smith_waterman([items.words[t] for _, t, _, _ in some], [w[a:b] for _, _, a, b in some])
                    size = np.array([len(items.words[t]) for _, t, _, _ in some])
                    close = scores >= IDENTITY * MATCH * (last_word - first + 1)
                    held = np.where(size < SHORT, scores == MATCH * size, (scores >= leak * MATCH * size) | ((scores >= MATCH * PASSAGE) & close))
                    open_ = np.flatnonzero(~held & (size >= SHORT) & (scores >= MATCH * PASSAGE))  # as a verbatim run would score
                    runs, begin = longest_runs([items.words[some[i][1]] for i in open_], [w[some[i][2] : some[i][3]] for i in open_])
                    whole = runs >= PASSAGE
                    held[open_[whole]] = True
                    scores[open_[whole]], first[open_[whole]], last_word[open_[whole]] = MATCH * runs[whole], begin[whole], (begin + runs - 1)[whole]
                    for (d, t, a, _), s, f, e, leaks in zip(some, scores.tolist(), first.tolist(), last_word.tolist(), held.tolist()):
                        share = s / (MATCH * len(items.words[t]))
                        if leaks:
                            best[d, t] = max(best.get((d, t), (0.0, 0, 0)), (share, -(a + f - int(at[d])), a + e - int(at[d])))
                if best:
                    of = pa.array([d for d, _ in best], pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        part.column(1).take(of).cast(pa.int64()), pa.array([items.ids[t] for _, t in best], pa.int64()),
                        pa.array([v[0] for v in best.values()], pa.float64()), pa.array([-v[1] for v in best.values()], pa.int64()),
                        pa.array([v[2] for v in best.values()], pa.int64()), *[c.take(of) for c in part.columns[2:]]], names=schema.names)

    schema = StructType.fromDDL("doc_id long, item_id long, score double, first_word long, last_word long")
    schema = StructType(schema.fields + docs.schema.fields[2:])
    return docs.mapInArrow(align, schema)
