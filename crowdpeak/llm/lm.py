"""Cross-entropy difference: a target and a background n-gram model over one vocabulary score every document.

Both are interpolated bigram models that differ only in the documents they count: the background model counts all,
the target model those of high quality. The loss of a token under one less that under the other, summed over the
document and divided by its tokens, is the score: low where a text looks like the target.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdpeak.llm.store import settle
from crowdpeak.llm.text import LOWER, utf8

#: Weight of the shorter history: counts added to those of a bigram, and to those of a word.
BACKOFF, FLOOR = 4.0, 0.5
#: The beginning of a text and 64 kinds of unknown words, before the vocabulary.
UNKNOWN = 65
#: Text that is counted and scored at once. A slice sends the distinct words and bigrams in it, and gets back their counts.
SLICE_BYTES = 16 << 20
#: Hash cells of the plain model that tests compare with; the scoring counts bigrams exactly.
CELL_BITS = 18
#: Keys of a slice's sums beside those of kinds (1 to 64) and bigrams: its tokens, and the vocabulary that only it holds.
TOKENS, ONLY_HERE = -1, -2


def _kind(word: bytes) -> int:
    """Number of an unknown word, from its length and whether it has digits, marks or bytes beyond ASCII."""
    return 1 + min(7, len(word) // 3) * 8 + (any(48 <= b <= 57 for b in word)) + 2 * (not word.isalnum()) + 4 * (max(word) > 127)


class Numbers:
    """Texts to word numbers; 0 marks the beginning of a text (no unknown word has that kind)."""

    def __init__(self, words: dict[bytes, int]):
        self.words, self.size = words, UNKNOWN + len(words)

    def __call__(self, text: bytes) -> np.ndarray:
        get, found = self.words.get, text.translate(LOWER).split()
        return np.fromiter((get(w) or _kind(w) for w in found), dtype=np.int64, count=len(found))

    def cells(self, ids: np.ndarray) -> np.ndarray:
        """Hash cells of (word before, word), the first after the beginning."""
        pair = (np.concatenate(([0], ids[:-1])) * np.int64(self.size) + ids).astype(np.uint64)
        return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Model:
    """Log probabilities of one set of counts: (cell + BACKOFF * p(word)) / (count of the word before + BACKOFF)."""

    def __init__(self, ones: np.ndarray, cells: np.ndarray, n_docs: int):
        self.p = (ones + FLOOR) / (ones.sum() + FLOOR * len(ones))
        self.before = ones.astype(np.float64)
        self.before[0] = n_docs
        self.cells = cells

    def losses(self, ids: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Loss of each token in nats."""
        history = self.before[np.concatenate(([0], ids[:-1]))]
        return -np.log((self.cells[cells] + BACKOFF * self.p[ids]) / (np.maximum(history, self.cells[cells]) + BACKOFF))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Slice:
    """Words and bigrams of some texts, and how often they are in all of them and in those of the target."""

    def __init__(self, texts: list[bytes], chosen: np.ndarray):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        parts = [np.fromiter(map(number.__getitem__, b.translate(LOWER).split()), dtype=np.int64) for b in texts]
        self.lengths = np.array([len(x) for x in parts], dtype=np.int64)
        self.ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        self.of = np.repeat(np.arange(len(parts)), self.lengths)
        self.hit = np.asarray(chosen, dtype=bool)[self.of]
        self.words = list(number)
        self.keys = np.array([(xxhash.xxh3_64_intdigest(w) >> 2) + UNKNOWN for w in self.words], dtype=np.int64)
        self.n, self.t = (np.bincount(x, minlength=len(self.words)) for x in (self.ids, self.ids[self.hit]))

    def resolve(self, n: np.ndarray, t: np.ndarray) -> None:
        """Takes the counts of the words in all slices; words of one document become kinds."""
        first, last = np.zeros((2, len(self.words)), dtype=np.int64)
        last[self.ids], first[self.ids[::-1]] = self.of, self.of[::-1]
        elsewhere = n != self.n
        known = (first != last) | elsewhere
        self.only_here = int(known.sum() - elsewhere.sum())
        self.n, self.t = n, t
        unit = UNKNOWN + np.arange(len(self.words))
        for j in np.flatnonzero(~known):
            unit[j] = _kind(self.words[j])
        self.units = unit[self.ids]
        size = UNKNOWN + len(self.words)
        self.kinds_n, self.kinds_t = (np.bincount(x[x < UNKNOWN], minlength=UNKNOWN) for x in (self.units, self.units[self.hit]))
        begins = np.zeros(len(self.ids), dtype=bool)
        begins[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = True
        before = np.where(begins, 0, np.roll(self.units, 1)) if len(self.ids) else self.units
        code, self.pair_of, self.pair_n = np.unique(before * size + self.units, return_inverse=True, return_counts=True)
        self.pair_t = np.bincount(self.pair_of[self.hit], minlength=len(code))
        self.left, self.right = code // size, code % size
        key_of = np.concatenate((np.arange(UNKNOWN), self.keys)).astype(np.uint64)
        mixed = _mixed(_mixed(key_of[self.left] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + key_of[self.right])
        self.pair_keys = (mixed >> np.uint64(2)).astype(np.int64) + UNKNOWN

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, count, count in the target) of bigrams, kinds, tokens and the vocabulary of this slice alone."""
        return (np.concatenate((self.pair_keys, np.arange(1, UNKNOWN), [TOKENS, ONLY_HERE])),
                np.concatenate((self.pair_n, self.kinds_n[1:], [len(self.ids), self.only_here])),
                np.concatenate((self.pair_t, self.kinds_t[1:], [int(self.hit.sum()), 0])))

    def losses(self, all_n: np.ndarray, all_t: np.ndarray, elsewhere: int, sizes: tuple[int, int]) -> list[np.ndarray]:
        """Mean loss of each text in nats, under the target and under the background, from the sums of all slices."""
        pairs, words = len(self.pair_keys), UNKNOWN + elsewhere + int(all_n[-1])
        out = []
        for count, ones, total in ((all_t, self.t, sizes[1]), (all_n, self.n, sizes[0])):
            of_unit = np.concatenate(([0], count[pairs:-2], ones)).astype(np.float64)
            p = (of_unit + FLOOR) / (count[-2] + FLOOR * words)
            of_unit[0] = total
            loss = -np.log((count[:pairs] + BACKOFF * p[self.right]) / (of_unit[self.left] + BACKOFF))
            out.append(np.bincount(self.of, weights=loss[self.pair_of], minlength=len(self.lengths)) / np.maximum(self.lengths, 1))
        return out


def _sliced(docs: DataFrame, most_bytes: int) -> DataFrame:
    """A row (slice, rows) for each slice of consecutive rows, compressed; a text longer than `most_bytes` is a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held))
            return pa.record_batch({"slice": pa.array([part + k], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            start = 0
            for i, b in enumerate(utf8(batch.column(2))):
                if size and size + len(b) > most_bytes:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield packed()
                    start, k, held, size = i, k + 1, [], 0
                size += len(b) + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield packed()

    return docs.select("doc_id", "target", "text").mapInArrow(run, "slice long, rows binary")


def _read(rows: bytes) -> tuple[pa.Table, Slice]:
    table = pa.ipc.open_stream(rows).read_all()
    return table, Slice([b for part in table.column("text").chunks for b in utf8(part)], table.column("target").to_numpy())


def _edges(parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of keys begins, but the first, which also has the keys of kinds and sums."""
    return np.array([(1 << 62) * k // parts for k in range(1, parts)], dtype=np.int64)


def _squeezed(*columns: np.ndarray) -> bytes:
    """Whole numbers of one length in few bytes: the steps of ascending keys and small counts have mostly empty high bytes."""
    planes = np.stack(columns).astype("<i8").view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unsqueezed(held: bytes, columns: int) -> np.ndarray:
    planes = pa.decompress(held[8:], int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1)).view("<i8")[:, :, 0]


def _asked(number: int, key: np.ndarray, n: np.ndarray, t: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(slice, part, sums) for each range of keys in which the slice counts any."""
    order = np.argsort(key, kind="stable")
    cuts = np.concatenate(([0], np.searchsorted(key[order], edges), [len(key)]))
    parts = np.flatnonzero(np.diff(cuts))
    for some in np.array_split(parts, max(1, len(parts) // 256)):
        mine = [order[cuts[k] : cuts[k + 1]] for k in some]
        sums = [_squeezed(np.diff(key[x], prepend=np.int64(0)), n[x], t[x]) for x in mine]
        yield pa.record_batch({"slice": pa.array(np.full(len(some), number)), "part": pa.array(some), "sums": pa.array(sums, pa.binary())})


def _answered(asked: pa.Table) -> pa.Table:
    """(slice, part, sums, shared): for each slice the sums over all slices of its keys of one range, in their order; and,
    once for the range, how many of its keys several slices count."""
    held = [_unsqueezed(x.as_py(), 3) for x in asked.column("sums")]
    key, inverse = np.unique(np.concatenate([np.cumsum(x[0]) for x in held]), return_inverse=True)
    n, t = np.zeros((2, len(key)), dtype=np.int64)
    for c, out in ((1, n), (2, t)):
        np.add.at(out, inverse, np.concatenate([x[c] for x in held]))
    cuts = np.concatenate(([0], np.cumsum([len(x[0]) for x in held])))
    shared = np.zeros(len(held), dtype=np.int64)
    shared[0] = np.count_nonzero(np.bincount(inverse) > 1)
    sums = [_squeezed(n[x], t[x]) for x in (inverse[a:b] for a, b in zip(cuts, cuts[1:]))]
    return pa.table({"slice": asked.column("slice"), "part": asked.column("part"), "sums": pa.array(sums, pa.binary()), "shared": pa.array(shared)})


def _whole(key: np.ndarray, part: pa.Array | pa.ChunkedArray, sums: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The sums over all slices of the keys of one slice, in the order of `key`."""
    held = [_unsqueezed(sums[int(k)].as_py(), 2) for k in np.argsort(part.to_numpy(), kind="stable")]
    n, t = np.zeros((2, len(key)), dtype=np.int64)
    order = np.argsort(key, kind="stable")
    for c, out in enumerate((n, t)):
        out[order] = np.concatenate([x[c] for x in held]) if held else []
    return n, t


def score_documents(docs: DataFrame, labels: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of `docs`, whole texts.

    The losses are means over the tokens in nats, score = target_loss - background_loss. The target are the rows whose
    doc_id has a quality label of 1; the background are all rows. Every word that two rows hold is in the vocabulary and
    every bigram has a count of its own, whatever the size of the input: counts are tables by key (62-bit hashes), and
    a slice of rows gets those of its own words and bigrams. Null and empty texts and those of white space have no
    tokens and three zeros. Repeated rows count as often as they are there; a null doc_id is never in the target; labels
    repeated for an id count once, 1 if any is. An empty table gives an empty table."""
    # Labels grow with the documents, so this join is planned at every size as it must be at a large one.
    good = labels.where("quality = 1").select("doc_id").distinct().withColumn("target", F.lit(True)).hint("merge")
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left").select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")
    rows = settle(_sliced(marked, slice_bytes))
    n_docs, n_target = marked.agg(F.count("*"), F.count_if("target")).first()

    # As many ranges of keys as slices: the task of a range holds about what a slice sends, however many slices there are.
    edges = _edges(max(1, rows.count()))
    asked, answered = "slice long, part long, sums binary", "slice long, part long, sums binary, shared long"

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held in zip(batch.column(0), batch.column(1)):
                found = _read(held.as_py())[1]
                yield from _asked(number.as_py(), found.keys, found.n, found.t, edges)

    answers = settle(rows.mapInArrow(words, asked).groupBy("part").applyInArrow(_answered, answered))
    shared_words = answers.agg(F.coalesce(F.sum("shared"), F.lit(0))).first()[0]
    both = rows.join(answers.groupBy("slice").agg(F.collect_list("part").alias("part"), F.collect_list("sums").alias("words")), "slice", "left")

    def resolved(held: bytes, part: pa.Scalar, words: pa.Scalar) -> tuple[pa.Table, Slice]:
        table, found = _read(held)
        if words.is_valid:
            found.resolve(*_whole(found.keys, part.values, words.values))
        else:
            found.resolve(found.n, found.t)
        return table, found

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held, part, words in zip(*batch.columns):
                yield from _asked(number.as_py(), *resolved(held.as_py(), part, words)[1].sums(), edges)

    def scored(mine: pa.Table, given: pa.Table) -> pa.Table:
        table, found = resolved(mine.column("rows")[0].as_py(), mine.column("part")[0], mine.column("words")[0])
        target, background = found.losses(*_whole(found.sums()[0], given.column("part"), given.column("sums")), shared_words, (n_docs, n_target))
        return pa.table({"doc_id": table.column("doc_id"), "n_tokens": found.lengths, "target_loss": target, "background_loss": background, "score": target - background})

    both = both.select("slice", "rows", "part", "words")
    given = both.mapInArrow(pairs, asked).groupBy("part").applyInArrow(_answered, answered).select("slice", "part", "sums")
    return both.groupBy("slice").cogroup(given.groupBy("slice")).applyInArrow(scored, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
