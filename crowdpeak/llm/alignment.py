"""Aligning two tokenizations of the same texts: common token ends by galloping, groups between them, overlapping pairs.

Both token lists of a text are runs of byte ends. The ends of the shorter list are sought in the longer one by doubling
steps and binary search. Ends that both lists hold cut the tokens into groups; the places found also say which tokens
overlap: a token overlaps the tokens of the other list from the place of its start to the place of its end.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from crowdpeak.llm.store import Steps
from crowdpeak.llm.text import slices, utf8

#: Where the vocabulary files lie on every machine.
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How the byte-level tokenizer cuts a text before it merges bytes.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text aligned at a time, and text whose pairs are counted together (a longer single text counts alone).
AT_ONCE, SLICE_BYTES = 1 << 20, 16 << 20
#: Every how many ends of the shorter list a search starts anew from the beginning of the longer one.
ANCHORS = 32


class Vocabulary(NamedTuple):
    encode: object
    entries: list[bytes]
    lengths: np.ndarray


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(0x100 + k): b for k, b in enumerate(rest)}}


@lru_cache(maxsize=4)
def byte_level(path: str) -> Vocabulary:
    """The byte-level tokenizer of a file; strings of its special tokens are plain text."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    letters = _byte_letters()
    special = {t["id"] for t in given["added_tokens"]}
    entries = {i: bytes(letters[c] for c in t) if i not in special else t.encode() for t, i in given["model"]["vocab"].items()}
    ranks = {t: i for i, t in entries.items() if i not in special}
    encoding = tiktoken.Encoding("byte_level", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
    listed = [entries[i] for i in range(max(entries) + 1)]
    return Vocabulary(lambda texts: [encoding.encode_ordinary(" " + t) for t in texts], listed, np.array([len(t) for t in listed]))


@lru_cache(maxsize=4)
def pieces(path: str) -> Vocabulary:
    """The piece tokenizer of a file, which puts a space before the text itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def piece(i: int) -> bytes:
        return bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()

    listed = [piece(i) for i in range(model.get_piece_size())]
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), listed, np.array([len(t) for t in listed]))


def gallop(sought: np.ndarray, ends: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each sought value the first place p in at <= p < stop with ends[p] >= value; there is one. All at once:
    steps double until they reach the value or the stop, then the last step is halved."""
    low, high = at - 1, at.copy()  # ends[low] < value
    step = 1
    open_ = np.flatnonzero(ends[high] < sought)
    while len(open_):
        low[open_] = high[open_]
        step *= 2
        high[open_] = np.minimum(at[open_] + step - 1, stop[open_] - 1)
        open_ = open_[ends[high[open_]] < sought[open_]]
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = ends[middle] < sought[open_]
        low[open_[less]] = middle[less]
        high[open_[~less]] = middle[~less]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def places(short: np.ndarray, short_at: np.ndarray, long: np.ndarray, long_at: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of the shorter lists of `texts`, the place of each one's end in the longer list of its text).

    Every ANCHORS-th end gallops from the start of its text, the others from the place of the end before them that did."""
    counts = short_at[texts + 1] - short_at[texts]
    first = np.repeat(np.cumsum(counts) - counts, counts)
    within = np.arange(len(first)) - first
    tokens = np.repeat(short_at[texts], counts) + within
    start, stop = np.repeat(long_at[texts], counts), np.repeat(long_at[texts + 1], counts)
    anchored = within % ANCHORS == 0
    found = np.zeros(len(tokens), dtype=np.int64)
    found[anchored] = gallop(short[tokens[anchored]], long, start[anchored], stop[anchored])
    near = found[np.arange(len(tokens)) - within % ANCHORS]
    found[~anchored] = gallop(short[tokens[~anchored]], long, near[~anchored], stop[~anchored])
    return tokens, found


class Aligned:
    """The tokens of some texts by both tokenizers, one text after the other, and where they meet.

    a, b: ids; a_at, b_at: where each text's tokens begin (one entry more than texts); a_cut, b_cut: past the last token of
    each group; link_a, link_b: places of overlapping tokens, in order."""

    def __init__(self, texts: list[bytes], first: Vocabulary, second: Vocabulary):
        plain = [t.decode("utf-8", "replace") for t in texts]
        a, b = [], []
        for t, x, y in zip(texts, first.encode(plain), second.encode(plain)):
            same = t and b"".join(map(first.entries.__getitem__, x)) == b" " + t == b"".join(map(second.entries.__getitem__, y))
            a.append(x if same else [])
            b.append(y if same else [])
        self.a, self.a_at = self._flat(a)
        self.b, self.b_at = self._flat(b)
        # Both lists of a text cover the same bytes, so ends counted through all texts are alike.
        a_ends, b_ends = np.cumsum(first.lengths[self.a]), np.cumsum(second.lengths[self.b])
        shorter = np.diff(self.a_at) <= np.diff(self.b_at)
        ia, pa_, ca, links = self._links(a_ends, self.a_at, b_ends, self.b_at, np.flatnonzero(shorter))
        ib, pb, cb, back = self._links(b_ends, self.b_at, a_ends, self.a_at, np.flatnonzero(~shorter))
        self.a_cut = np.sort(np.concatenate([ia[ca], pb[cb]])) + 1
        self.b_cut = np.sort(np.concatenate([pa_[ca], ib[cb]])) + 1
        link_a, link_b = np.concatenate([links[0], back[1]]), np.concatenate([links[1], back[0]])
        order = np.argsort(link_a, kind="stable")
        self.link_a, self.link_b = link_a[order], link_b[order]

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(lists) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in lists], out=at[1:])
        return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(at[-1])), at

    @staticmethod
    def _links(short, short_at, long, long_at, texts):
        tokens, found = places(short, short_at, long, long_at, texts)
        common = long[found] == short[tokens]
        opening = np.zeros(len(tokens), dtype=bool)  # first token of its text
        counts = short_at[texts + 1] - short_at[texts]
        opening[(np.cumsum(counts) - counts)[counts > 0]] = True
        start = np.empty(len(tokens), dtype=np.int64)
        start[1:] = (found + common)[:-1]
        start[opening] = long_at[texts][counts > 0]
        many = found - start + 1  # difference of ranks: tokens of the longer list that this one overlaps
        left = np.repeat(tokens, many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
        return tokens, found, common, (left, right)

    def per_text(self, places: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the rising `places` fall from one text into the next (one entry more than texts)."""
        return np.searchsorted(places, at, side="left")

    def groups(self) -> list[str]:
        """For each text its groups as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        a_group = np.searchsorted(self.a_cut, np.arange(len(self.a)), side="right")
        b_group = np.searchsorted(self.b_cut, np.arange(len(self.b)), side="right")
        b_before = np.concatenate([[0], self.b_cut])  # b tokens of earlier groups
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        a_last, b_last = np.zeros(len(self.a), dtype=bool), np.zeros(len(self.b), dtype=bool)
        a_last[self.a_cut - 1] = True
        b_last[self.b_cut - 1] = True
        codes[np.arange(len(self.a)) + b_before[a_group]] = self.a * 3 + a_last
        codes[np.arange(len(self.b)) + self.a_cut[b_group]] = self.b * 3 + 2 * b_last
        names, out = _names(), []
        parts = list(map(names.__getitem__, codes.tolist()))
        at = (self.a_at + self.b_at).tolist()
        for i in range(len(at) - 1):
            out.append("".join(parts[at[i] : at[i + 1]])[:-1])
        return out


@lru_cache(maxsize=1)
def _names(most: int = 1 << 16) -> list[str]:
    """`id,` `id|` `id;` at 3 * id, 3 * id + 1, 3 * id + 2."""
    return [f"{i}{mark}" for i in range(most) for mark in ",|;"]


def _vocabularies(folder: str) -> tuple[Vocabulary, Vocabulary]:
    return byte_level(f"{folder}/{A_FILE}"), pieces(f"{folder}/{B_FILE}")


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


def align(docs: DataFrame, column: str = "text", folder: str = FOLDER) -> DataFrame:
    """`docs` with the tokens of its texts by both tokenizers and how they meet.

    a_ids, b_ids: token ids; a_cuts, b_cuts: number of tokens up to the end of each group; link_a, link_b: places (from 0)
    of all pairs of tokens whose byte ranges overlap, in order. Texts that are null, empty, or that either tokenizer does
    not give back byte for byte have no tokens and empty arrays. Columns of these names are replaced; repeated rows and
    null ids are rows like others; an empty table gives an empty table."""
    names = ["a_ids", "b_ids", "a_cuts", "b_cuts", "link_a", "link_b"]
    base = docs.drop(*names)
    schema = StructType([*base.schema.fields, *(StructField(name, ArrayType(IntegerType())) for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _vocabularies(folder)
        for batch in batches:
            for part in slices(batch, column, AT_ONCE):
                x = Aligned(utf8(part.column(part.schema.get_field_index(column))), first, second)
                cuts, links = x.per_text(x.a_cut - 1, x.a_at), x.per_text(x.link_a, x.a_at)
                many, linked = np.diff(cuts), np.diff(links)
                arrays = [_lists(x.a, x.a_at), _lists(x.b, x.b_at),
                          _lists(x.a_cut - np.repeat(x.a_at[:-1], many), cuts), _lists(x.b_cut - np.repeat(x.b_at[:-1], many), cuts),
                          _lists(x.link_a - np.repeat(x.a_at[:-1], linked), links), _lists(x.link_b - np.repeat(x.b_at[:-1], linked), links)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *names])

    return base.mapInArrow(run, schema)


def _counted(x: Aligned, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(where each text's pairs begin, its distinct id pairs as a * width + b, how often each is linked, links a text)."""
    ids = x.a[x.link_a] * width + x.b[x.link_b]
    at = x.per_text(x.link_a, x.a_at)
    texts = np.repeat(np.arange(len(at) - 1), np.diff(at))
    span = int(ids.max(initial=0)) + 1
    found, many = np.unique(texts * span + ids, return_counts=True)
    return np.searchsorted(found, np.arange(len(at)) * span), found % span, many, np.diff(at)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def link_counts(docs: DataFrame, folder: str = FOLDER, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs`, whole texts.

    The count of an id pair is the number of rows of `docs` in which two tokens of these ids overlap. n_best are the links
    whose count is the highest of all pairs with their first id (ties included), count_sum adds the counts of all links.
    groups_sha256 is the hash of the groups as decimal ids; texts without tokens (see align) have zeros and ''.

    Texts are tokenized once, in slices of `slice_bytes` (a longer text is a slice). A slice is a row of a written table:
    its rows, packed, with their distinct pairs as numbers into the slice's pairs, and for those the rows that hold them.
    Counts are sums over slices by pair, and go back to the slices that hold the pair; no text moves."""
    spark = docs.sparkSession
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _vocabularies(folder)
        width, number, held, size = len(second.entries), TaskContext.get().partitionId() << 32, [], 0

        def done() -> pa.RecordBatch:
            pairs = np.concatenate([p for _, p in held])
            known, place, rows = np.unique(pairs, return_inverse=True, return_counts=True)
            rest = pa.concat_tables([t for t, _ in held]).combine_chunks()
            at = np.concatenate([[0], np.cumsum(rest.column("distinct").to_numpy())])
            order = np.lexsort((place, np.repeat(np.arange(len(at) - 1), np.diff(at))))
            place, many = place[order], rest.column("many").combine_chunks().flatten().to_numpy()[order]
            steps = np.diff(place, prepend=0)  # rising within a row, so that steps are small
            steps[at[:-1][np.diff(at) > 0]] = place[at[:-1][np.diff(at) > 0]]
            whole = rest.select([*fields, "groups_sha256"]).append_column("steps", _lists(steps, at)).append_column("many", _lists(many, at))
            return pa.record_batch({"slice": pa.array([number], pa.int64()), "rows": pa.array([_packed(whole)], pa.binary()),
                                    "pairs": pa.array([known], pa.list_(pa.int64())), "held": pa.array([rows], pa.list_(pa.int64()))})

        for batch in batches:
            for part in slices(batch, "text", min(AT_ONCE, slice_bytes)):
                texts = utf8(part.column(1))
                more = sum(map(len, texts))
                if held and size + more > slice_bytes:
                    yield done()
                    number, held, size = number + 1, [], 0
                x = Aligned(texts, first, second)
                at, pairs, many, links = _counted(x, width)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups()]
                held.append((pa.table({
                    "doc_id": part.column(0), "n_a": np.diff(x.a_at), "n_b": np.diff(x.b_at), "n_groups": np.diff(x.per_text(x.a_cut - 1, x.a_at)),
                    "n_links": links, "groups_sha256": digests, "distinct": np.diff(at), "many": _lists(many, at)}), pairs))
                size += more
        if held:
            yield done()

    made = Steps(spark).put(docs.select("doc_id", "text").mapInArrow(tokenized, "slice long, rows binary, pairs array<long>, held array<long>"))
    width = len(pieces(f"{folder}/{B_FILE}").entries)
    each = made.select("slice", F.inline(F.arrays_zip("pairs", "held")))
    counts = each.groupBy("pairs").agg(F.sum("held").alias("n")).withColumn("first", F.floor(F.col("pairs") / width))
    best = counts.groupBy("first").agg(F.max("n").alias("most"))
    judged = counts.join(best, "first").select("pairs", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = each.select(F.col("slice").alias("asks"), "pairs").join(judged, "pairs")

    def summed(mine: pa.Table, given: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(mine.column("rows")[0].as_py()).read_all().combine_chunks()
        order = np.argsort(given.column("pairs").to_numpy())
        n, best = given.column("n").to_numpy()[order], given.column("best").to_numpy()[order]
        lists = rows.column("steps").combine_chunks()
        at = lists.offsets.to_numpy()
        steps, many = lists.flatten().to_numpy().astype(np.int64), rows.column("many").combine_chunks().flatten().to_numpy().astype(np.int64)
        place = np.cumsum(steps)
        opening = at[:-1][np.diff(at) > 0]
        place -= np.repeat(place[opening] - steps[opening], np.diff(np.append(opening, len(place))))
        total = np.concatenate([[0], np.cumsum(many * n[place])])
        top = np.concatenate([[0], np.cumsum(many * best[place])])
        return rows.select(fields).append_column("n_best", pa.array(np.diff(top[at]))).append_column("count_sum", pa.array(np.diff(total[at]))).append_column(
            "groups_sha256", rows.column("groups_sha256"))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return made.select("slice", "rows").groupBy("slice").cogroup(answers.groupBy("asks")).applyInArrow(
        summed, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
