"""Words of whole texts, inside tasks: bytes in, numpy arrays out, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The word of the contracts: everything but space and \t \n \v \f \r. bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no slice holds much more than `most_bytes` of text (a longer single text is a slice)."""
    i = batch.schema.get_field_index(column)
    sizes = np.array([len(b) for b in utf8(batch.column(i))], dtype=np.int64)
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


class Memo(dict):
    """word -> value, forgotten as a whole when it is full, so that its memory is bounded."""

    def __init__(self, fn, most: int = 200_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.fn(word)
        return value


def word_hashes(most: int = 200_000) -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, most)


def split_all(texts: list[bytes], lower: bool = True) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts one after the other, and where each text's words begin (one entry more than texts)."""
    words: list[bytes] = []
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, b in enumerate(texts):
        words += (b.translate(LOWER) if lower else b).split()
        at[i + 1] = len(words)
    return words, at


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of every run of n word hashes (uint64); runs may cross texts, the caller leaves those out."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = _mixed(out + h[k : k + len(out)] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
    return out


def shingle_sets(texts: list[bytes], memo: Memo, n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 63-bit hashes of its n-word shingles, A-Z lower-cased.

    A text of one to n - 1 words has one shingle, all its words; a text without words has none."""
    words, at = split_all(texts)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    runs = _63_bits(window_hashes(h, n))
    out = []
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= n:
            found = runs[a : b - n + 1]
        elif b > a:  # a length below n goes into the hash, so that it can't meet a run of n
            found = _63_bits(_mixed(window_hashes(h[a:b], b - a) + np.uint64(b - a)))
        else:
            found = np.zeros(0, dtype=np.int64)
        out.append(np.unique(found))
    return out


def _63_bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(1)).astype(np.int64)
