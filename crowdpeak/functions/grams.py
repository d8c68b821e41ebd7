"""Character n-grams of many texts at once, inside tasks: whole numbers in numpy arrays, in slices of bounded size.

A character is its code point plus one in 21 bits, so n-grams of up to three characters fit into 63 bits and those of
different length are different numbers. Texts are lower-cased by Spark before they come here. `hashed_counts` gives the
features of Spark ML's own tokenizer, n-grams and hashing, which make several objects for every n-gram.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

#: Characters whose n-grams are made at once. A longer single text is a slice of its own.
SLICE_CHARS = 1 << 20
BITS = 21


def text_slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(place of the first text, texts) for runs of texts with about `most` characters; null is empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > most:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def _runs(texts: list[str], sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each size (numbers of the texts, first characters, second characters, ...), one entry an occurrence."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    of = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters up to the end of the text
    for n in sizes:
        at = np.flatnonzero(left >= n)
        yield of[at], [codes[at + ahead] for ahead in range(n)]


def gram_codes(texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, n-gram) of every n-gram of every text, one entry an occurrence."""
    if max(sizes) > 3:
        raise ValueError("n-grams of more than three characters do not fit into a whole number")
    grams, owners = [], []
    for of, characters in _runs(texts, sizes):
        value = np.zeros(len(of), dtype=np.int64)
        for c in characters:
            value = (value << BITS) | (c.astype(np.int64) + 1)
        grams.append(value)
        owners.append(of)
    return np.concatenate(owners), np.concatenate(grams)


def counted(owners: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, gram, n) of each distinct pair, in order of both."""
    if not len(grams):
        return owners, grams, np.zeros(0, dtype=np.int64)
    # The distinct grams are few next to their occurrences, so the pairs are sorted as small whole numbers.
    distinct, place = np.unique(grams, return_inverse=True)
    pair, n = np.unique(owners * np.int64(len(distinct)) + place, return_counts=True)
    return pair // len(distinct), distinct[pair % len(distinct)], n


def _murmur3(words: list[np.ndarray], length: np.ndarray | int, seed: int = 42) -> np.ndarray:
    """Murmur3 of byte strings of `length`, given as their little-endian words of four bytes, zero behind the end."""
    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    h = np.full(len(words[0]), seed, dtype=np.uint32)
    for i, word in enumerate(words):
        k = turned(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        whole = turned(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h = np.where(length >= 4 * i + 4, whole, h ^ k)  # the rest behind the last whole word is mixed in another way
    h ^= np.asarray(length).astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


@functools.cache
def _plain_buckets(n: int, buckets: int) -> np.ndarray:
    """`_buckets` of all n-grams of ASCII characters, by their seven bits each; they have fixed places in the bytes."""
    characters = [(np.arange(1 << 7 * n, dtype=np.uint32) >> np.uint32(7 * (n - 1 - i))) & np.uint32(127) for i in range(n)]
    words = [np.zeros(1 << 7 * n, dtype=np.uint32) for _ in range((2 * n + 2) // 4)]
    for i in range(2 * n - 1):
        words[i // 4] |= (characters[i // 2] if i % 2 == 0 else np.uint32(32)) << np.uint32(8 * (i % 4))
    return _murmur3(words, 2 * n - 1).view(np.int32) % np.int32(buckets)


def _buckets(characters: list[np.ndarray], buckets: int) -> np.ndarray:
    """Buckets of n-grams: Murmur3 of their UTF-8 bytes, a space between any two characters."""
    size, every = 5 * len(characters) - 1, characters[0]
    for c in characters[1:]:
        every = every | c
    at = characters[0] & np.uint32(127)
    for c in characters[1:]:
        at = (at << np.uint32(7)) | (c & np.uint32(127))
    out = _plain_buckets(len(characters), buckets)[at]
    other = np.flatnonzero(every > 127)
    some = [c[other] for c in characters]
    held, end = np.zeros((len(some[0]), (size + 3) // 4 * 4), dtype=np.uint8), np.zeros(len(some[0]), dtype=np.int64)
    for i, c in enumerate(some):
        if i:
            held[np.arange(len(end)), end] = 32
            end += 1
        wide = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        for j in range(4):
            mine = np.flatnonzero(wide > j)
            bits = (c[mine] >> (6 * (wide[mine] - 1 - j)).astype(np.uint32)) & np.uint32(63)
            first = np.array([0, 0, 0xC0, 0xE0, 0xF0], dtype=np.uint32)[wide[mine]]
            held[mine, end[mine] + j] = np.where(wide[mine] == 1, c[mine], bits | (first if j == 0 else np.uint32(0x80)))
        end += wide
    out[other] = _murmur3(list(held.view("<u4").T), end).view(np.int32) % np.int32(buckets)
    return out


def hashed_counts(texts: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, bucket, n) in order of both, buckets as those of Spark's `HashingTF` over its `NGram`."""
    keys = np.concatenate([of * np.int64(buckets) + _buckets(characters, buckets) for of, characters in _runs(texts, sizes)])
    if len(texts) * buckets <= 16 * len(keys):  # long texts: a place for each bucket of each text
        n = np.bincount(keys)
        pair = np.flatnonzero(n)
        n = n[pair]
    else:
        pair, n = np.unique(keys, return_counts=True)
    return pair // buckets, pair % buckets, n
