"""Alignment of two tokenizations against plain pairs of byte ranges over the tokenizers' own files."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from crowdpeak.llm import alignment

ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nlines\r\n\n", "<|endoftext|> and </s> <unk> <s> <0x41>", "é è 日本語 👩‍👩‍👧 ́x", "▁ ▁▁", "a b　c﻿",
       "x" * 5000, " " * 700, "1234567890" * 30, "don't we'll I'D", "\x00\x01", "ﬁ Å ① ½", "we're " * 400, "▁<0x0A>\n"]


@pytest.fixture(scope="module")
def own_tokenizers():
    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")


def plain(text, tokenizers):
    """(a ids, b ids, groups, links) by comparing all tokens with all."""
    a, b = tokenizers
    if not text:
        return [], [], "", []
    sep = {chr(c): c for c in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    more = [c for c in range(256) if c not in sep.values()]
    sep |= {chr(0x100 + k): c for k, c in enumerate(more)}
    x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    u = [bytes(sep[c] for c in t) for t in x.tokens]
    v = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
    if not b"".join(u) == b"".join(v) == (" " + text).encode():
        return [], [], "", []
    ends = [np.cumsum([len(t) for t in side]).tolist() for side in (u, v)]
    starts = [[0, *e[:-1]] for e in ends]
    links = [(i, j) for i in range(len(u)) for j in range(len(v)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]] if len(u) * len(v) < 5e6 else None
    past = [{e: k + 1 for k, e in enumerate(side)} for side in ends]
    groups, i, j = [], 0, 0
    for c in sorted(set(ends[0]) & set(ends[1])):
        p, q = past[0][c], past[1][c]
        groups.append(",".join(map(str, x.ids[i:p])) + "|" + ",".join(map(str, y[j:q])))
        i, j = p, q
    return x.ids, y, ";".join(groups), links


def test_counts_and_groups_of_odd_and_given_texts(spark, own_tokenizers):
    rng = random.Random(11)
    given = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) < 1500 ORDER BY doc_id LIMIT 60").fetchall()]
    texts = ODD + given + [t[: rng.randrange(1, 200)] for t in given[:20]] + given[:3]
    rows = [(i if i % 7 else None, t, 5, "x") for i, t in enumerate(texts)]
    seen = [plain(t, own_tokenizers) for t in texts]
    held = Counter(p for a, b, _, links in seen for p in {(a[i], b[j]) for i, j in links})
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    want = []
    for (i, _, _, _), (a, b, groups, links) in zip(rows, seen):
        counts = [held[a[x], b[y]] for x, y in links]
        want.append((str(i), len(a), len(b), len(groups.split(";")) if groups else 0, len(links), sum(n == best[a[x]] for n, (x, _) in zip(counts, links)), sum(counts),
                     hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    table = spark.createDataFrame(rows, "doc_id long, text string, n_a int, slice string").repartition(3)
    for size in (alignment.SLICE_BYTES, 2000):
        got = alignment.link_counts(table, slice_bytes=size)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)


def test_lists_of_align(spark, own_tokenizers):
    texts = [t for t in ODD if t is None or len(t) < 1000]
    rows = alignment.align(spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, link_a string")).collect()
    for r in rows:
        a, b, groups, links = plain(r.text, own_tokenizers)
        assert (r.a_ids, r.b_ids, list(zip(r.link_a, r.link_b))) == (a, b, links), r.text
        cut = zip([0, *r.a_cuts], r.a_cuts, [0, *r.b_cuts], r.b_cuts)
        assert ";".join(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])) for i, p, j, q in cut) == groups


def test_byte_level_ids_are_those_of_the_file(own_tokenizers):
    made = alignment.byte_level(f"{alignment.FOLDER}/{alignment.A_FILE}")
    texts = [t or "" for t in ODD] + [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    assert made.encode(texts) == [e.ids for e in own_tokenizers[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_gallop_against_binary_search():
    rng = np.random.default_rng(4)
    for _ in range(30):
        ends = np.cumsum(rng.integers(1, 9, size=rng.integers(1, 300)))
        sought = rng.integers(1, ends[-1] + 1, size=50)
        want = np.searchsorted(ends, sought)
        at = np.array([rng.integers(0, w + 1) for w in want])
        assert alignment.gallop(sought, ends, at, np.full(50, len(ends))).tolist() == want.tolist()


def test_empty_table_and_table_without_tokens(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_counts(empty).count() == 0 and alignment.align(empty).count() == 0
    none = alignment.link_counts(spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")).collect()
    assert sorted(map(str, (tuple(r) for r in none))) == sorted(map(str, [(1, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]))


def test_long_texts(spark, own_tokenizers):
    text = "\n".join(f"line {i} of é{i * 7919 % 1009} " for i in range(3_000))
    a, b, groups, _ = plain(text, own_tokenizers)
    got = alignment.link_counts(spark.createDataFrame([(1, text), (2, " " * 300_000), (3, "ab" * 100_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (got[0].n_a, got[0].n_b, got[0].groups_sha256) == (len(a), len(b), hashlib.sha256(groups.encode()).hexdigest())
    assert len(got) == 3
