"""Personal data: patterns against the plain ones, the chain against enumeration and numeric gradients, held-out sentences."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdpeak.llm import pii
from crowdpeak.llm.queries import op12_shape_crf


@pytest.fixture(scope="module")
def model():
    return pii.train()


def plain(text):
    """The contract's patterns as they stand."""
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda t: re.sub("[^0-9]", "", t)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]


def test_patterns_on_given_and_random_texts():
    rng = random.Random(1)
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += ["".join(rng.choice("a@.1234 -+()é_%") for _ in range(rng.randrange(60))) for _ in range(20_000)]
    texts += ["a@b.c@d.e", "@b.c@d.e", "x@y.z_w@q.r", "a@b@c.d", "1.2.3.4.5.6.7.8", "000255.1.1.256 000255.0.0.1", "4111 1111 1111 1111-", "+1+2 345 67890", "x@y..z@a.b.", "４１１１"]
    assert sum(len(plain(t)) for t in texts) > 400
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000, "1 " * 150_000, "a." * 100_000 + "@"):
        pii.base_spans(t)


def test_words_that_are_alike_have_like_features():
    rng = random.Random(2)
    words = [pii._word(rng) for _ in range(5000)] + ["Tel.", "AT", "at,", "Éa", "ÉÀ", "中文", "A中", "ǅa", "a", "A.", "com.", "COM", "com,", "", ".", "mCx!", "mail?", "(at)", "dot;"]
    for w in words:
        assert pii.features(pii.alike(w)) == pii.features(w), w


def all_labellings(e, moves):
    for y in itertools.product(range(e.shape[1]), repeat=len(e)):
        yield y, sum(e[i, k] for i, k in enumerate(y)) + sum(moves[a, b] for a, b in zip((0, *y), (*y, 0)))


def test_viterbi_and_likelihood_against_all_labellings():
    rng = np.random.default_rng(5)
    e, moves, lengths = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3)), np.array([5, 1, 3])
    found = pii.viterbi(e, lengths, moves)
    gold = rng.integers(0, 3, size=(3, 5))
    want = 0.0
    for n, m in enumerate(lengths):
        scores = dict(all_labellings(e[n, :m], moves))
        assert tuple(found[n, :m]) == max(scores, key=scores.get) and not found[n, m:].any()
        want += scores[tuple(gold[n, :m])] - np.log(np.exp(list(scores.values())).sum())
    got, d, d_moves = pii.gradients(e, lengths, gold, moves)
    assert abs(got - want) < 1e-9
    for place in np.ndindex(e.shape):
        near = e.copy()
        near[place] += 1e-6
        assert abs((pii.gradients(near, lengths, gold, moves)[0] - got) / 1e-6 - d[place]) < 1e-4
    for place in np.ndindex(moves.shape):
        near = moves.copy()
        near[place] += 1e-6
        assert abs((pii.gradients(e, lengths, gold, near)[0] - got) / 1e-6 - d_moves[place]) < 1e-4


def test_decoding_of_texts_together_is_that_of_each_alone(model):
    texts = [" ".join(w) for w, _ in pii.labelled_rows(150, seed=5)] + ["", " \n", "word " * 3000 + "call (030) 123-4567 " + "word " * 500]
    both = pii.Tagger(model).label(texts)
    for t, y in zip(texts, both):
        assert y.tolist() == pii.Tagger(model).label([t])[0].tolist()
    assert both[-1].any()


def test_held_out_sentences(model):
    rows = pii.labelled_rows(1500, seed=77)
    found = pii.Tagger(model).label([" ".join(w) for w, _ in rows])
    wrong = sum(z.tolist() != y for (_, y), z in zip(rows, found))
    assert wrong <= 0.02 * len(rows)


def test_spans_beside_the_patterns(spark, model):
    texts = {1: "write to jane at mail dot org today", 2: "call (030) 123-4567, or +1 (663) 555-6869.", 3: "card 4111.1111.1111.1111 and 4111 1111 1111 1111",
             4: "she sat at home in 1984 with 4111111111111112", 5: None, 6: "", 7: "é" * 5 + " jim (at) host (dot) net", 8: "a@b.org +1 (269) 555-3296 4524132264652876 x"}
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, texts[1], "y"), (1, texts[1], "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = pii.find_personal_data(table, model).withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect()
    assert len(got) == len(rows) and {r.text for r in got} == set(texts.values())
    by_id = {r.doc_id: r for r in got}
    assert [(s.kind, s.text) for s in by_id[1].spans] == [("email", "jane at mail dot org")] and by_id[None].spans == by_id[1].spans
    assert [(s.kind, s.text) for s in by_id[2].spans] == [("phone", "(030) 123-4567"), ("phone", "+1 (663) 555-6869")]
    assert [s.text for s in by_id[2].base_spans] == ["+1 (663) 555-6869"]
    assert [(s.kind, s.text) for s in by_id[3].spans] == [("card", "4111.1111.1111.1111"), ("card", "4111 1111 1111 1111")]
    assert by_id[4].spans == by_id[5].spans == by_id[6].spans == []
    assert [(s.kind, s.text) for s in by_id[8].spans] == [("email", "a@b.org"), ("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")]
    for r in got:
        assert all(r.text[s.start : s.end] == s.text for s in r.spans)
        assert set(r.base_spans) <= set(r.spans)
    assert by_id[2].clean == "call [PHONE], or [PHONE]." and by_id[7].clean == "ééééé [EMAIL]" and by_id[5].clean is None and by_id[4].clean == texts[4]


def test_query(spark, tmp_path):
    texts = ["a@b.cd and 1.2.3.4", "nothing", None, "4111 1111 1111 1111 x y.z@q.rs"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op12_shape_crf(spark, str(tmp_path)).collect():
        want = sorted(plain(texts[r.doc_id] or ""))
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert (r.base_sha256, r.spans) == (hashlib.sha256(said.encode()).hexdigest(), said)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in want) for n in range(4)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(empty).count() == 0
