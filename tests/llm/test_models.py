"""Trained operators on small tables, alignment against plain dynamic programming, and odd rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from crowdpeak.llm import decontamination, html_text, language, lm, toxicity


def test_toxic_words_are_learned_and_odd_texts_have_a_score(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(2, 5) for _ in range(30)) for _ in range(300)]
    labels = np.array([i % 4 == 0 for i in range(300)], dtype=float)
    texts = [t + " loser scum" if y else t for t, y in zip(texts, labels)]
    model = toxicity.fit([t.encode() for t in texts], labels)
    rows = [(1, "aaa bbb loser ccc", "x"), (2, "aaa bbb ccc", "x"), (3, None, "x"), (4, "", "x"), (5, "bbb " * 30_000 + "scum", "x")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()}
    assert got[1] > 0.5 > got[2] and got[5] > got[2]
    assert got[3] == got[4] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_training_from_tables_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    model, limits = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert limits == {"": 0.5}
    scored = toxicity.score(docs, model)
    assert scored.select(toxicity.rejected(F.col("score"), F.col("lang"), limits).alias("r")).first().r in (True, False)


def test_thresholds_by_language_from_all_rows_the_fit_did_not_use(spark):
    rng = random.Random(5)
    rows = [(i, "en" if i % 10 else "de", int(rng.random() < 0.3)) for i in range(3000)]
    made = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(8)) + (" loser" if y else ""), lang) for i, lang, y in rows]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    _, limits = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), sample=300)
    assert set(limits) == {"", "en", "de"}
    scores = [(lang, y, min(0.999, max(0.0, rng.gauss((0.55 if lang == "en" else 0.4) + 0.1 * y, 0.06)))) for _, lang, y in rows]
    scores += [(None, 1, 0.9), ("", 0, 0.1), ("fr", 1, 0.6)]
    limits = toxicity.thresholds(spark.createDataFrame(scores, "lang string, toxic int, score double"))
    f1 = lambda mine, cut: 2 * sum(y for _, y, s in mine if s >= cut) / (sum(s >= cut for _, _, s in mine) + sum(y for _, y, _ in mine))
    assert set(limits) == {"", "en", "de"}
    for name in limits:
        mine = [x for x in scores if not name or x[0] == name]
        assert f1(mine, limits[name]) > max(f1(mine, c / 1000) for c in range(300, 701)) - 0.005


def test_languages(spark):
    rng = random.Random(2)
    words = {"en": ["the", "and", "with", "that"], "de": ["der", "und", "nicht", "für"], "fr": ["être", "que", "où", "dans"]}
    made = [(" ".join(rng.choice(words[k]) for _ in range(40)), k) for k in words for _ in range(40)]
    net = language.fit([t.encode() for t, _ in made], [k for _, k in made], steps=120)
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(60)), k) for i, k in enumerate(list(words) * 5)]
    rows += [(100, None, None), (101, "", None), (102, "12 + 3 = !?", None), (103, "the and " * 20_000, None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), net).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows[:15]) >= 14
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_alignment(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_scores():
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 6, size=n) for n in (1, 5, 12, 20)] * 5
    passages = [rng.integers(-1, 6, size=rng.integers(1, 40)) for _ in items]
    got, first, last = decontamination.smith_waterman(items, passages)
    assert got.tolist() == [plain_alignment(a.tolist(), b.tolist()) for a, b in zip(items, passages)]
    assert all(f <= e for f, e, s in zip(first, last, got) if s)


def test_leaks_whole_edited_and_none(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(30)]
    fill = lambda n: [word() for _ in range(n)]
    edited = [w if i % 6 else "changed" for i, w in enumerate(item)]
    docs = [(1, " ".join(fill(50) + item + fill(20))), (2, " ".join(fill(5) + edited + fill(5))), (3, " ".join(fill(300))), (4, None), (5, ""),
            (None, " ".join(item).upper()), (6, " ".join(fill(9) + item[:4] + fill(9)))]
    benchmark = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, "two words"), (12, "")], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("own"))
    got = {r.doc_id: r for r in decontamination.find_leaks(table, benchmark).collect()}
    assert set(got) == {1, 2, None} and all(r.item_id == 9 for r in got.values())
    assert (got[1].score, got[1].first_word, got[1].last_word) == (1.0, 50, 79) and 0.5 < got[2].score < 1
    assert decontamination.find_leaks(table, benchmark.where("item_id = 0")).count() == 0
    assert decontamination.find_leaks(table.where("doc_id = -1"), benchmark).count() == 0


def test_long_passages_of_long_items_and_short_items_whole(spark):
    rng = random.Random(16)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    long, five = fill(300), fill(5)
    broken = [w for k in range(0, 90, 30) for w in long[k : k + 14] + fill(12)]  # runs of 14 words in a loose alignment
    docs = [(1, long[40:140]), (2, long[200:213]), (3, long[200:212]), (4, five[:3]), (5, five), (6, ["two", "words"]), (7, ["words", "two"]), (8, broken)]
    docs = [(i, " ".join(fill(30) + x + fill(30))) for i, x in docs] + [(100 + i, " ".join(fill(3) + long[200:213] + fill(3))) for i in range(40)]
    benchmark = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(five)), (3, "Two words.")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 2), (6, 3), (8, 1), *((100 + i, 1) for i in range(40))}
    assert (got[1, 1].first_word, got[1, 1].last_word, got[5, 2].score, got[6, 3].first_word) == (30, 129, 1.0, 30)


def test_leaks_of_very_unequal_items_equal_those_of_each_item_alone(spark):
    rng = random.Random(17)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    items = [fill(n) for n in (9, 16, 16, 60, 400, 3000)]
    edit = lambda x: [w if rng.random() > 0.12 else "changed" for w in x]
    docs = [(k, " ".join(fill(20) + edit(x) + fill(20)), f"tag{k}") for k, x in enumerate(items)]
    docs += [(100, " ".join(w for x in items for w in edit(x)), "all"), (None, " ".join(items[0]), "none"), (7, None, "null"), (8, " ".join(fill(500)), "clean")]
    table = spark.createDataFrame(docs, "doc_id long, text string, score string")
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows = decontamination.find_leaks(table, benchmark, carry="score").collect()
    alone = [tuple(r) for k in range(len(items)) for r in decontamination.find_leaks(table, benchmark.where(f"item_id = {k}"), carry="score").collect()]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, alone))
    assert {(r[0], r[1], r[5]) for r in rows} >= {(k, k, f"tag{k}") for k in range(6)} | {(100, k, "all") for k in range(6)} | {(None, 0, "none")}
    assert not {r[0] for r in rows} & {7, 8}


def test_batches_of_windows_are_alike_and_bounded():
    rng = random.Random(18)
    lengths = np.array([rng.choice([3, 16, 60, 400, 20_000]) for _ in range(40)])
    windows = [[0, t, 5, 5 + rng.choice([4, 30, 200, 90_000])] for t in range(40) for _ in range(30)]
    batches = list(decontamination.alike(windows, lengths))
    assert sorted(w for b in batches for w in b) == sorted(windows)
    for b in batches:
        wide, tall = [w[3] - w[2] for w in b], [lengths[w[1]] for w in b]
        assert max(wide) <= 2 * min(wide) and max(tall) <= 2 * min(tall)
        assert len(b) == 1 or len(b) * max(wide) <= decontamination.CELLS


def test_cross_entropy_difference_against_plain_counts(spark):
    texts = {1: "a b a b c", 2: "a b c c", 3: "d d d a", 4: None, 5: " ", 6: "a B a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm.score_documents(docs, labels).collect()}
    words = sorted(w for w in "abcd" if sum(w in (t or "").lower().split() for t in texts.values()) >= 2)
    numbers = lm.Numbers({w.encode(): lm.UNKNOWN + k for k, w in enumerate(words)})
    models = []
    for ids in ([1, 2], list(texts)):
        ones, cells = np.zeros(numbers.size, dtype=int), np.zeros(1 << lm.CELL_BITS, dtype=int)
        for i in ids:
            x = numbers((texts[i] or "").encode())
            if len(x):
                np.add.at(ones, x, 1)
                np.add.at(cells, numbers.cells(x), 1)
        models.append(lm.Model(ones, cells, len(ids)))
    for i, t in texts.items():
        x = numbers((t or "").encode())
        want = [float(m.losses(x, numbers.cells(x)).mean()) if len(x) else 0.0 for m in models]
        assert got[i].n_tokens == len(x) and np.allclose((got[i].target_loss, got[i].background_loss, got[i].score), (*want, want[0] - want[1]))
    assert got[1].score < got[3].score


def test_cross_entropy_difference_counts_every_word_and_bigram(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["the", "of", "and", "in"], k=4) + [f"pair{i % 3000}", f"next{i % 3000}"] + (["ODD7"] if i == 5 else [])) for i in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 6000, 5)], "doc_id long, quality int")
    seen, n, t, n2, t2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for x in texts:
        seen.update(set(x.lower().split()))
    known = {w for w, k in seen.items() if k > 1}
    read = lambda x: [w if w in known else f"<{lm._kind(w.encode())}>" for w in x.lower().split()]
    for i, x in enumerate(texts):
        for one, two in ((n, n2), (t, t2)) if i % 5 == 0 else ((n, n2),):
            one.update(read(x))
            two.update(zip(["<0>", *read(x)], read(x)))

    def loss(x, one, two, rows):
        p = lambda w: (one[w] + lm.FLOOR) / (one.total() + lm.FLOOR * (lm.UNKNOWN + len(known)))
        return np.mean([-np.log((two[a, b] + lm.BACKOFF * p(b)) / ((rows if a == "<0>" else one[a]) + lm.BACKOFF)) for a, b in zip(["<0>", *read(x)], read(x))])

    got = {r.doc_id: r for r in lm.score_documents(docs, labels, slice_bytes=20_000).collect()}
    assert len(known) == 6004 and len(got) == 6000
    for i in (0, 5, 6, 2999, 5999):
        assert np.allclose((got[i].target_loss, got[i].background_loss), (loss(texts[i], t, t2, 1200), loss(texts[i], n, n2, 6000)))


def test_slices_send_few_bytes_a_key_and_get_exact_sums():
    """Disk of op3: a key with its counts and the answer take fewer bytes than the key as a number, and no row of their own."""
    rng = np.random.default_rng(1)
    common = rng.integers(lm.UNKNOWN, 1 << 62, 20_000)
    sent, want = [], Counter()
    for number in range(3):
        key = np.concatenate((rng.permutation(common)[:15_000], rng.integers(lm.UNKNOWN, 1 << 62, 10_000), [1, lm.TOKENS, lm.ONLY_HERE]))
        n = rng.integers(1, 4, len(key))
        sent.append((number, key, n, n // 2))
        want.update(dict(zip(key.tolist(), n.tolist())))
    edges = lm._edges(3)
    asked = pa.Table.from_batches([b for x in sent for b in lm._asked(*x, edges)])
    answers = pa.concat_tables([lm._answered(asked.filter(pc.equal(asked["part"], k))) for k in range(3)])
    keys = sum(len(x[1]) for x in sent)
    assert sum(len(b.as_py()) for b in asked["sums"]) < 7.5 * keys and sum(len(b.as_py()) for b in answers["sums"]) < 1.5 * keys
    assert asked.num_rows == 9 and pc.sum(answers["shared"]).as_py() == sum(c > 1 for c in Counter(k for x in sent for k in x[1].tolist()).values())
    for number, key, n, t in sent:
        mine = answers.filter(pc.equal(answers["slice"], number))
        got, _ = lm._whole(key, mine["part"], mine["sums"])
        assert got.tolist() == [want[k] for k in key.tolist()]


def test_main_text_of_odd_pages(spark):
    long = [f"Sentence number {i} of a page, which has some words and ends here." for i in range(40)]
    rows = []
    for page, gold in html_text.labelled_pages(long, ["Home", "About us", "Next"], count=400):
        found = html_text.blocks(page)
        if [t for t, _, _ in found] == [" ".join(t.split()) for t, _ in gold]:
            rows.append(([f for _, f, _ in found], [y for _, y in gold]))
    assert len(rows) > 350
    chain = html_text.Chain().fit(rows)
    page = ('<html><head><title>no</title><script>var a="<p>no</p>";</script></head><body><nav><a href="/">Home</a></nav><article><h1>A&amp;B title</h1>'
            "<p>First  part,\nwhich goes on.<p><b>Second &lt;part&gt;, which ends.</b></p><div class=\"ad\">Buy it</div></article>"
            '<section class="comments"><p>I do not agree, says a reader.</p></section><footer>© 2020</footer>')
    pages = [(1, page), (2, None), (3, ""), (4, "<<<>>> </p></div>"), (5, "<article>" + "<p>Long text, again.</p>" * 20_000)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, html string").withColumn("text", F.lit(0)), chain).collect()}
    assert got[1] == "A&B title\nFirst part, which goes on.\nSecond <part>, which ends."
    assert got[2] == got[3] == "" and got[5].count("\n") == 19_999


def test_conflicting_labels_and_scores_of_every_row(spark):
    docs = spark.createDataFrame([(i, "bad words here" if i % 2 else "good words there", "en") for i in range(60)] + [(None, "bad", None), (3, None, "de")],
                                 "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 1), (None, 1), (5, 7)], "doc_id long, toxic int")
    key = lambda df: sorted((str(r.doc_id), str(r.lang), r.score) for r in df.collect())
    model, limits, scores = toxicity.train_and_score(docs, labels)
    again = toxicity.train_and_score(docs.repartition(7), labels.repartition(5))
    for a, b in zip(key(scores), key(again[2])):  # no text's score depends on the texts beside it
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6
    assert set(limits) >= {""}
    assert key(scores) == key(toxicity.score(docs, model)) and scores.count() == 62
