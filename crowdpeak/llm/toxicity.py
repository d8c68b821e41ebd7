"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of hashed vectors of itself and of its leading bytes. Filters of several widths slide over the words;
each filter keeps its maximum over the whole text, so that one phrase is enough and length does not matter; a logistic
layer makes the score. Thresholds of the decision are calibrated for each language on rows kept out of the training.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdpeak.llm.store import settle
from crowdpeak.llm.text import Memo, slices, split_all, utf8

#: Hash rows, their length, filters of each width, widths, and the leading bytes that are features of a word.
ROWS, DIM, FILTERS, WIDTHS, LEADS = 1 << 15, 12, 12, (1, 2, 3), (3, 4, 5, 6)
#: Bound on the labelled rows that the fit reads, in one task (in the mean; chosen by a hash of doc_id).
SAMPLE = 8_000
EPOCHS, BATCH, RATE = 4, 64, 0.02
#: Steps of a fit at least; few rows are gone over more often.
LEAST_STEPS = 500
#: Calibrated thresholds stay between these.
LOWEST, HIGHEST = 0.3, 0.7
#: Equal parts of the scores in which rows are counted for thresholds.
BINS = 10_000
#: Words whose projections a task remembers.
REMEMBERED = 100_000


def features(word: bytes) -> list[int]:
    out = [xxhash.xxh3_64_intdigest(b"w" + word) % ROWS]
    for n in LEADS:
        out.append(xxhash.xxh3_64_intdigest(b"%d" % n + word[:n]) % ROWS if len(word) >= n else 0)
    return out


class Model:
    """Weights: table (ROWS, DIM), for each width filters (width, DIM, FILTERS), their bias, and the logistic layer."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((ROWS, DIM)) * 0.1).astype(np.float32)
        self.table[0] = 0
        self.filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.start = np.float32(-1.0)

    def projections(self, feats: np.ndarray) -> np.ndarray:
        """(words, sum of widths * FILTERS): what each word adds to each filter at each place of it."""
        u = self.table[feats].sum(axis=1)
        return np.concatenate([u @ f[j] for f in self.filters for j in range(len(f))], axis=1)


def _responses(places: np.ndarray, starts: np.ndarray, per_word: np.ndarray, bias: np.ndarray):
    """Filter responses at every place, one (places, FILTERS) array a width. Word 0 is the gap behind each text."""
    col = 0
    for k, w in enumerate(WIDTHS):
        y = per_word[places, col : col + FILTERS].copy()
        for j in range(1, w):
            col += FILTERS
            y[:-j] += per_word[places[j:], col : col + FILTERS]
        for j in range(1, w):
            y[starts[1:] - j] = 0  # places of a gap from which the filter would see the next text
        col += FILTERS
        yield k, y + bias[k]


def _spread(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts with a gap (word 0) as wide as the widest filter behind each, and where each text begins."""
    gap = max(WIDTHS)
    n = len(at) - 1
    starts = at[:-1] + gap * np.arange(n)
    places = np.zeros(int(at[-1]) + gap * n, dtype=np.int64)
    places[np.arange(int(at[-1])) + gap * np.repeat(np.arange(n), np.diff(at))] = words
    return places, starts


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> Model:
    """Adam on the logistic loss. Gradients flow through the place of each filter's maximum only."""
    model, rng = Model(seed), np.random.default_rng(seed)
    memo: dict[bytes, int] = {b"": 0}
    docs = []
    for b in texts:
        words, _ = split_all([b])
        docs.append(np.array([memo.setdefault(w, len(memo)) for w in words], dtype=np.int64))
    feats = np.zeros((len(memo), 1 + len(LEADS)), dtype=np.int64)
    for w, i in memo.items():
        if i:
            feats[i] = features(w)
    y = labels.astype(np.float32)
    params = {"table": model.table, "bias": model.bias, "out": model.out, **{f"f{k}": f for k, f in enumerate(model.filters)}}
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v2 = {k: np.zeros_like(v) for k, v in params.items()}
    step, start_m, start_v = 0, 0.0, 0.0
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(docs) // BATCH))) if docs else 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for cut in range(0, len(order), BATCH):
            pick = order[cut : cut + BATCH]
            at = np.concatenate(([0], np.cumsum([len(docs[i]) for i in pick])))
            joined = np.concatenate([docs[i] for i in pick]) if at[-1] else np.zeros(0, dtype=np.int64)
            uniq, inv = np.unique(np.concatenate(([0], joined)), return_inverse=True)
            places, starts = _spread(inv[1:], at)
            u = model.table[feats[uniq]].sum(axis=1)
            u[0] = 0
            per_word = np.concatenate([u @ f[j] for f in model.filters for j in range(len(f))], axis=1)
            ends = np.append(starts[1:], len(places))
            pooled, where = [], []
            for k, r in _responses(places, starts, per_word, model.bias):
                best = np.stack([a + r[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
                where.append(best)
                pooled.append(np.take_along_axis(r, best, axis=0))
            h = np.concatenate(pooled, axis=1)
            hot = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-(hot @ model.out + model.start)))
            g = (p - y[pick]) / len(pick)
            grads = {"out": hot.T @ g + 1e-4 * model.out, "bias": np.zeros_like(model.bias), "table": None}
            d_h = (g[:, None] * model.out[None, :]) * (h > 0)
            d_u = np.zeros_like(u)
            for k, w in enumerate(WIDTHS):
                d = d_h[:, k * FILTERS : (k + 1) * FILTERS]
                grads["bias"][k] = d.sum(axis=0)
                d_f = np.zeros_like(model.filters[k])
                for j in range(w):
                    spot = np.minimum(where[k] + j, len(places) - 1)
                    word = places[spot]
                    d_f[j] = np.einsum("df,dfe->ef", d, u[word])
                    np.add.at(d_u, word.ravel(), (d[:, :, None] * model.filters[k][j].T[None, :, :]).reshape(-1, DIM))
                grads[f"f{k}"] = d_f
            d_u[0] = 0
            used = np.flatnonzero(np.abs(d_u).sum(axis=1))
            rows, back = np.unique(feats[uniq[used]], return_inverse=True)
            d_rows = np.zeros((len(rows), DIM), dtype=np.float32)
            np.add.at(d_rows, back.reshape(-1), np.repeat(d_u[used], feats.shape[1], axis=0))
            step += 1
            rate = RATE * (0.3 if epoch >= epochs - 2 else 1.0)
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, grad in grads.items():
                at_rows = rows if name == "table" else slice(None)
                grad = d_rows if name == "table" else grad
                m[name][at_rows] = 0.9 * m[name][at_rows] + 0.1 * grad
                v2[name][at_rows] = 0.999 * v2[name][at_rows] + 0.001 * grad * grad
                params[name][at_rows] -= (scale * m[name][at_rows] / (np.sqrt(v2[name][at_rows]) + 1e-7)).astype(np.float32)
            start_m, start_v = 0.9 * start_m + 0.1 * g.sum(), 0.999 * start_v + 0.001 * g.sum() ** 2
            model.start -= np.float32(scale * start_m / (np.sqrt(start_v) + 1e-7))
            model.table[0] = 0
    return model


class Scorer:
    """Scores of texts, with the projections of words remembered between calls."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.memo, self.fresh, self.per_word = Memo(self._new, 1 << 62), [], np.zeros((1, sum(WIDTHS) * FILTERS), dtype=np.float32)

    def _new(self, word: bytes) -> int:
        self.fresh.append(word)
        return len(self.per_word) + len(self.fresh) - 1

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if len(self.memo) > REMEMBERED:
            self._forget()
        words, at = split_all(texts)
        idx = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
        if self.fresh:
            self.per_word = np.concatenate((self.per_word, self.model.projections(np.array([features(w) for w in self.fresh]))))
            self.fresh = []
        places, starts = _spread(idx, at)
        z = np.full(len(texts), self.model.start, dtype=np.float64)
        for k, r in _responses(places, starts, self.per_word, self.model.bias):
            z += np.maximum(np.maximum.reduceat(r, starts, axis=0), 0) @ self.model.out[k * FILTERS : (k + 1) * FILTERS]
        return 1 / (1 + np.exp(-z))


def thresholds(scored: DataFrame, least: int = 20) -> dict[str, float]:
    """For each language the score at which F1 on the rows (lang, toxic, score) is best; "" holds that of all rows.

    Counted in a histogram of BINS scores by language; a row for each language comes to the driver. A language with
    fewer than `least` rows of either label has no entry and goes by that of all rows."""
    bins = scored.groupBy("lang", F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("toxic").alias("y"), F.min("score").alias("low"), F.max("score").alias("high"))
    every = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.min("low").alias("low"), F.max("high").alias("high"))
    bins = bins.where("lang <> ''").unionByName(every.withColumn("lang", F.lit("")))
    of_lang, down = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("bin"))
    toxic, upto = F.sum("y").over(of_lang), down.rowsBetween(Window.unboundedPreceding, 0)
    cut = bins.select("lang", "n", "y", "bin", (2 * F.sum("y").over(upto) / (F.sum("n").over(upto) + F.greatest(F.lit(1), toxic))).alias("f1"),
                      ((F.col("low") + F.coalesce(F.lead("high").over(down), F.lit(0.0))) / 2).alias("cut"))
    best = cut.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.max(F.struct("f1", "bin", "cut"))["cut"].alias("cut")).collect()
    out = {r.lang: min(HIGHEST, max(LOWEST, r.cut)) for r in best if (r.y > 0 if r.lang == "" else min(r.y, r.n - r.y) >= least)}
    return {"": 0.5} | out


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)).cast("int")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, dict[str, float]]:
    """The model and the thresholds, from labelled rows of `docs` outside fold 2; see train_and_score."""
    return train_and_score(docs, labels, sample)[:2]


def train_and_score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, dict[str, float], DataFrame]:
    """The model, the thresholds, and (doc_id, lang, score) of every row of `docs`.

    Labelled rows outside fold 2 are learned from. At most about `sample` of them, chosen by a hash of doc_id, go to the one
    task that fits, less one in ten; the thresholds come from all the others. Texts are not shuffled: the ids that are
    fitted on are a table of at most about `sample` rows, which is broadcast, and every row is scored in its own task before
    its score, without the text, meets its label. The driver sees those ids, the model and one threshold a language. Labels
    other than 0 and 1 and null ids do not count; of several labels of an id the highest does; without labelled rows the
    model is the untrained one."""
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    fits = ((F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
            & (F.pmod(F.xxhash64(F.lit("kept"), "doc_id"), F.lit(10)) != 0))
    chosen = known.where(fits)
    texts = docs.select("doc_id", "text", "lang")
    rows = texts.join(F.broadcast(spark.createDataFrame(chosen.collect(), chosen.schema)), "doc_id").select("doc_id", "text", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.record_batch({"model": pa.array([pickle.dumps(_learned(pa.Table.from_batches(held)))], pa.binary())})

    got = rows.repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(learn, "model binary").collect()
    model = pickle.loads(got[0]["model"]) if got else Model()
    scores = settle(score(texts, model).select("doc_id", "lang", "score"))
    return model, thresholds(scores.join(known.where(~fits), "doc_id").select("lang", "toxic", "score")), scores


def _learned(rows: pa.Table) -> Model:
    return fit([(t or "").encode() for t in rows.column("text").to_pylist()], rows.column("toxic").to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a column `name`, the score of each whole text. Null and empty texts have the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever the input
    schema = docs.drop(name).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                s = scorer(utf8(part.column(part.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, name])

    return docs.drop(name).mapInArrow(run, schema)


def rejected(score_: Column, lang: Column, limits: dict[str, float]) -> Column:
    """True where the score reaches the threshold of the language; an unknown or null language goes by that of all."""
    table = F.from_json(F.lit(json.dumps(limits)), "map<string,double>")
    return score_ >= F.coalesce(F.element_at(table, F.coalesce(lang, F.lit(""))), F.lit(limits[""]))
