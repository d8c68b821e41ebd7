"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

A text is cut into runs of RUN bytes. In each run a network reads forward, another backward; both states label every
position, and the labels' probabilities over all positions of the text give those of the document. Gates are clipped
lines rather than logistic curves, which cost more than all else together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdpeak.llm.text import slices, utf8
from crowdpeak.llm.toxicity import fold

#: Bytes of a run, size of a state, runs worked on at once.
RUN, HIDDEN, WIDE = 96, 8, 4096
#: Bounds of the fit: documents read (in the mean; chosen by a hash of doc_id), runs drawn from each, and steps.
SAMPLE, RUNS_EACH, STEPS, BATCH, RATE = 4_000, 8, 400, 192, 0.02
LETTER = re.compile(r"[^\W\d_]")


def _gate(x: np.ndarray) -> np.ndarray:
    """0 at -2, 1 at 2, a line between; in place."""
    np.multiply(x, 0.25, out=x)
    np.add(x, 0.5, out=x)
    return np.clip(x, 0, 1, out=x)


class Cell:
    """One direction: z, r = gates, c = tanh(in + r * state), h' = h + z * (c - h). Rows: z, r, c, HIDDEN each."""

    def __init__(self, rng: np.random.Generator):
        self.w = (rng.standard_normal((3 * HIDDEN, 256)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((3 * HIDDEN, HIDDEN)) * 0.3).astype(np.float32)
        self.b = np.zeros((3 * HIDDEN, 1), dtype=np.float32)
        self.b[:HIDDEN] = -1.0

    def states(self, runs: np.ndarray) -> np.ndarray:
        """(RUN, HIDDEN, n) from bytes (RUN, n)."""
        n, out = runs.shape[1], np.empty((len(runs), HIDDEN, runs.shape[1]), dtype=np.float32)
        h, table = np.zeros((HIDDEN, n), dtype=np.float32), self.w + self.b
        x, s = np.empty((3 * HIDDEN, n), dtype=np.float32), np.empty((3 * HIDDEN, n), dtype=np.float32)
        for t in range(len(runs)):
            np.take(table, runs[t], axis=1, out=x, mode="clip")
            np.matmul(self.u, h, out=s)
            gates = x[: 2 * HIDDEN]
            gates += s[: 2 * HIDDEN]
            _gate(gates)
            c = s[2 * HIDDEN :]
            c *= gates[HIDDEN:]
            c += x[2 * HIDDEN :]
            np.tanh(c, out=c)
            c -= h
            c *= gates[:HIDDEN]
            h = np.add(h, c, out=out[t])
        return out

    def gradients(self, runs: np.ndarray, states: np.ndarray, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Back through time: gradients of w, u, b from those of every state."""
        d_w, d_u, d_b = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        carry = np.zeros_like(states[0])
        n = runs.shape[1]
        one_hot_rows = np.arange(n)
        for t in range(len(runs) - 1, -1, -1):
            before = states[t - 1] if t else np.zeros_like(carry)
            s = self.u @ before
            x = self.w[:, runs[t]] + self.b
            line = x[: 2 * HIDDEN] + s[: 2 * HIDDEN]
            g = np.clip(0.25 * line + 0.5, 0, 1)
            z, r = g[:HIDDEN], g[HIDDEN:]
            c = np.tanh(x[2 * HIDDEN :] + r * s[2 * HIDDEN :])
            d_h = d_out[t] + carry
            d_c = d_h * z * (1 - c * c)
            slope = 0.25 * ((line > -2) & (line < 2))
            d_x = np.concatenate((d_h * (c - before) * slope[:HIDDEN], d_c * s[2 * HIDDEN :] * slope[HIDDEN:], d_c))
            d_s = d_x.copy()
            d_s[2 * HIDDEN :] *= r
            d_u += d_s @ before.T
            d_b += d_x.sum(axis=1, keepdims=True)
            hot = np.zeros((n, 256), dtype=np.float32)
            hot[one_hot_rows, runs[t]] = 1
            d_w += d_x @ hot
            carry = d_h * (1 - z) + self.u.T @ d_s
        return {"w": d_w, "u": d_u, "b": d_b}


class Model:
    def __init__(self, labels: list[str], seed: int = 10):
        rng = np.random.default_rng(seed)
        self.labels, self.ahead, self.back = labels, Cell(rng), Cell(rng)
        self.out = (rng.standard_normal((len(labels), 2 * HIDDEN)) * 0.3).astype(np.float32)
        self.start = np.zeros((len(labels), 1), dtype=np.float32)

    def positions(self, runs: np.ndarray) -> np.ndarray:
        """(RUN, labels, n): label probabilities at every position of runs (RUN, n)."""
        a, b = self.ahead.states(runs), self.back.states(runs[::-1])[::-1]
        out = np.empty((len(runs), len(self.labels), runs.shape[1]), dtype=np.float32)
        left, right = np.ascontiguousarray(self.out[:, :HIDDEN]), np.ascontiguousarray(self.out[:, HIDDEN:])
        for t in range(len(runs)):
            y = np.matmul(left, a[t], out=out[t])
            y += right @ b[t]
            y += self.start
            y -= y.max(axis=0)
            np.exp(y, out=y)
            y /= y.sum(axis=0)
        return out

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(texts, labels): mean probabilities over all positions of each text; zeros for an empty text."""
        n_runs = np.array([-(-len(b) // RUN) for b in texts], dtype=np.int64)
        padded = np.zeros(int(n_runs.sum()) * RUN, dtype=np.uint8)
        at = 0
        for b, n in zip(texts, n_runs):
            padded[at : at + len(b)] = np.frombuffer(b, dtype=np.uint8)
            at += int(n) * RUN
        runs = padded.reshape(-1, RUN)
        real = np.full(len(runs), RUN)
        last = np.cumsum(n_runs) - 1
        some = n_runs > 0
        lengths = np.array([len(b) for b in texts])
        real[last[some]] = lengths[some] - (n_runs[some] - 1) * RUN
        sums = np.empty((len(runs), len(self.labels)))
        for cut in range(0, len(runs), WIDE):
            p = self.positions(np.ascontiguousarray(runs[cut : cut + WIDE].T))
            inside = np.arange(RUN)[:, None] < real[None, cut : cut + WIDE]
            sums[cut : cut + WIDE] = np.einsum("tcn,tn->nc", p, inside.astype(np.float32))
        out = np.zeros((len(texts), len(self.labels)))
        np.add.at(out, np.repeat(np.arange(len(texts)), n_runs), sums)
        return out / np.maximum(1, lengths)[:, None]


def fit(texts: list[bytes], langs: list[str], steps: int = STEPS, seed: int = 10) -> Model:
    """Adam on the cross-entropy of every position, each with its document's label; languages are drawn evenly."""
    labels = sorted(set(langs))
    model, rng = Model(labels, seed), np.random.default_rng(seed)
    runs, of = [], []
    for b, name in zip(texts, langs):
        cuts = rng.integers(0, max(1, len(b) - RUN + 1), size=min(RUNS_EACH, 1 + len(b) // RUN))
        for c in cuts:
            piece = np.frombuffer(b[c : c + RUN], dtype=np.uint8)
            if len(piece):
                runs.append(np.resize(piece, RUN))  # a short text is repeated
                of.append(labels.index(name))
    if not runs:
        return model
    runs, of = np.stack(runs), np.array(of)
    by = [np.flatnonzero(of == k) for k in range(len(labels)) if (of == k).any()]
    params = {"out": model.out, "start": model.start, **{f"{d}{k}": getattr(c, k) for d, c in (("a", model.ahead), ("b", model.back)) for k in "wub"}}
    m, v = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(ids, size=-(-BATCH // len(by))) for ids in by])
        x = np.ascontiguousarray(runs[pick].T)
        a, b = model.ahead.states(x), model.back.states(np.ascontiguousarray(x[::-1]))
        h = np.concatenate((a, b[::-1]), axis=1)
        y = model.out @ h + model.start
        y -= y.max(axis=1, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=1, keepdims=True)
        p[:, of[pick], np.arange(len(pick))] -= 1
        p /= p.shape[0] * p.shape[2]
        grads = {"out": np.einsum("tcn,thn->ch", p, h), "start": p.sum(axis=(0, 2))[:, None]}
        d_h = model.out.T @ p
        for d, cell, xs, states, back in (("a", model.ahead, x, a, d_h[:, :HIDDEN]), ("b", model.back, x[::-1], b, d_h[::-1, HIDDEN:])):
            grads |= {f"{d}{k}": g for k, g in cell.gradients(xs, states, back).items()}
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * (1 if step < steps * 0.7 else 0.25) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for name, g in grads.items():
            g = g / max(1.0, norm)
            m[name] = 0.9 * m[name] + 0.1 * g
            v[name] = 0.999 * v[name] + 0.001 * g * g
            params[name] -= (rate * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The network, from rows of (doc_id, text, lang) with a language and outside fold 2.

    About `sample` rows at most are read to the driver, chosen by a hash of doc_id and text."""
    known = docs.where("lang is not null and text is not null").where(fold(F.col("doc_id")) != 2)
    share = min(1.0, sample / max(1, known.count()))
    rows = known.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id", "lang"), F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    rows = rows.select("text", "lang").orderBy("text", "lang").toPandas()
    return fit([t.encode() for t in rows["text"]], rows["lang"].tolist())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (mean probability of that label over all positions of the whole text).

    A null text, an empty one and one without a letter are `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever the input
    base = docs.drop("lang_pred", "score")
    schema = docs.drop("lang_pred", "score").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in slices(batch, text, 3 << 20):
                texts = utf8(part.column(part.schema.get_field_index(text)))
                p = net.documents(texts)
                best = p.argmax(axis=1) if net.labels else np.zeros(len(texts), dtype=int)
                lettered = [bool(net.labels) and LETTER.search(b.decode("utf-8", "replace")) is not None for b in texts]
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array([net.labels[k] if ok else "und" for k, ok in zip(best, lettered)], pa.string()),
                    pa.array([min(1.0, float(p[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, lettered))], pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)
