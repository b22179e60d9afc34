"""Language identification by a byte-level convolutional network.

Filters of several widths slide over the bytes of a window, each keeps its largest response (max
pooling), and a softmax layer turns the pooled responses into language probabilities. The network is
trained here, in numpy, on the ``lang`` labels of at most ``TRAIN_DOCS`` documents (those of the smallest
hashes of doc_id and text), on all of their windows; the epochs are as many as make about ``TRAIN_STEPS``
windows. A document is classified by all of its consecutive ``WINDOW``-byte windows; its probabilities are
the byte-weighted mean over them.

Inference looks up, for every pair of neighbouring bytes, the summed contribution of both filter taps,
so a width-4 filter costs two table rows a position.

Defined cases: a null or blank text has no language (lang null, confidence 0, accepted false); a null
doc_id is classified like any other and kept null; rows with a null lang are not trained on; without a
labelled row every lang is null; repeated rows are classified each, and of rows with equal doc_id and text
one is trained on; equal probabilities go to the language that sorts first; a very long text is classified
by all of its windows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.llm import textcore as tc

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
TRAIN_DOCS = 1200
TRAIN_STEPS = 40_000
MIN_CONFIDENCE = 0.5
BATCH = 128
RESULT = "doc_id long, lang string, confidence double, n_windows long, accepted boolean"


@dataclass
class Model:
    langs: list[str]
    taps: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def windows(data: np.ndarray, row_off: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with zero bytes, row of each, bytes in each) over whole rows."""
    n = np.diff(row_off)
    per = -(-n // size)
    row = np.repeat(np.arange(len(n)), per)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = row_off[:-1][row] + at * size
    held = np.minimum(size, row_off[1:][row] - start)
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, size)[start].copy() if len(start) else np.zeros((0, size), np.uint8)
    if len(out):
        out[np.arange(size)[None, :] >= held[:, None]] = 0
    return out, row, held


def sample_rows(rows: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """The ``limit`` different rows of the smallest hashes of ``columns``.

    A threshold on the hash, from the number of different rows, leaves little more than that many to sort,
    so no task and no driver sees more; equal rows are one, however many there are.
    """
    h = F.xxhash64(*columns)
    n = rows.select(F.approx_count_distinct(h)).first()[0]
    found = rows.select(*columns, h.alias("__hash"))
    if n > 1.2 * limit:
        found = found.where(F.shiftrightunsigned("__hash", 11) < int(2**53 * 1.2 * limit / n))
    return found.dropDuplicates(["__hash"]).orderBy("__hash").limit(limit).drop("__hash")


def _forward(model: Model, x: np.ndarray):
    pooled, arg = [], []
    for i, w in enumerate(WIDTHS):
        p = x.shape[1] - w + 1
        z = model.taps[w][0][x[:, :p]]
        for j in range(1, w):
            z = z + model.taps[w][j][x[:, j : j + p]]
        a = z.argmax(axis=1)
        arg.append(a)
        pooled.append(np.take_along_axis(z, a[:, None, :], 1)[:, 0])
    h = np.concatenate(pooled, 1) + model.bias
    return np.maximum(h, 0), arg


def train(texts: list[str], labels: list[str], seed: int = 7, epochs: int | None = None) -> Model | None:
    """Adam on mini-batches of windows; None without labels."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    if not langs:
        return None
    xs, ys = [], []
    for text, label in zip(texts, labels):
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw):
            x, _, _ = windows(raw, np.array([0, len(raw)]))
            xs.append(x)
            ys += [langs.index(label)] * len(x)
    m = Model(langs, {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    if not xs:
        return m
    x, y = np.concatenate(xs), np.array(ys)
    params = [*m.taps.values(), m.bias, m.dense, m.dense_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs or max(1, min(6, TRAIN_STEPS // len(x)))):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            b, t = x[order[lo : lo + 64]], y[order[lo : lo + 64]]
            h, arg = _forward(m, b)
            logit = h @ m.dense + m.dense_bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(t)), t] -= 1
            p /= len(t)
            back = (p @ m.dense.T) * (h > 0)
            grads = []
            rows, cols = np.arange(len(t))[:, None], np.arange(FILTERS)[None, :]
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(m.taps[w])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (b[rows, arg[i] + j], cols), part)
                grads.append(g)
            grads += [back.sum(0), h.T @ p, p.sum(0)]
            step += 1
            for k, (q, g) in enumerate(zip(params, grads)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                q -= (0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


class Scorer:
    """Window probabilities by lookups in byte-pair tables."""

    def __init__(self, model: Model):
        self.m = model
        t = model.taps
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        self.two = pair(t[2][0], t[2][1])
        self.three, self.three_last = pair(t[3][0], t[3][1]), t[3][2].astype(np.float32)
        self.four, self.four_last = pair(t[4][0], t[4][1]), pair(t[4][2], t[4][3])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        z2 = self.two.take(pairs, axis=0).max(axis=1)
        z = self.three.take(pairs[:, :-1], axis=0)
        z += self.three_last.take(x[:, 2:], axis=0)
        z3 = z.max(axis=1)
        z = self.four.take(pairs[:, :-2], axis=0)
        z += self.four_last.take(pairs[:, 2:], axis=0)
        h = np.maximum(np.concatenate([z2, z3, z.max(axis=1)], 1) + self.m.bias, 0)
        logit = h @ self.m.dense + self.m.dense_bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


_scorers: dict[bytes, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    key = model.dense.tobytes()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def classify(arr: pa.Array, model: Model | None) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """(language, confidence, number of windows) of each row of a text array."""
    n = len(arr)
    data, off = tc.flat(arr)
    blank = tc.SPACE[data].astype(np.int64).cumsum() if len(data) else np.zeros(0, np.int64)
    blank = np.concatenate([[0], blank])
    none = (blank[off[1:]] - blank[off[:-1]]) == np.diff(off)
    if model is None:
        return [None] * n, np.zeros(n), -(-np.diff(off) // WINDOW)
    x, row, held = windows(data, off)
    total = np.zeros((n, len(model.langs)))
    score = _scorer(model)
    for lo in range(0, len(x), BATCH):
        part = slice(lo, lo + BATCH)
        np.add.at(total, row[part], score(x[part]) * held[part, None])
    total /= np.maximum(1, np.diff(off))[:, None]
    best = total.argmax(1)
    conf = np.where(none, 0.0, total[np.arange(n), best]) if n else np.zeros(0)
    return [None if z else model.langs[b] for b, z in zip(best.tolist(), none.tolist())], conf, np.bincount(row, minlength=n)


def fit(docs: DataFrame, limit: int = TRAIN_DOCS) -> Model | None:
    rows = sample_rows(docs.where("lang is not null and text is not null"), ["doc_id", "text", "lang"], limit).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"], r["lang"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def _map(model: Model | None, threshold: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr = tc.text_array(batch.column("text"))
            docs = batch.column("doc_id")
            for lo, hi in tc.slices(arr):
                lang, conf, n = classify(arr[lo:hi], model)
                yield pa.RecordBatch.from_arrays(
                    [docs[lo:hi], pa.array(lang, pa.string()), pa.array(conf.astype(np.float64)), pa.array(n.astype(np.int64)), pa.array(conf >= threshold)],
                    names=["doc_id", "lang", "confidence", "n_windows", "accepted"],
                )

    return fn


def language_id(docs: DataFrame, model: Model | None = None, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, lang, confidence, n_windows, accepted) of every document."""
    model = model or fit(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_map(model, threshold), RESULT)


def _filter(model: Model | None, threshold: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr = tc.text_array(batch.column("text"))
            for lo, hi in tc.slices(arr):
                _, conf, _ = classify(arr[lo:hi], model)
                yield batch.slice(lo, hi - lo).filter(pa.array(conf >= threshold))

    return fn


def keep_identified(docs: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """``docs`` without those whose language the network can't tell; all columns stay as they are.

    Defined cases: null, empty and blank texts go, as their language can't be told, and so do unidentified
    texts; rows with a null doc_id are judged like any other; repeated rows are judged each; without a
    labelled row nothing can be told and every document stays; an empty table stays empty.
    """
    model = fit(docs)
    if model is None:
        return docs
    return tc.map_batches(docs, _filter(model, threshold))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(tc.documents(spark, sf_dir))
