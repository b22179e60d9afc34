"""Quality classifier: random-indexing word vectors, pooled, and a calibrated two-layer network.

*Word vectors.* Every word bucket has a sparse random index vector; a word's vector is its own index
vector plus the normalised sum of the index vectors of its neighbours in the training texts. Words that
the training texts hardly hold share the vector of their shape (length and character classes).
*Pooling.* A document is the mean vector of its tokens (words and runs of punctuation), joined with the
sum, over the tokens whose training frequency differs by label, of their vectors weighted by that
difference, and by its length. *Network.* One hidden layer and two outputs: good quality, and toxic.
Each output is calibrated with a temperature fitted on a part of the sample that training leaves out.

Vectors and network are fitted on at most ``TRAIN_DOCS`` labelled documents, those whose labels and then
texts have the smallest hashes.
Every document is then scored over its whole text.

Defined cases: a null or blank text scores 0 for both and is not kept; a null doc_id is kept null;
labels without a document, or null labels, are not trained on; equal label rows count once, and different
labels of a document each; of rows with equal doc_id and text one is trained on, and each is scored; a very
long text is scored whole; a probability equal to the threshold is on its upper side; without labels both
scores are null and keep is true; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.llm import textcore as tc
from millstone.llm.language_id import sample_rows
from millstone.llm.secret_scan import Tokens, _CLASS

TRAIN_DOCS = 3000
DIM = 48
NONZERO = 6
BUCKETS = 1 << 16
SHAPES = 1 << 10
REACH = 2
MIN_DOCS = 4
HIDDEN = 32
RESULT = "doc_id long, quality double, toxic double, keep boolean"


@dataclass
class Model:
    bucket_slot: np.ndarray  # bucket -> row of vectors; -1: by shape
    vectors: np.ndarray  # rows for known buckets, then one for each shape
    salience: np.ndarray  # (rows, 2)
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: np.ndarray


def index_vectors(n: int, dim: int = DIM) -> np.ndarray:
    """n sparse ternary vectors, the same on every machine."""
    out = np.zeros((n, dim), np.float32)
    for j in range(NONZERO):
        h = tc.mix(np.arange(n, dtype=np.uint64) * np.uint64(NONZERO) + np.uint64(j + 1))
        out[np.arange(n), (h >> np.uint64(8)).astype(np.int64) % dim] += np.where(h & np.uint64(1), 1, -1).astype(np.float32)
    return out / np.sqrt(NONZERO)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, shape, first token of each row) of the tokens of consecutive rows."""
    t = Tokens(data, off)
    w = tc.Words.__new__(tc.Words)
    w.data, w.row_off, w.start, w.end, w.first = data, off, t.start, t.end, t.first
    bucket = (w.hashes(fold=True) >> np.uint64(48)).astype(np.int64)
    size = t.end - t.start
    if not len(t):
        return bucket, bucket, t.first
    cls = _CLASS[data]
    shape = np.minimum(size, 15)
    for i, bit in enumerate((1, 2, 4, 16)):
        run = np.concatenate([[0], np.cumsum(cls & bit > 0)])
        shape = shape + 16 * 2**i * (run[t.end] > run[t.start])
    return bucket, np.minimum(shape, SHAPES - 1), t.first


def pooled(bucket: np.ndarray, shape: np.ndarray, first: np.ndarray, slot_of: np.ndarray, vectors: np.ndarray, salience: np.ndarray) -> np.ndarray:
    """(rows, 3 * DIM + 1) features."""
    rows = len(first) - 1
    n = np.diff(first)
    out = np.zeros((rows, 3 * vectors.shape[1] + 1), np.float32)
    out[:, -1] = np.log1p(n)
    if not len(bucket):
        return out
    slot = slot_of[bucket]
    slot = np.where(slot >= 0, slot, len(vectors) - SHAPES + shape)
    d = vectors.shape[1]
    has = np.flatnonzero(n)
    row = np.repeat(np.arange(rows), n)
    block = 1 << 15
    for lo in range(0, len(slot), block):
        part, r = slot[lo : lo + block], row[lo : lo + block]
        at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[at], :d] += np.add.reduceat(vectors.take(part, axis=0), at, axis=0)
    out[has, :d] /= n[has, None]
    for k in range(2):
        hit = np.flatnonzero(salience[slot, k])
        if len(hit):
            s, r = slot[hit], row[hit]
            at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            out[r[at], d * (k + 1) : d * (k + 2)] = np.add.reduceat(vectors[s] * salience[s, k, None], at, axis=0)
    out[:, d : 3 * d] = np.tanh(out[:, d : 3 * d] / 4)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str], labels: np.ndarray, seed: int = 5, epochs: int = 60) -> Model | None:
    """Fit on texts and (n, 2) labels of quality and toxic."""
    if not len(texts):
        return None
    rng = np.random.default_rng(seed)
    docs = [tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in texts]
    held = np.zeros(len(docs), bool)
    held[rng.permutation(len(docs))[: len(docs) // 5]] = True
    fit = np.flatnonzero(~held)
    seen = np.zeros((3, BUCKETS))  # documents with the bucket: all, good quality, toxic
    for i in fit:
        u = np.unique(docs[i][0])
        seen[0, u] += 1
        seen[1, u] += labels[i, 0]
        seen[2, u] += labels[i, 1]
    known = np.flatnonzero(seen[0] >= MIN_DOCS)
    slot_of = np.full(BUCKETS, -1, np.int32)
    slot_of[known] = np.arange(len(known))
    own = index_vectors(BUCKETS + SHAPES)
    context = np.zeros((BUCKETS, DIM), np.float32)
    for i in fit:
        b = docs[i][0]
        for o in range(1, min(REACH, len(b) - 1) + 1):
            for to, by in ((b[o:], b[:-o]), (b[:-o], b[o:])):
                order = np.argsort(to, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) > 0]))
                context[to[order[at]]] += np.add.reduceat(own[by[order]], at, axis=0)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    vectors = np.concatenate([own[known] + 0.5 * context[known], own[BUCKETS:]]).astype(np.float32)
    salience = np.zeros((len(vectors), 2), np.float32)
    n = len(fit)
    for k in range(2):
        pos = max(1.0, labels[fit, k].sum())
        neg = max(1.0, n - labels[fit, k].sum())
        a, b = seen[k + 1][known], (seen[0] - seen[k + 1])[known]
        ratio = np.log((a + 0.5) / (pos + 1)) - np.log((b + 0.5) / (neg + 1))
        z = ratio / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        salience[: len(known), k] = np.where(np.abs(z) > 4, ratio, 0)
    x = np.concatenate([pooled(*d, slot_of, vectors, salience) for d in docs])
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-4
    x = (x - mean) / scale
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 2)), np.zeros(2)]
    m1, m2, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for lo in range(0, len(order), 64):
            at = order[lo : lo + 64]
            h = np.maximum(x[at] @ p[0] + p[1], 0)
            g = (_sigmoid(h @ p[2] + p[3]) - labels[at]) / len(at)
            gh = (g @ p[2].T) * (h > 0)
            grads = [x[at].T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], g.sum(0)]
            step += 1
            for k, (v, d) in enumerate(zip(p, grads)):
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                v -= 0.003 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    at = np.flatnonzero(held) if held.any() else fit
    logit = np.maximum(x[at] @ p[0] + p[1], 0) @ p[2] + p[3]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    temperature = np.ones(2)
    for k in range(2):
        loss = [np.mean(np.logaddexp(0, np.where(labels[at, k] > 0, -1, 1) * logit[:, k] / t)) for t in grid]
        temperature[k] = grid[int(np.argmin(loss))]
    return Model(slot_of, vectors, salience, mean, scale, *(v.astype(np.float32) for v in p), temperature)


def score(arr: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """((rows, 2) calibrated probabilities, rows that hold a token)."""
    b, s, first = tokens(*tc.flat(arr))
    x = (pooled(b, s, first, m.bucket_slot, m.vectors, m.salience) - m.mean) / m.scale
    return _sigmoid((np.maximum(x @ m.w1 + m.b1, 0) @ m.w2 + m.b2) / m.temperature), np.diff(first) > 0


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model | None:
    """A model of at most ``limit`` labelled documents; the join broadcasts just that many labels."""
    given = sample_rows(labels.where("doc_id is not null and quality is not null and toxic is not null"), ["doc_id", "quality", "toxic"], limit)
    part = given.select(F.col("doc_id").alias("labelled"), "quality", "toxic")
    found = docs.select("doc_id", "text").join(F.broadcast(part), F.col("doc_id") == F.col("labelled")).where("text is not null").drop("labelled")
    order = F.xxhash64("doc_id", "text", "quality", "toxic")
    rows = found.withColumn("__hash", order).dropDuplicates(["__hash"]).orderBy("__hash").limit(limit).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["quality"], r["toxic"]))
    return train([r["text"] for r in rows], np.array([[r["quality"], r["toxic"]] for r in rows], float).reshape(-1, 2))


def _map(model: Model | None, threshold: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr, docs = tc.text_array(batch.column("text")), batch.column("doc_id")
            for lo, hi in tc.slices(arr):
                if model is None:
                    none = pa.nulls(hi - lo, pa.float64())
                    yield pa.RecordBatch.from_arrays([docs[lo:hi], none, none, pa.array([True] * (hi - lo))], names=["doc_id", "quality", "toxic", "keep"])
                    continue
                p, has = score(arr[lo:hi], model)
                p = np.where(has[:, None], p, 0.0)
                yield pa.RecordBatch.from_arrays([docs[lo:hi], pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(has & (p[:, 0] >= threshold) & (p[:, 1] < threshold))], names=["doc_id", "quality", "toxic", "keep"])

    return fn


def quality(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, quality, toxic, keep) of every document."""
    model = model or fit(docs, labels)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_map(model, threshold), RESULT)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(tc.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
