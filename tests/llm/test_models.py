"""Language ID, quality and secrets on held-out documents; the CRF against enumeration; search recall."""

import re
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millstone.llm import hnsw, language_id, quality, secret_scan
from millstone.llm import textcore as tc

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"select doc_id, text, lang, quality, toxic from '{SF}/documents.parquet' left join '{SF}/labels.parquet' using (doc_id) order by hash(doc_id) limit 3000").fetchall()


def test_language_held_out(rows):
    m = language_id.train([r[1] for r in rows[:1200]], [r[2] for r in rows[:1200]])
    lang, conf, _ = language_id.classify(tc.text_array(pa.array([r[1] for r in rows[1200:2200]])), m)
    assert np.mean([a == r[2] for a, r in zip(lang, rows[1200:2200])]) > 0.98
    assert np.mean(conf >= language_id.MIN_CONFIDENCE) > 0.995
    x = np.random.default_rng(0).integers(32, 127, (40, language_id.WINDOW)).astype(np.uint8)
    h, _ = language_id._forward(m, x)
    logit = h @ m.dense + m.dense_bias
    p = np.exp(logit - logit.max(1, keepdims=True))
    assert np.allclose(language_id.Scorer(m)(x), p / p.sum(1, keepdims=True), atol=1e-4)


def test_language_cases(make):
    assert language_id.keep_identified(make(["abc", None], lang=None)).count() == 2
    out = {r["doc_id"]: r for r in language_id.language_id(make(["the cat is here and there", "", None, "  "])).collect()}
    assert out[0]["accepted"] and all(out[i]["lang"] is None and not out[i]["accepted"] and out[i]["confidence"] == 0 for i in (1, 2, 3))


def test_quality_held_out(rows):
    known = [r for r in rows if r[3] is not None]
    n = len(known) * 2 // 3
    m = quality.train([r[1] for r in known[:n]], np.array([[r[3], r[4]] for r in known[:n]], float))
    p, _ = quality.score(tc.text_array(pa.array([r[1] for r in known[n:]])), m)
    y = np.array([[r[3], r[4]] for r in known[n:]])
    assert ((p > 0.5) == y).mean(0).min() > 0.9
    # calibration: mean probability near the share of positives
    assert np.abs(p.mean(0) - y.mean(0)).max() < 0.08


def test_quality_cases(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["keep"] for r in quality.quality(make(["a", None]), none).collect()] == [True, True]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 1), (3, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.quality(make([f"good words {i}" if i % 2 else f"### bad !!! {i}" for i in range(20)] + [None, ""]), labels).collect()}
    assert len(out) == 22 and not out[20]["keep"] and out[20]["quality"] == 0 and not out[21]["keep"]


@pytest.fixture(scope="module")
def crf(rows):
    return secret_scan.train([r[1] for r in rows[:300]])


def spans(texts, m):
    got = []
    row, a, b, _, _ = secret_scan.scan(tc.text_array(pa.array(texts)), m)
    data, off = tc.flat(tc.text_array(pa.array(texts)))
    for r, x, y in zip(row, a, b):
        got.append((int(r), data[x:y].tobytes().decode()))
    return got


def test_secrets_held_out(rows, crf):
    texts = [r[1] for r in rows[300:]]
    want = {(i, m.group(1)) for i, t in enumerate(texts) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    got = set(spans(texts, crf))
    assert len(want) > 20 and len(want & got) >= 0.97 * len(want)
    assert len(got - want) <= 0.05 * len(want) + 1


def test_secret_formats(crf):
    key = "wJalrXUtnFEMI7K7MDENGbPxRfiCYzzEXAKEYabc"
    texts = [f'the secret = "{key}" is here', f"and password={key[:20]}9 of the", "card 4111111111111111 and 10.20.30.40 on 2024-01-02 or +1 (545) 123-4567", "nothing at all to see here"]
    got = spans(texts, crf)
    assert {r for r, _ in got} == {0, 1}


@pytest.mark.parametrize("seed", range(12))
def test_viterbi_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    m = secret_scan.Model(None, rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
    sizes = rng.integers(0, 8, 6)
    e = rng.normal(0, 1, (int(sizes.sum()), 3)).astype(np.float32)
    e[:, 0] += rng.choice([0, 2, 9], len(e))
    first = np.concatenate([[0], np.cumsum(sizes)])
    got = secret_scan.viterbi(e, first, m)
    for a, b in zip(first, first[1:]):
        if a == b:
            continue

        def total(y, a=a):
            return m.start[y[0]] + sum(float(e[a + i, k]) for i, k in enumerate(y)) + sum(m.trans[p, q] for p, q in zip(y, y[1:]))

        best = max(total(y) for y in product(range(3), repeat=int(b - a)))
        assert abs(total(got[a:b].tolist()) - best) < 1e-5


def test_masking(make):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    body = "ordinary words stand here and there for the most part of it "
    d = make([f'{body} é token = "{secret}" {body}'] * 5 + [body, None, ""])
    rows = secret_scan.mask_secrets(d).collect()
    assert len(rows) == 8
    hit = [r for r in rows if r["text"] and "token" in r["text"]]
    assert all(secret not in r["text"] and secret_scan.MASK in r["text"] and r["n_chars"] == len(r["text"]) for r in hit)
    assert sum(r["text"] == body for r in rows) == 1
    found = secret_scan.secret_scan(d).collect()
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    assert len(found) == 5 and all(texts[r["doc_id"]][r["start_char"] : r["start_char"] + r["n_chars"]] == secret for r in found)


def brute_neighbours(v, queries, k):
    """Exact neighbours by similarity, then id; row numbers are ids."""
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    s = v[queries] @ v.T
    s[np.arange(len(queries)), queries] = -2
    return {q: np.argsort(-np.round(row, 6), kind="stable")[:k].tolist() for q, row in zip(queries, s)}


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], set()).add(r["neighbor_id"])
    assert all(len(got[q]) == len(w) for q, w in want.items()) and got.keys() == want.keys()
    return np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("shard, probes, least", [(hnsw.SHARD, None, 0.95), (200, None, 0.97), (200, 8, 0.7)])
def test_hnsw_recall(spark, shard, probes, least):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = np.array([r[0] for r in duckdb.sql(f"select embedding from '{SF}/embeddings.parquet' order by vec_id").fetchall()], np.float64)
    rows = hnsw.nearest(e, k=10, shard=shard, probes=probes).collect()
    assert recall(rows, brute_neighbours(v, range(len(v)), 10)) > least
    near = {(r["vec_id"], r["neighbor_id"]): r["similarity"] for r in rows}
    a, b = map(list, zip(*near))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert np.allclose(np.einsum("nd,nd->n", unit[a], unit[b]), list(near.values()), atol=1e-5)


def test_hnsw_queries_are_every_hundredth(spark):
    got = hnsw.op9_hnsw(spark, SF).groupBy("vec_id").count().collect()
    assert {(r[0], r[1]) for r in got} == {(i, 10) for i in range(0, 2000, 100)}


def test_hnsw_copies_are_ordered_by_id(spark):
    # a third of the rows are one vector, and a third lie around another
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (1500, 12))
    v[::3] = v[0]
    v[1::3] = v[1] + rng.normal(0, 0.01, (500, 12))
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    rows = hnsw.nearest(d, k=10, shard=120, every=2).collect()
    want = brute_neighbours(v, range(0, 1500, 2), 10)
    assert recall(rows, want) > 0.95
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["vec_id"], []).append(r["neighbor_id"])
    assert all(got[q] == want[q] for q in range(0, 1500, 6))


def test_hnsw_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (9, [None, 1.0]), (10, [1.0, 1.0])]
    d = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, shard string")
    got = {(r["vec_id"], r["rank"]): (r["neighbor_id"], round(r["similarity"], 3)) for r in hnsw.nearest(d, k=5).collect()}
    assert got == {(1, 1): (10, 0.707), (1, 2): (2, 0.0), (1, 3): (3, 0.0), (2, 1): (10, 0.707), (2, 2): (1, 0.0), (2, 3): (3, 0.0), (3, 1): (1, 0.0), (3, 2): (2, 0.0), (3, 3): (10, 0.0), (10, 1): (1, 0.707), (10, 2): (2, 0.707), (10, 3): (3, 0.0)}
    assert hnsw.nearest(d.limit(0)).collect() == []


def test_hnsw_many_equal_vectors():
    v = np.repeat(np.eye(8, dtype=np.float32), 60, axis=0)
    g = hnsw.build(np.arange(len(v)), v)
    near, sim = hnsw.query(g, v, 10)
    assert (sim[:, :10] > 0.999).mean() > 0.9
