"""Packing against brute force BM25, and the pipeline as a whole."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from tests_util import prose

from millstone.llm import lexical_packing as lp


def test_every_word_once(make, sample):
    d = sample.select("doc_id", "text")
    windows = lp.lexical_packing(d, context=700).collect()
    sizes = Counter()
    for w in windows:
        assert w["n_words"] == sum(w["lengths"]) <= 700 and w["seed"] == w["doc_ids"][0]
        for doc, start, n in zip(w["doc_ids"], w["starts"], w["lengths"]):
            sizes[doc, start] += n
    import re

    want = {r["doc_id"]: len(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", r["text"])) for r in d.collect()}
    covered = Counter()
    for (doc, _), n in sizes.items():
        covered[doc] += n
    assert covered == Counter({k: v for k, v in want.items() if v})
    for doc in covered:
        at = sorted((s, n) for (k, s), n in sizes.items() if k == doc)
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    assert np.mean([w["n_words"] for w in windows[:-1]]) > 600


def test_scores_equal_bm25():
    docs = [prose(n, i) for i, n in enumerate([30, 80, 45, 200, 12, 60] * 5)]
    vocab = sorted({w for d in docs for w in d})
    code = {w: i for i, w in enumerate(vocab)}
    df = np.zeros(lp.DF_BUCKETS, np.int64)
    for d in docs:
        for w in set(d):
            df[code[w]] += 1
    bags = [Counter(code[w] for w in d) for d in docs]
    mean = float(np.mean([len(d) for d in docs]))
    index = lp.Shard([np.array(sorted(b), np.uint32) for b in bags], [np.array([b[t] for t in sorted(b)], np.uint32) for b in bags], np.array([len(d) for d in docs]), df, len(docs), mean)
    for i in (0, 7, 29):
        want = [sum(q * math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * b[t] * (lp.K1 + 1) / (b[t] + lp.K1 * (1 - lp.B + lp.B * len(d) / mean)) for t, q in bags[i].items()) for b, d in zip(bags, docs)]
        assert np.allclose(index.scores(i), want, rtol=1e-4)


def test_neighbours_come_first(make):
    a, b = prose(100, 1), prose(100, 2)
    texts = [" ".join(x) for x in (a, b, a[:50] + prose(50, 3), b[:50] + prose(50, 4))]
    mixed = {frozenset(w["doc_ids"]) for w in lp.lexical_packing(make(texts), context=200).collect()}
    assert mixed == {frozenset({0, 2}), frozenset({1, 3})}


def test_copies_meet_at_any_size(make, monkeypatch):
    monkeypatch.setattr(lp, "PARTITION_DOCS", 1)  # a partition a document, so 520 of them, as for 4 million documents
    texts = [" ".join(prose(60, i // 2)) for i in range(520)]
    windows = lp.lexical_packing(make(texts), context=120).collect()
    met = sum({2 * (w["seed"] // 2), 2 * (w["seed"] // 2) + 1} == set(w["doc_ids"]) for w in windows)
    assert met == 260


def test_document_frequencies_are_exact(make):
    texts = [" ".join([*(f"f{i}x{j}" for j in range(20_000)), "often", *["twice"] * (i % 2)]) for i in range(20)] + ["often twice"]
    rows = make(texts).select("doc_id", "text").mapInArrow(lp._bags, lp.BAGS)
    routed = lp._with_runs(rows).selectExpr("*", "cast(doc_id % 3 as int) part")
    seen = [n for r in lp._document_frequencies(routed, 9).collect() for n in np.frombuffer(r["n"], np.uint32)]
    assert Counter(seen) == {1: 400_000, 21: 3, 11: 3}


def test_rarer_word_first_in_a_large_vocabulary(make):
    # 1.2 million words, of which S and A share one that 2 documents hold, S and B one that 6 hold
    filler = [" ".join([*(f"f{i}x{j}" for j in range(29_700)), *(f"c{g}" if i < 4 else f"d{i}x{g}" for g in range(300))]) for i in range(40)]
    own = lambda name, *shared: " ".join([*(f"{name}u{j}" for j in range(50 - len(shared))), *shared])
    groups = [own(f"{kind}{g}", *words) for g in range(300) for kind, words in (("s", (f"r{g}", f"c{g}")), ("a", (f"r{g}",)), ("b", (f"c{g}",)))]
    windows = lp.lexical_packing(make([*groups, *filler]), context=100).collect()
    used, wrong, right = set(), 0, 0
    for w in windows:
        seed, other = w["seed"], w["doc_ids"][-1]
        if seed < 900 and seed % 3 == 0:
            right += other == seed + 1
            wrong += other != seed + 1 and seed + 1 not in used
        used.update(w["doc_ids"])
    assert right > 30 and not wrong


def test_only_hot_routes_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lp, "SHARD", 10)
    bags = spark.range(225).selectExpr("if(id < 200, -7, id div 2) route", "if(id % 3 = 0, null, id) doc_id", "1 n_words", "cast(cast(id as string) as binary) terms", "cast('' as binary) counts")
    rows = lp._with_runs(bags).collect()
    assert len(rows) == 225 and all(r["run"] == 0 for r in rows if r["route"] != -7)
    runs = Counter(r["run"] for r in rows if r["route"] == -7)
    assert set(runs) <= set(range(20)) and len(runs) > 15 and max(runs.values()) < 30


def test_a_partition_is_not_copied_whole(monkeypatch):
    monkeypatch.setattr(lp, "SHARD", 50)
    n, terms = 400, 1000
    own = [np.arange(i, i + terms, dtype=np.uint64) for i in range(n)]
    bags = pa.table({"route": pa.array(range(n)), "doc_id": pa.array(range(n)), "n_words": pa.array([terms] * n, pa.int32()), "terms": pa.array(map(lp._packed, own), pa.binary()), "counts": pa.array([np.ones(terms, np.uint32).tobytes()] * n, pa.binary()), "run": pa.array([0] * n, pa.int64())})
    vocab = np.arange(n + terms, dtype=np.uint64)
    counts = pa.table({"terms": pa.array([lp._packed(vocab)]), "n": pa.array([np.full(len(vocab), 2, np.uint32).tobytes()])})
    before, held, shard = pa.total_allocated_bytes(), [], lp.Shard
    monkeypatch.setattr(lp, "Shard", lambda *args: held.append(pa.total_allocated_bytes() - before) or shard(*args))
    out = lp._pack(n, float(terms), 2 * terms)(bags, counts)
    assert sorted(d for w in out.column("doc_ids").to_pylist() for d in w) == list(range(n))
    assert len(held) == 8 and max(held) < bags.nbytes / 3


def test_pipeline(spark, sample, tmp_path):
    import corpus_pipeline as cp

    docs = sample
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, docs, None)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == sample.columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    kept = {d for w in docs.collect() for d in w["doc_ids"]}
    assert len(kept) > 0.7 * sample.count()
    direct = cp.run(spark, "/root/testdata/sf0.001")
    assert {d for w in direct.collect() for d in w["doc_ids"]} == kept


def test_pipeline_planted(spark, make):
    import corpus_pipeline as cp

    base, shared = prose(300, 1), " ".join(prose(80, 50))
    near = [*base[:120], "edited", *base[121:]]
    body = lambda i: " ".join(prose(200, 100 + i))
    d = make([" ".join(base), " ".join(near), f"{body(1)} {shared}", f"{shared} {body(2)}", f'{body(3)} token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" {body(4)}', *[body(i) for i in range(10, 30)]])
    out = d
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, out, None)
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(rows) == set(range(25)) - {1}
    assert sum(shared in t for t in rows.values()) == 1 and rows[3].strip() == body(2)
    assert "04dbebab" not in rows[4] and "[SECRET]" in rows[4]
