"""Suffix dedup, n-gram Jaccard join, order MinHash, against SQL and brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, same
from tests_util import prose

from millstone.llm import ngram_jaccard, order_minhash, registry, suffix_dedup
from millstone.llm import textcore as tc


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), duck(SF).sql(registry.ORACLE_SQL[name]).df())


def brute_windows(texts, depth):
    seen, out = {}, set()
    for i, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - depth + 1):
            seen.setdefault(tuple(w[p : p + depth]), []).append((i, p))
    for places in seen.values():
        if len(places) > 1:
            for k, (i, p) in enumerate(sorted(places)):
                out |= {(i, q, k == 0) for q in range(p, p + depth)}
    return out


@pytest.mark.parametrize("depth", [1, 3, 9, 50])
def test_repeats_are_exactly_the_repeated_windows(make, depth):
    rng, shared = random.Random(depth), prose(70, 99)
    texts = []
    for i in range(40):
        w = prose(rng.randint(0, 120), i)
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = shared[: rng.choice([40, 50, 51, 70])]
        texts.append(" ".join(w))
    texts += ["a b " * 60, "z " * 200, texts[1], texts[1]]
    got = set()
    for r in suffix_dedup.suffix_dedup(make(texts), depth).collect():
        got |= {(r["doc_id"], q, r["first"]) for q in range(r["start_word"], r["start_word"] + r["n_words"])}
    assert got == brute_windows(texts, depth)


@pytest.mark.parametrize("hot", [3, 12])
def test_repeats_with_hot_grams(make, monkeypatch, hot):
    """Grams of more than a few runs take another way, with the same result."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    license, other = prose(30, 1), prose(45, 2)
    texts = [" ".join([*prose(i % 7, i), *license, *(other if i % 3 else []), *prose(20, 100 + i)]) for i in range(40)] + [" ".join(prose(80, 9))] * 3
    got = set()
    for r in suffix_dedup.suffix_dedup(make(texts), 20).collect():
        got |= {(r["doc_id"], q, r["first"]) for q in range(r["start_word"], r["start_word"] + r["n_words"])}
    assert got == brute_windows(texts, 20)


def test_remove_repeats_keeps_one_copy(make):
    p = " ".join(prose(60, 5))
    a, b = " ".join(prose(30, 6)), " ".join(prose(30, 7))
    rows = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(make([f"{a}\n{p}", f"{b}  {p}\n{a}", p, "", None])).collect()}
    assert rows[0]["text"] == f"{a}\n{p}" and rows[1]["text"] == f"{b}\n{a}"
    assert rows[1]["n_chars"] == len(rows[1]["text"])
    assert set(rows) == {0, 1, 3, 4}


def shingle_sets(texts, n=3):
    out = []
    for t in texts:
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute_classes(ids, texts, threshold):
    """{doc_id: (class, links)} by comparing all different sets."""
    sets = [frozenset(s) for s in shingle_sets(texts)]
    docs = {}
    for i, s in zip(ids, sets):
        docs.setdefault(s, []).append(i)
    docs.pop(frozenset(), None)
    names = list(docs)
    links = {s: 0 for s in names}
    root = {s: s for s in names}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in combinations(names, 2):
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    low = {}
    for s in names:
        low[find(s)] = min(low.get(find(s), 1 << 60), *docs[s], 1 << 60)
    return {i: (low[find(s)], links[s]) if s else (i, 0) for i, s in zip(ids, sets)}


def edited(rng, sizes, count):
    texts = []
    for i in range(count):
        base = prose(rng.choice(sizes), i)
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                w[rng.randrange(len(w))] = rng.choice(prose(5, rng.random()))
            texts.append(" ".join(w[: rng.randint(max(1, int(len(w) * 0.7)), len(w))]))
    return texts


def classes(docs, threshold):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_jaccard.ngram_jaccard(docs, threshold).collect()}


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.8])
def test_join_against_brute_force(make, threshold):
    texts = edited(random.Random(int(threshold * 10)), [2, 3, 5, 12, 40, 60, 150, 700, 3000], 40)
    texts += ["", None, texts[4], texts[4].upper()]
    assert classes(make(texts), threshold) == brute_classes(range(len(texts)), texts, threshold)


def test_join_in_blocks(make, monkeypatch):
    # every meeting is cut into many cells
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 7)
    rng, base = random.Random(3), prose(120, 1)
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{i}"
        texts.append(" ".join(w))
    assert classes(make(texts), 0.6) == brute_classes(range(len(texts)), texts, 0.6)


def test_short_pairs_share_a_key():
    """Pairs of four shingles that differ in the last, at exactly the threshold: all share a key."""
    rng = random.Random(5)
    lines = []
    for _ in range(20_000):
        w = [f"w{rng.randrange(10**12)}" for _ in range(6)]
        lines += [" ".join(w), " ".join(w) + "x"]
    edges = ngram_jaccard.band_edges(0.6)
    for t in (0.6, 0.2):
        s = ngram_jaccard.Shingles(tc.text_array(pa.array(lines)), 3)
        key, off = ngram_jaccard.sketch_keys(s, t, edges, 0)
        found = [set(key[a:b].tolist()) for a, b in zip(off, off[1:])]
        assert all(found[i] & found[i + 1] for i in range(0, len(found), 2))


def test_large_sets_whose_hashes_are_far_apart(make):
    """A sample of hashes below a limit would hold nothing of the common shingles and all of the others."""

    def grow(words, count, low):
        rng = random.Random(len(words))
        while count:
            w = f"w{rng.randrange(10**12)}"
            gram = ngram_jaccard.Shingles(tc.text_array(pa.array([" ".join([*words[-2:], w])])), 3).grams
            if len(words) < 2 or (int(tc.mix(gram + np.uint64(0x632BE59BD9B4E019))[0]) < 0.14 * 2**64) == low:
                words, count = [*words, w], count - 1
        return words

    base = grow([], 266, False)
    texts = [" ".join(base), " ".join(grow(base, 176, True))]  # 264 of 440 shingles
    assert classes(make(texts), 0.6) == brute_classes(range(2), texts, 0.6) == {0: (0, 1), 1: (0, 1)}


@pytest.mark.parametrize("slices", [1, 40])
def test_texts_that_share_a_notice_do_not_meet(make, monkeypatch, slices):
    notice = " ".join(f"{w}extraordinarily{w}" for w in prose(40, 1))
    texts = [f"{notice} {' '.join(f'{w}{i}' for w in prose(40, 100 + i))}" for i in range(300)]
    texts += [f"{texts[0]} more", f"{texts[1]} and more", texts[2]]
    met, cells = [], ngram_jaccard._cells
    monkeypatch.setattr(ngram_jaccard, "_cells", lambda sets: met.append(sets.count()) or cells(sets))
    monkeypatch.setattr(ngram_jaccard, "SLICE", 303 * 80 // slices)
    assert classes(make(texts), 0.6) == brute_classes(range(len(texts)), texts, 0.6)
    assert set(met) == {4}


def test_join_with_frequent_shingles(make, monkeypatch):
    # nearly all shingles are frequent, so sets are entered by them
    monkeypatch.setattr(ngram_jaccard, "SLICE", 500)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", 3)
    rng, base = random.Random(3), prose(90, 1)
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{i}"
        texts.append(" ".join(w[rng.randint(0, 30) :]))
    assert classes(make(texts), 0.6) == brute_classes(range(len(texts)), texts, 0.6)


def test_join_of_one_repeated_text(make, spark):
    text = " ".join(prose(80, 2))
    d = spark.range(60_000).selectExpr("id as doc_id", f"if(id % 3 = 0, '{text}', concat('other words with number n', id, ' and no more m', id)) as text", "'z' as hub", "'z' as hash")
    out = ngram_jaccard.ngram_jaccard(d).selectExpr("doc_id", "class_id = if(doc_id % 3 = 0, 0, doc_id) as right", "n_links").groupBy("right").agg({"doc_id": "count"}).collect()
    assert [(r[0], r[1]) for r in out] == [(True, 60_000)]


def test_rows_that_share_a_doc_id(make):
    a, b = " ".join(prose(50, 1)), " ".join(prose(50, 2))
    d = make([(7, a), (7, b), (3, a), (9, b + " more"), (9, b + " more"), (None, a)])
    assert classes(d, 0.6) == {3: (3, 0), 7: (3, 1), 9: (7, 1)}
    kept = sorted((r["doc_id"] or 0, r["text"] == b) for r in ngram_jaccard.drop_near_copies(d).collect())
    assert kept == [(0, False), (3, False), (7, True)]


def test_components_and_dropping(spark, make):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5)] + [(i, i + 1) for i in range(100, 160)]
    got = {r["doc_id"]: r["group"] for r in ngram_jaccard.components(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20} | {i: 100 for i in range(100, 161)}
    base = prose(200, 8)
    near = [*base[:100], "changed", *base[101:]]
    kept = ngram_jaccard.drop_near_copies(make([" ".join(prose(200, 9)), " ".join(base), " ".join(near), " ".join(base).upper(), None, "", (None, "no id")])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept) == [(False, 0), (False, 1), (False, 4), (False, 5), (True, None)]


def test_order_minhash_follows_order(make):
    w = prose(300, 4)
    edited = w[:150] + ["new"] + w[151:]
    shuffled = w[150:] + w[:150]
    rows = {r["doc_id"]: r["signature"] for r in order_minhash.order_minhash(make([" ".join(x) for x in (w, edited, shuffled, prose(300, 77))] + [" ".join(w).upper()]), m=200).collect()}
    s = lambda i: order_minhash.similarity(rows[0], rows[i])
    assert s(4) == 1.0 and s(1) > 0.9 and s(1) > s(2) > s(3) and s(3) < 0.1
