"""Order MinHash fingerprints.

The words of a document (ASCII case folded, punctuation ignored) give k-word shingles; a shingle is
paired with its occurrence number, so repeats are distinct. For each of ``FUNCTIONS`` hash functions the
``TUPLE`` pairs with the smallest hash are selected, put back in text order and hashed together. Equal
entries of two signatures are then likely only if the documents share shingles in the same order, which
makes the share of equal entries an estimate that follows edit distance, not only set overlap.

Hashes are affine functions modulo the prime 2^31 - 1 of MD5-derived word codes, so SQL can express the
operator exactly; ties go to the earlier position. An entry holds two 31-bit hashes of the tuple.

Defined cases: a null, empty or wordless text has a null signature and 0 shingles; a text of fewer than k
words is one shingle; with fewer pairs than ``TUPLE`` the tuple is shorter; a null doc_id is kept;
repeated rows are fingerprinted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.llm import textcore as tc

P = (1 << 31) - 1
K = 3
TUPLE = 2
FUNCTIONS = 16
RADIX, RADIX_2, OCC = 1_000_003, 998_244_353 % P, 69_069
RESULT = "doc_id long, n_shingles long, signature array<long>"


def coefficients(m: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, m + 1, dtype=np.int64)
    return (i * 1_103_515_245 + 12_345) % (P - 1) + 1, (i * 214_013 + 2_531_011) % P


def word_codes(w: tc.Words) -> np.ndarray:
    """31-bit code of each word: the first 8 hexadecimal digits of its MD5 modulo P."""
    folded = tc.FOLD[w.data].tobytes()
    seen: dict[bytes, int] = {}
    at = [seen.setdefault(folded[a:b], len(seen)) for a, b in zip(w.start.tolist(), w.end.tolist())]
    codes = np.array([int(md5(x).hexdigest()[:8], 16) % P for x in seen], np.int64)
    return codes[np.array(at, np.int64)] if at else codes


def fingerprint(codes: np.ndarray, k: int = K, size: int = TUPLE, m: int = FUNCTIONS) -> tuple[int, np.ndarray]:
    """(shingles, signature) of one document's word codes; at least one word."""
    k = min(k, len(codes))
    h = codes[: len(codes) - k + 1].copy()
    for j in range(1, k):
        h = (h * RADIX + codes[j : len(codes) - k + 1 + j]) % P
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    group = np.flatnonzero(first)[np.cumsum(first) - 1]
    occ = np.empty(len(h), np.int64)
    occ[order] = np.arange(len(h)) - group + 1
    x = (h * OCC + occ) % P
    a, b = coefficients(m)
    pos = np.arange(len(x), dtype=np.int64)
    take = min(size, len(x))
    chosen = np.empty((m, take), np.int64)
    step = max(1, (1 << 21) // len(x))
    for lo in range(0, m, step):
        key = ((a[lo : lo + step, None] * x[None, :] + b[lo : lo + step, None]) % P) << 32 | pos[None, :]
        if take < key.shape[1]:
            key = np.partition(key, take - 1, axis=1)[:, :take]
        chosen[lo : lo + step] = np.sort(key & 0xFFFFFFFF, axis=1)
    v = x[chosen]
    one, two = v[:, 0] % P, v[:, 0] % P
    for j in range(1, take):
        one, two = (one * RADIX + v[:, j]) % P, (two * RADIX_2 + v[:, j] + 1) % P
    return len(x), one << 31 | two


def similarity(a, b) -> float:
    """Share of equal entries of two signatures."""
    return float(np.mean(np.asarray(a) == np.asarray(b)))


def _map(k: int, size: int, m: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr, docs = tc.text_array(batch.column("text")), batch.column("doc_id")
            for lo, hi in tc.slices(arr):
                w = tc.words_of(arr[lo:hi], tc.WORDCHAR)
                codes = word_codes(w)
                n, sig = np.zeros(hi - lo, np.int64), []
                for r, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist())):
                    if b > a:
                        n[r], s = fingerprint(codes[a:b], k, size, m)
                        sig.append(s)
                cut = np.concatenate([[0], np.cumsum(np.where(n > 0, m, 0))]).astype(np.int32)
                flat = np.concatenate(sig) if sig else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(flat, pa.int64()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([docs[lo:hi], pa.array(n), lists], names=["doc_id", "n_shingles", "signature"])

    return fn


def order_minhash(docs: DataFrame, k: int = K, size: int = TUPLE, m: int = FUNCTIONS) -> DataFrame:
    """(doc_id, n_shingles, signature) of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_map(k, size, m), RESULT)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signature is given as text, its entries in decimal, separated by blanks."""
    return order_minhash(tc.documents(spark, sf_dir)).select("doc_id", "n_shingles", F.array_join(F.col("signature").cast("array<string>"), " ").alias("signature"))


ORACLE = rf"""
with w as (select doc_id, list_transform(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda t: ('0x' || substr(md5(t), 1, 8))::bigint % {P}) cs from documents),
 s as (select doc_id, len(cs) n, cs, unnest(range(greatest(1, len(cs) - {K - 1}))) p from w where len(cs) > 0),
 h as (select doc_id, p, case when n = 1 then cs[1] when n = 2 then (cs[1] * {RADIX} + cs[2]) % {P}
                else (((cs[p+1] * {RADIX} + cs[p+2]) % {P}) * {RADIX} + cs[p+3]) % {P} end h from s),
 x as (select doc_id, p, (h * {OCC} + row_number() over (partition by doc_id, h order by p)) % {P} x from h),
 f as (select i, (i * 1103515245 + 12345) % {P - 1} + 1 a, (i * 214013 + 2531011) % {P} b from range(1, {FUNCTIONS + 1}) t(i)),
 r as (select doc_id, i, p, x, row_number() over (partition by doc_id, i order by (a * x + b) % {P}, p) rk from x, f),
 c as (select doc_id, i, list(x order by p) v from r where rk <= {TUPLE} group by 1, 2),
 g as (select doc_id, i, case when len(v) = 1 then (v[1] << 31) | v[1]
                else (((v[1] * {RADIX} + v[2]) % {P}) << 31) | ((v[1] * {RADIX_2} + v[2] + 1) % {P}) end e from c),
 o as (select doc_id, string_agg(e::varchar, ' ' order by i) signature from g group by 1),
 k as (select doc_id, count(*) n from x group by 1)
select d.doc_id, coalesce(k.n, 0)::bigint as n_shingles, o.signature from documents d left join o using (doc_id) left join k using (doc_id)
"""
