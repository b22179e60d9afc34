"""Packing of documents into windows by lexical retrieval.

Documents are routed to shards and each shard builds a BM25 inverted index of its own. The next unused
document is the seed of a window: the index ranks the shard's unused documents by their BM25 score for
the whole seed (all of its terms), and they fill the window greedily, best first, as long as one fits.
Every document of a shard is either a seed or a neighbour, and is used once.

* **Routing.** The route of a document is the smallest hash of its 5-word shingles, so copies and
  documents that share passages come to the same shard. Documents of a route are counted: only a route of
  more than ``SHARD`` documents, which no shard can hold, is dealt out to runs of about a shard each, so
  that a passage with copies in all documents still spreads. Shards hold up to ``SHARD`` documents, cut
  from a partition in route order, so memory doesn't depend on the size of the corpus or of a hot route.
* **Statistics** (number of documents, mean length, document frequency of each term) are those of the
  whole corpus. Terms are 48-bit word hashes. Each partition counts its documents by term; the counts are
  summed by ``term % slices``, where slices grow with the partitions, and go back to the partitions that
  hold the term, so no task holds the vocabulary of the corpus.
* **Long documents** fill windows by themselves, a window after another; what is left over is packed
  like a document of that length.

Length is counted in words (runs of letters and digits). Result, one row a window: (seed, doc_ids,
starts, lengths, n_words); piece i of a window holds the words [starts[i], starts[i] + lengths[i]) of
document doc_ids[i].

Defined cases: null, empty and wordless texts are in no window; a null doc_id is packed and stays null;
repeated rows are packed each; equal scores go by row order (route, doc_id); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.llm import textcore as tc

CONTEXT = 2048
SHARD = 2048
SHINGLE = 5
DF_BUCKETS = 1 << 18  # terms of a partition that one row of counts holds at most
PARTITION_DOCS = 4 * SHARD
SLICE_PARTITIONS = 4
K1, B = 1.2, 0.75
BAGS = "route long, doc_id long, n_words int, terms binary, counts binary"
COUNTS = "part int, slice int, terms binary, n binary"
RESULT = "seed long, doc_ids array<long>, starts array<int>, lengths array<int>, n_words int"


def _packed(term: np.ndarray) -> bytes:
    """48-bit terms as 6 bytes each: the low 4 of all, then the high 2."""
    return term.astype(np.uint32).tobytes() + (term >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpacked(raw) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint32, n).astype(np.uint64) | np.frombuffer(raw, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tc.give_back()
    for batch in batches:
        arr, ids = tc.text_array(batch.column("text")), batch.column("doc_id")
        for lo, hi in tc.slices(arr):
            w = tc.words_of(arr[lo:hi], tc.WORDCHAR)
            n = np.diff(w.first)
            has = np.flatnonzero(n)
            if not len(has):
                continue
            h, row = w.hashes(fold=True), w.rows()
            first = w.first[:-1][has]
            k = min(SHINGLE, len(h))
            grams = np.full(len(h), np.iinfo(np.uint64).max)
            inside = tc.window_hash(h, k)
            ok = row[: len(inside)] == row[k - 1 :]
            grams[: len(inside)][ok] = inside[ok]
            route = np.minimum.reduceat(grams, first)
            short = n[has] < k
            route[short] = np.minimum.reduceat(tc.mix(h), first)[short]
            term = h & np.uint64((1 << 48) - 1)
            order = np.lexsort((term, row))
            r, t = row[order], term[order]
            at = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])]))
            count = np.diff(np.append(at, len(t))).astype(np.uint32)
            r, t = r[at], t[at]
            cut = np.searchsorted(r, np.append(has, len(n))).tolist()
            part = ids[lo:hi].take(pa.array(has))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tc.signed(route)),
                    part,
                    pa.array(n[has].astype(np.int32)),
                    pa.array([_packed(t[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array([count[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                ],
                names=["route", "doc_id", "n_words", "terms", "counts"],
            )


def _partition_counts(slices: int):
    """Documents of a partition by term, a row for each slice of the terms (more above DF_BUCKETS terms)."""

    def fn(key: tuple[pa.Scalar, ...], bags: pa.Table) -> pa.Table:
        tc.give_back()
        term, n = np.unique(np.concatenate([_unpacked(t.as_buffer()) for t in bags.column("terms")]), return_counts=True)
        at = (term % np.uint64(slices)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        term, n, at = term[order], n[order].astype(np.uint32), at[order]
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        cut = sorted({*cut.tolist(), *range(0, len(at), DF_BUCKETS), len(at)})
        return pa.Table.from_arrays(
            [
                pa.array([key[0].as_py()] * (len(cut) - 1), pa.int32()),
                pa.array(at[cut[:-1]], pa.int32()),
                pa.array([_packed(term[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()),
                pa.array([n[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
            ],
            names=["part", "slice", "terms", "n"],
        )

    return fn


def _summed(table: pa.Table) -> pa.Table:
    """The rows of a slice with n as the documents of the whole corpus."""
    terms = [_unpacked(t.as_buffer()) for t in table.column("terms")]
    flat, at = np.unique(np.concatenate(terms), return_inverse=True)
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("n")])
    total = np.bincount(at, n, minlength=len(flat)).astype(np.uint32)[at]
    cut = np.cumsum([0, *map(len, terms)])
    return table.set_column(3, "n", pa.array([total[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()))


class Shard:
    """BM25 index of some documents: columns for frequent terms, postings for the others. df is by term."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], n_words: np.ndarray, df: np.ndarray, docs: int, mean: float):
        size = np.array([len(t) for t in terms])
        self.n = len(terms)
        vocab, flat = np.unique(np.concatenate(terms), return_inverse=True)
        tf = np.concatenate(counts).astype(np.float32)
        doc = np.repeat(np.arange(self.n), size)
        freq = np.minimum(df[vocab], docs)
        idf = np.log((docs - freq + 0.5) / (freq + 0.5) + 1).astype(np.float32)
        norm = (K1 * (1 - B + B * n_words / mean)).astype(np.float32)
        weight = idf[flat] * tf * (K1 + 1) / (tf + norm[doc])
        local = np.bincount(flat, minlength=len(vocab))
        common = local * 16 > self.n
        self.slot = np.where(common, np.cumsum(common) - 1, -1)
        self.dense = np.zeros((int(common.sum()), self.n), np.float32)
        hot = common[flat]
        self.dense[self.slot[flat[hot]], doc[hot]] = weight[hot]
        cold = np.flatnonzero(~hot)
        cold = cold[np.argsort(flat[cold], kind="stable")]
        self.post_doc, self.post_weight = doc[cold], weight[cold]
        self.post_first = np.searchsorted(flat[cold], np.arange(len(vocab) + 1))
        cut = np.concatenate([[0], np.cumsum(size)])
        self.query = [(flat[a:b], tf[a:b]) for a, b in zip(cut, cut[1:])]

    def scores(self, i: int) -> np.ndarray:
        """BM25 score of every document for all terms of document i."""
        term, qtf = self.query[i]
        slot = self.slot[term]
        out = qtf[slot >= 0] @ self.dense[slot[slot >= 0]] if (slot >= 0).any() else np.zeros(self.n, np.float32)
        term, qtf = term[slot < 0], qtf[slot < 0]
        a, n = self.post_first[term], self.post_first[term + 1] - self.post_first[term]
        if n.sum():
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            out = out + np.bincount(self.post_doc[at], self.post_weight[at] * np.repeat(qtf, n), minlength=self.n)
        return out


def pack_shard(index: Shard, n_words: np.ndarray, context: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (document, first word, words); every word of every document is in one."""
    left, start = n_words.astype(np.int64).copy(), np.zeros(index.n, np.int64)
    for i in np.flatnonzero(left >= context):
        full = int(left[i] // context)
        for p in range(full):
            yield [(int(i), p * context, context)]
        start[i] = full * context
        left[i] -= full * context
    free = left > 0
    for seed in range(index.n):
        if not free[seed]:
            continue
        window, room = [(seed, int(start[seed]), int(left[seed]))], context - int(left[seed])
        free[seed] = False
        others = np.flatnonzero(free)
        others = others[left[others] <= room]
        if len(others):
            order = others[np.argsort(-index.scores(seed)[others], kind="stable")]
            sizes, at = left[order], 0
            while room > 0:
                fits = sizes[at:] <= room
                if not fits.any():
                    break
                at += int(fits.argmax())
                j = int(order[at])
                window.append((j, int(start[j]), int(left[j])))
                free[j] = False
                room -= int(left[j])
                at += 1
        yield window


def _pack(docs: int, mean: float, context: int):
    def flush(held: list[tuple], vocab: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        ids, n, terms, counts = zip(*held)
        n = np.array(n)
        codes = [np.searchsorted(vocab, _unpacked(t)) for t in terms]
        index = Shard(codes, [np.frombuffer(c, np.uint32) for c in counts], n, df, docs, mean)
        found = list(pack_shard(index, n, context))
        cut = np.concatenate([[0], np.cumsum([len(w) for w in found])])
        flat = [p for w in found for p in w]
        which = [ids[p[0]] for p in flat]
        lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(v, k)) for v, k in ((which, pa.int64()), ([p[1] for p in flat], pa.int32()), ([p[2] for p in flat], pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([ids[w[0][0]] for w in found], pa.int64()), *lists, pa.array([sum(p[2] for p in w) for w in found], pa.int32())], names=["seed", "doc_ids", "starts", "lengths", "n_words"])

    def fn(bags: pa.Table, counts: pa.Table) -> pa.Table:
        vocab = np.concatenate([_unpacked(t.as_buffer()) for t in counts.column("terms")])
        df = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in counts.column("n")]).astype(np.int64)
        order = np.argsort(vocab)
        vocab, df = vocab[order], df[order]
        keys = [(k, "ascending") for k in ("route", "run", "doc_id", "n_words", "terms")]
        order = pc.sort_indices(bags, sort_keys=keys, null_placement="at_start")
        out = []
        for at in range(0, bags.num_rows, SHARD):
            shard = bags.take(order.slice(at, SHARD))  # a shard at a time, since a copy of the whole partition would stay until its end
            out.append(flush(list(zip(*(shard.column(c).to_pylist() for c in ("doc_id", "n_words", "terms", "counts")))), vocab, df))
            tc.give_back()
        return pa.Table.from_batches(out)

    return fn


def _with_runs(bags: DataFrame) -> DataFrame:
    """``bags`` with the run of each row in its route: 0, unless the route has more documents than a shard."""
    hot = bags.groupBy("route").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    hot = hot.select("route", F.ceil(F.col("n") / SHARD).alias("runs"))
    run = F.pmod(F.xxhash64("doc_id", "terms"), F.coalesce("runs", F.lit(1)))
    return bags.join(F.broadcast(hot), "route", "left").withColumn("run", run).drop("runs")


def _document_frequencies(routed: DataFrame, parts: int) -> DataFrame:
    """For each part the terms of its documents, with the documents of the corpus that hold them."""
    counts = routed.groupBy("part").applyInArrow(_partition_counts(-(-parts // SLICE_PARTITIONS)), COUNTS)
    return counts.groupBy("slice").applyInArrow(_summed, COUNTS)


def lexical_packing(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Windows of up to ``context`` words over all documents (see the module for the columns)."""
    bags = tc.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_bags, BAGS), "bags")
    total, words = bags.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    parts = max(1, -(-total // PARTITION_DOCS))
    part = F.pmod(F.xxhash64("route", "run"), F.lit(parts)).cast("int")
    routed = _with_runs(bags).withColumn("part", part)
    df = _document_frequencies(routed, parts)
    fn = _pack(total, max(1.0, words / max(1, total)), context)
    return routed.groupBy("part").cogroup(df.groupBy("part")).applyInArrow(fn, RESULT)


def op7_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_packing(tc.documents(spark, sf_dir))
