"""From documents to postings.

The words of a document are counted where the document is: the words of a few texts become a dictionary,
the filter pipeline runs once for each distinct word, and counting is a sort of (document, term) codes. So
postings come out of a narrow transformation, without a shuffle by document. Texts travel in rows of at
most PART words and are counted about SLICE words at a time, so Python's memory doesn't grow with the
table or with the length of its texts, but for the words of a single text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = ""
MAX_TERM = 65_535
PART = 256  # words in a row that is sent to Python, where batches are of many rows
SLICE = 1 << 18  # words that are counted at a time, or a single text
MEMO = 1 << 17  # filtered words that are remembered
POSTINGS = "term string, doc_id long, tf long, doc_len long"


def analyze(docs: DataFrame, words: Column, pipeline: Callable[[str], str | None]) -> DataFrame:
    """(term, doc_id, tf, doc_len) of every distinct term of each document.

    Each document also has a header row, with term '' and tf 0; so a document without a token is one
    whose doc_len is 0. A token beyond MAX_TERM bytes makes the header's tf its length in bytes.
    """
    whole = docs.select("doc_id", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    parts = F.expr(f"transform(sequence(0, greatest(size(words) - 1, 0) div {PART}), i -> slice(words, i * {PART} + 1, {PART}))")
    return whole.select("doc_id", F.posexplode(parts).alias("part", "words")).mapInArrow(_counter(pipeline), POSTINGS)


def _counter(pipeline: Callable[[str], str | None]):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str | None] = {}
        for texts in _whole(batches):
            yield _count(texts, pipeline, memo)
            if len(memo) > MEMO:
                memo.clear()

    return fn


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole texts that hold SLICE words or are of one text. A text starts at part 0; its rows may be in several batches."""
    held: list[pa.RecordBatch] = []  # rows of a text that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        start = np.flatnonzero(np.asarray(batch.column("part")) == 0)
        if not len(start):
            held.append(batch)
            continue
        if start[0]:
            held.append(batch.slice(0, start[0]))
        if held:
            yield _joined(held)
        words = np.asarray(batch.column("words").offsets)[start]
        lo = 0
        while lo < len(start) - 1:
            hi = min(max(lo + 1, int(np.searchsorted(words, words[lo] + SLICE, side="right")) - 1), len(start) - 1)
            yield batch.slice(start[lo], start[hi] - start[lo])
            lo = hi
        held = [batch.slice(start[-1])]
    if held:
        yield _joined(held)


def _joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    return rows[0] if len(rows) == 1 else pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def _count(batch: pa.RecordBatch, pipeline, memo: dict) -> pa.RecordBatch:
    lists, first = batch.column("words"), np.asarray(batch.column("part")) == 0
    n = int(first.sum())
    off = np.asarray(lists.offsets)
    coded = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    code = np.asarray(coded.indices.fill_null(-1)).astype(np.int64)
    doc = np.repeat(np.cumsum(first) - 1, np.diff(off))
    terms: dict[str, int] = {}
    slot = np.full(len(coded.dictionary) + 1, -1, np.int64)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        if word not in memo:
            memo[word] = pipeline(word)
        term = memo[word]
        if term:
            slot[i] = terms.setdefault(term, len(terms))
    names = list(terms)
    long = np.array([len(t.encode()) if len(t) * 4 > MAX_TERM else 0 for t in names] or [0])
    term = slot[code]
    keep = term >= 0
    term, doc = term[keep], doc[keep]
    size = np.bincount(doc, minlength=n)
    pair, tf = np.unique(doc * (len(names) + 1) + term, return_counts=True)
    d, t = pair // (len(names) + 1), pair % (len(names) + 1)
    over = np.zeros(n, np.int64)
    if (long > MAX_TERM).any():
        np.maximum.at(over, d, np.where(long[t] > MAX_TERM, long[t], 0))
    ids = batch.column("doc_id").filter(pa.array(first))
    index = pa.array(np.concatenate([np.full(n, len(names)), t]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*names, HEADER]).take(index),
            pa.concat_arrays([ids, ids.take(pa.array(d))]),
            pa.array(np.concatenate([over, tf])),
            pa.array(np.concatenate([size, size[d]])),
        ],
        names=["term", "doc_id", "tf", "doc_len"],
    )
