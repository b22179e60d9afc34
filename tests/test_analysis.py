import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millstone.functions.text import simple_words
from millstone.operators import analysis


def batches(texts, rows):
    """Texts, given as lists of words, in rows of at most PART words and batches of so many rows."""
    out = [(i, k // analysis.PART, words[k : k + analysis.PART]) for i, words in enumerate(texts) for k in range(0, max(1, len(words)), analysis.PART)]
    for k in range(0, len(out), rows):
        ids, part, words = zip(*out[k : k + rows])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part, pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "part", "words"])


def test_python_memory_is_bounded():
    """A batch of 10,000 rows is counted in slices; its words in one go took over 100 MB."""
    texts = np.array([f"w{i}" for i in range(1000)])[np.random.default_rng(1).integers(0, 1000, (10_000, 200))].tolist()
    given = list(batches(texts, 10_000))
    tracemalloc.start()
    words = 0
    for found in analysis._counter(lambda word: word)(iter(given)):
        assert found.num_rows <= analysis.SLICE * 2
        words += int(np.asarray(found.column("tf")).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == 2_000_000
    assert peak < 60e6


def test_texts_over_rows_batches_and_slices(monkeypatch):
    monkeypatch.setattr(analysis, "PART", 3)
    monkeypatch.setattr(analysis, "SLICE", 10)
    monkeypatch.setattr(analysis, "MEMO", 4)
    rng = np.random.default_rng(2)
    texts = [[f"w{x}" for x in rng.integers(0, 9, n)] for n in [0, 1, 3, 4, 40, 0, 2, 9, 10, 11, 0, 35, 5, 0]]
    keep = lambda word: None if word == "w0" else word.upper()
    for rows in (1, 2, 5, 100):
        got = [r for b in analysis._counter(keep)(batches(texts, rows)) for r in zip(*(c.to_pylist() for c in b.columns))]
        want = []
        for i, words in enumerate(texts):
            left = [w.upper() for w in words if w != "w0"]
            want += [("", i, 0, len(left))] + [(t, i, n, len(left)) for t, n in Counter(left).items()]
        assert sorted(got) == sorted(want)


def test_long_and_empty_texts(spark):
    texts = ["a b a", "", None, "x " * 5000 + "y", "b " * analysis.PART, "b " * (analysis.PART + 1), "!"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").coalesce(1)
    got = {tuple(r) for r in analysis.analyze(df, simple_words(F.col("text")), lambda word: word).collect()}
    want = set()
    for i, text in enumerate(texts, 1):
        words = [w for w in (text or "").split() if w.isalnum()]
        want |= {("", i, 0, len(words))} | {(t, i, n, len(words)) for t, n in Counter(words).items()}
    assert got == want
