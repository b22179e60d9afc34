"""Ranking functions as column expressions.

Both skip what they can't rank by giving null: a term that isn't in the document, an empty corpus, and,
for BM25, a mean length below one. The mean length of BM25 is an integer division.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millstone.errors import InvalidError

K1, B = 1.2, 0.75


def tf_idf(tf: Column, doc_len: Column, df: Column, docs: Column, words: Column) -> Column:
    return F.when((tf > 0) & (docs > 0) & (df > 0), F.log(tf + 1.0) * (F.log(docs / df) + 1.0))


def bm25(tf: Column, doc_len: Column, df: Column, docs: Column, words: Column) -> Column:
    mean = F.floor(words / F.nullif(docs, F.lit(0)))
    t = F.log(tf + 1.0)
    weight = F.log((docs - df + 0.5) / (df + 0.5) + 1.0)
    return F.when((tf > 0) & (mean >= 1), t / (t + K1 * ((1 - B) + B * doc_len / mean)) * weight)


ALGORITHMS = {"BM25": bm25, "TF-IDF": tf_idf}


def algorithm(name: str):
    """The ranking function of a name, in any case."""
    found = ALGORITHMS.get(str(name).upper())
    if found is None:
        raise InvalidError("invalid algorithm")
    return found
