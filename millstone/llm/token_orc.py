"""Token ids as ORC files: a binary corpus format with an index.

Documents are tokenized (public byte-level vocabulary, read from a path) and written as ORC. Token ids
and lengths are integer columns, which ORC stores with run-length encoding (RLE v2: bit-packed, delta
or patched runs); every ``ROW_STRIDE`` rows have min/max index entries, and doc_id has a Bloom filter in
each. Rows are sorted by doc_id inside a file, without a shuffle. Stripes are the unit of parallel
reads; a lookup of documents prunes files' stripes and row groups by their metadata.

Defined cases: a null text is kept with null token_ids and n_tokens; an empty text has an empty list; a
null doc_id is kept and sorts first; repeated rows are kept; an empty table makes an empty data set;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.llm import pieces
from millstone.llm import textcore as tc

SCHEMA = "doc_id long, n_tokens int, token_ids array<int>"
STRIPE_BYTES = 32 << 20
ROW_STRIDE = 1000
BLOOM_FPP = 0.01
SLICE_BYTES = 12 << 20

_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        _encoders[path] = tiktoken.Encoding("corpus", pat_str=pieces.PATTERN, mergeable_ranks=pieces.read_ranks(path), special_tokens={})
    return _encoders[path]


def _units(path: str):
    def encode(units: list[str]) -> pieces.Lists:
        one = _encoder(path).encode_ordinary  # its batch form costs a thread pool task a unit
        found = [one(u) for u in units]
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        return np.fromiter(chain.from_iterable(found), np.int32, total), np.concatenate([[0], np.cumsum(size)])

    return encode


def _tokenize(path: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            arr = tc.text_array(texts)
            for lo, hi in tc.slices(arr, SLICE_BYTES):
                values, off = pieces.encode_texts(arr[lo:hi], _units(path))
                null = np.asarray(texts[lo:hi].is_null())
                ids = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, pa.int32()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(np.diff(off), pa.int32(), mask=null), ids], names=["doc_id", "n_tokens", "token_ids"])

    return fn


def token_ids(docs: DataFrame, path: str = pieces.VOCABULARY) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(path), SCHEMA)


def write_tokens(docs: DataFrame, out: str, path: str = pieces.VOCABULARY, stripe: int = STRIPE_BYTES, stride: int = ROW_STRIDE) -> None:
    """Write the token ids of ``docs`` as an indexed ORC data set."""
    (
        token_ids(docs, path)
        .sortWithinPartitions("doc_id")
        .write.option("orc.compress", "zstd")
        .option("orc.stripe.size", stripe)
        .option("orc.row.index.stride", stride)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(out)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The data set, or those of the given documents; the condition is pushed into the ORC reader."""
    found = spark.read.schema(SCHEMA).orc(path)
    return found if doc_ids is None else found.where(F.col("doc_id").isin([int(d) for d in doc_ids]))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All token ids, read back from the ORC files just written."""
    out = tc.shared_dir(spark, "tokens-orc")
    write_tokens(tc.documents(spark, sf_dir), out)
    return read_tokens(spark, out)
