"""Continuous indexing: a stream of documents becomes commits of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millstone.engine import Index

COMPACT_COMMITS = 50


def add_new(index: Index, batch: DataFrame, store: bool = False, compact_commits: int = COMPACT_COMMITS) -> None:
    """Add what a micro-batch brings, once: repeats within it, known ids and texts without a token are left out.

    A batch that is replayed after a failure finds its documents indexed and adds nothing. Commits are
    compacted once there are ``compact_commits`` of them.
    """
    good = batch.where("doc_id >= 1 and text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    fresh = good.join(index.documents(), "doc_id", "left_anti")
    index.add_documents(fresh, store, skip_empty=True)
    if len(index.store.snapshot().commits) >= compact_commits:
        index.compact()
        index.vacuum()


def ingest(index: Index, stream: DataFrame, checkpoint: str, store: bool = False, **trigger) -> StreamingQuery:
    """Start indexing a stream of (doc_id, text)."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: add_new(index, batch, store)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
