"""An index as Parquet tables and a log of commits.

A commit writes each of its tables to a folder of its own, ``<table>/commit=N/part=<uuid>``, and then one
log entry, which names the uuid. Writers so never touch each other's files, and readers see only what the
log names: a snapshot is a list of entries and never changes. Entry N can be created only once.

``postings`` holds (term, doc_id, tf, doc_len) sorted by term, so a filter on terms skips row groups;
``docs`` (doc_id, doc_len); ``removed`` ids that a commit removes: they hide rows of earlier commits, so a
removed document can be added again. ``terms`` holds each commit's change to the terms' counts.

A compaction is one entry as well: it names the entries that it replaces, which readers then pass over.
Files of replaced entries stay for readers of older snapshots until ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.errors import ExistsError, FatalError
from millstone.sources.fs import Files

VERSION = 2
POSTINGS = "term string, doc_id long, tf long, doc_len long, commit long"
DOCS = "doc_id long, doc_len long, commit long"
REMOVED = "doc_id long, commit long"
TERMS = "term string, doc_freq long, total long, commit long"
CONTENT = "doc_id long, content string, commit long"
TABLES = ("postings", "docs", "terms", "content", "removed", "staged")


@dataclass(frozen=True)
class Snapshot:
    commits: tuple[dict, ...]
    last: int

    @property
    def doc_count(self) -> int:
        return sum(c["docs"] for c in self.commits)

    @property
    def token_count(self) -> int:
        return sum(c["words"] for c in self.commits)


class Commit:
    """The folders of a commit that isn't published yet."""

    def __init__(self, store: Store, number: int):
        self.store, self.id, self.part = store, number, uuid.uuid4().hex

    def path(self, table: str) -> str:
        return self.store.path(table, {"id": self.id, "part": self.part})

    def publish(self, **entry) -> None:
        self.store.publish({"id": self.id, "part": self.part, **entry})

    def discard(self, *tables: str) -> None:
        for table in tables or TABLES:
            self.store.files.delete(self.path(table))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self._read: dict[int, dict] = {}

    def _entry(self, number: int) -> dict:
        if number not in self._read:
            found = json.loads(self.files.read(self.files.path("log", f"{number:012d}.json")))
            if found.get("format_version") != VERSION:
                raise FatalError("the index was written in another format")
            self._read[number] = found
        return self._read[number]

    def snapshot(self) -> Snapshot:
        """All commits so far; FatalError where the log is not of this format.

        Reads only entries that it hasn't read, from the last compaction known on.
        """
        hint = self.files.path("log", "_compacted")
        start = self.files.read(hint).strip() if self.files.exists(hint) else ""
        start = int(start) if start.isdigit() else 0
        numbers = [int(n[:-5]) for n in self.files.names(self.files.path("log")) if n.endswith(".json")]
        live: dict[int, dict] = {}
        for number in (n for n in numbers if n >= start):
            entry = self._entry(number)
            for gone in entry.get("replaces", ()):
                live.pop(gone, None)
            live[number] = entry
        return Snapshot(tuple(live[n] for n in sorted(live)), max(numbers, default=0))

    def begin(self, s: Snapshot) -> Commit:
        return Commit(self, s.last + 1)

    def publish(self, entry: dict) -> None:
        """Add a commit to the log; ExistsError if another writer took its number."""
        text = json.dumps({"format_version": VERSION, **entry})
        if not self.files.write_new(self.files.path("log", f"{entry['id']:012d}.json"), text):
            raise ExistsError(f"commit {entry['id']} was taken by another writer")
        if "replaces" in entry:
            self.files.write(self.files.path("log", "_compacted"), str(entry["id"]))

    def vacuum(self, seconds: float) -> None:
        """Delete what no entry in use names and what is older than so many seconds.

        Readers of older snapshots and writers under way must be younger than that.
        """
        s, before = self.snapshot(), (time.time() - seconds) * 1000
        used = {c["part"] for c in s.commits}
        for table in TABLES:
            for commit, _ in self.files.children(self.files.path(table)):
                for part, changed in self.files.children(self.files.path(table, commit)):
                    if part.removeprefix("part=") not in used and changed <= before:
                        self.files.delete(self.files.path(table, commit, part))
        live = {c["id"] for c in s.commits}
        for name, changed in self.files.children(self.files.path("log")):  # oldest first, as a later entry may replace them
            if name.endswith(".json") and int(name[:-5]) <= s.last and int(name[:-5]) not in live and changed <= before:
                self.files.delete(self.files.path("log", name))

    def path(self, table: str, entry: dict) -> str:
        return self.files.path(table, f"commit={entry['id']}", f"part={entry['part']}")

    def _table(self, table: str, schema: str, commits: list[dict]) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.option("basePath", self.files.path(table)).schema(schema).parquet(*[self.path(table, c) for c in commits])
        return found.drop("part")

    def _adds(self, s: Snapshot) -> list[dict]:
        return [c for c in s.commits if c["kind"] != "remove"]

    def _visible(self, df: DataFrame, s: Snapshot) -> DataFrame:
        gone = [c for c in s.commits if c["kind"] == "remove"]
        if not gone:
            return df
        r = self._table("removed", REMOVED, gone).select(F.col("doc_id").alias("gone_id"), F.col("commit").alias("gone_at"))
        return df.join(r, (df["doc_id"] == r["gone_id"]) & (df["commit"] < r["gone_at"]), "left_anti")

    def postings(self, s: Snapshot, terms: list[str] | None = None) -> DataFrame:
        """Live postings, of the given terms only if there are any given."""
        df = self._table("postings", POSTINGS, self._adds(s))
        return self._visible(df if terms is None else df.where(F.col("term").isin(terms)), s).drop("commit")

    def docs(self, s: Snapshot) -> DataFrame:
        """(doc_id, doc_len) of live documents."""
        return self._visible(self._table("docs", DOCS, self._adds(s)), s).select("doc_id", "doc_len")

    def content(self, s: Snapshot) -> DataFrame:
        kept = [c for c in s.commits if c.get("content")]
        return self._visible(self._table("content", CONTENT, kept), s).drop("commit")

    def terms(self, s: Snapshot) -> DataFrame:
        """(term, doc_freq, total) of every term ever added; removed ones stay, with zeros."""
        return self._table("terms", TERMS, list(s.commits)).groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total").alias("total"))
