"""The engine: indexes under a base directory, and what can be done with one."""

from __future__ import annotations

import importlib.util
import json
import logging
import os
import re
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.errors import ExistsError, InvalidError, LimitError, MissingError
from millstone.functions import text
from millstone.operators import analysis, fuzzy
from millstone.operators.analysis import HEADER
from millstone.operators.ranking import algorithm
from millstone.params import Params
from millstone.plans import query_lang, search_plan
from millstone.sources.fs import Files
from millstone.sources.index_store import Commit, Store

BASE_DIR_VARIABLE = "MILLSTONE_BASEDIR"
FILTER_DIR_VARIABLE = "MILLSTONE_FILTERDIR"
LOG_VARIABLE = "MILLSTONE_LOG_LEVEL"
LEVELS = {"CRITICAL": 50, "ERROR": 40, "WARNING": 30, "NOTICE": 25, "INFO": 20, "DEBUG": 10}
RANGE_ROWS = 5_000_000  # postings that a task sorts, about 450 MB
MAX_SENT = 1 << 20  # ids that are sent to all executors
DEFAULT_FILTERS = ["normalizer", "stopwords", "stemmer"]
log = logging.getLogger("millstone")


def log_level(name: str | None) -> int:
    """The level of a name in any case; NOTICE where it is no level."""
    return LEVELS.get((name or "").upper(), LEVELS["NOTICE"])


def _name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name or ""):
        raise InvalidError("invalid index name")
    return name


class Engine:
    def __init__(self, spark: SparkSession, base_dir: str | None = None, filter_dir: str | None = None):
        base = base_dir or os.environ.get(BASE_DIR_VARIABLE)
        if not base:
            raise InvalidError("no base directory")
        log.setLevel(log_level(os.environ.get(LOG_VARIABLE)))
        self.spark, self.files = spark, Files(spark, base)
        if not self.files.is_dir(self.files.root):
            raise MissingError(f"base directory {base} does not exist")
        self.files.mkdirs(self.files.path("data"))
        words = {lang: self.files.read(self.files.path("filters", "stopwords", lang)).splitlines() for lang in self.files.names(self.files.path("filters", "stopwords"))}
        self.registry = text.Registry({lang: frozenset(w for w in found if w) for lang, found in words.items()})
        self._open: dict[str, Index] = {}
        if filter_dir := filter_dir or os.environ.get(FILTER_DIR_VARIABLE):
            self.load_filters(filter_dir)

    def close(self) -> None:
        for index in list(self._open.values()):
            index.close()

    def register_filter(self, name: str, filter: Callable, create: Callable[[Mapping], object] | None = None, destroy: Callable[[object], None] | None = None) -> None:
        """A token filter: ``filter(context, token)`` gives a token, or None to discard; raising fails the call.

        ``create(params)`` makes the context of an index, and ``destroy(context)`` ends it when the index is closed.
        """
        self.registry.register(name, filter, create, destroy)

    def load_filters(self, folder: str) -> None:
        """Register the filters of a local folder, whose Python files are trusted and run.

        Each file defines ``filter(context, token)``, and may define ``create(params)`` and
        ``destroy(context)``; the file's name is the filter's.
        """
        for path in sorted(Path(folder).glob("*.py")):
            # outside of sys.modules, so that its functions travel to the executors by value
            spec = importlib.util.spec_from_file_location(f"filter_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            self.register_filter(path.stem, getattr(module, "filter", None), getattr(module, "create", None), getattr(module, "destroy", None))

    def _root(self, name: str) -> str:
        return self.files.path("data", _name(name))

    def create_index(self, name: str, params: Mapping | None = None) -> Index:
        """Make and open an index; defaults: filters normalizer, stopwords, stemmer; algo BM25; lang en."""
        root = self._root(name)
        full = Params({"filters": DEFAULT_FILTERS, "algo": "BM25", "lang": "en"} | dict(params or {}))
        if not re.fullmatch(r"[a-z]{2}", full.get_str("lang") or ""):
            raise InvalidError("invalid language")
        if full.get_strlist("filters") is None:
            raise InvalidError("filters must be a list of names")
        algorithm(full.get("algo"))
        self.registry.pipeline(full["filters"], full).close()
        if self.files.exists(root):
            raise ExistsError(f"index '{name}' already exists")
        self.files.mkdirs(root)
        if not self.files.write_new(f"{root}/params.json", full.to_json()):
            raise ExistsError(f"index '{name}' already exists")
        return self.open_index(name)

    def open_index(self, name: str) -> Index:
        root = self._root(name)
        if name in self._open:
            raise ExistsError(f"index '{name}' is already open")
        if not self.files.exists(f"{root}/params.json"):
            raise MissingError(f"index '{name}' does not exist")
        params = Params.from_json(self.files.read(f"{root}/params.json"))
        index = Index(self, name, root, params)
        self._open[name] = index
        return index

    def destroy_index(self, name: str) -> None:
        root = self._root(name)
        if not self.files.exists(f"{root}/params.json"):
            raise MissingError(f"index '{name}' does not exist")
        if name in self._open:
            self._open[name].close()
        self.files.delete(root)


class Index:
    def __init__(self, engine: Engine, name: str, root: str, params: Params):
        self.engine, self.name, self.params = engine, name, params
        self.spark, self.store = engine.spark, Store(engine.spark, root)
        algorithm(params.get("algo"))
        self.lang = params.get_str("lang") or "en"
        self.pipeline = engine.registry.pipeline(params.get_strlist("filters") or [], params)
        self.store.snapshot()

    def close(self) -> None:
        if self.engine._open.pop(self.name, None):
            self.pipeline.close()

    @property
    def doc_count(self) -> int:
        return self.store.snapshot().doc_count

    @property
    def token_count(self) -> int:
        return self.store.snapshot().token_count

    def words(self, column: str = "text"):
        """The unfiltered words of a text column, by this index' tokenizer."""
        return text.simple_words(F.col(column)) if self.params.get_str("tokenizer") == "simple" else text.word_segments(F.col(column), self.lang)

    # ---- writing ------------------------------------------------------------------------------------

    def add(self, doc_id: int, content: str, store: bool = False) -> None:
        self.add_documents(self.spark.createDataFrame([(doc_id, content)], "doc_id long, text string"), store)

    def add_documents(self, docs: DataFrame, store: bool = False, skip_empty: bool = False) -> None:
        """Add (doc_id, text) as one commit, all or nothing; with ``store`` the texts are kept as well.

        InvalidError for an id that is null or below 1, ExistsError for one that is repeated or indexed
        already, LimitError for an overlong token, MissingError for a text without a token; with
        ``skip_empty`` such texts are left out instead.
        """
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        s = self.store.snapshot()
        commit = self.store.begin(s)
        try:
            # texts are analysed once, where they are; what follows moves only postings
            analysis.analyze(docs, self.words(), self.pipeline).write.parquet(commit.path("staged"))
            staged = self.spark.read.schema(analysis.POSTINGS).parquet(commit.path("staged"))
            heads = staged.where(F.col("term") == HEADER)
            entry, empty = self._checked(heads, s, skip_empty)
            if not entry["docs"] and skip_empty:
                return commit.discard()
            heads.where("doc_len > 0").select("doc_id", "doc_len").sortWithinPartitions("doc_id").write.parquet(commit.path("docs"))
            rows = staged.where(F.col("term") != HEADER)
            self._write_postings(rows, staged.count(), commit)
            self._write_terms(rows.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("total")), commit)
            if store:
                kept = docs.select("doc_id", F.col("text").alias("content"))
                if empty:  # few as a rule; texts move only where these are too many to be sent to all
                    none = heads.where("doc_len = 0").select("doc_id")
                    kept = kept.join(F.broadcast(none) if empty <= MAX_SENT else none, "doc_id", "left_anti")
                kept.write.parquet(commit.path("content"))
            commit.publish(kind="add", content=store, **entry)
        except Exception:
            commit.discard()
            raise
        commit.discard("staged")
        log.info("index %s: commit %d adds %d documents", self.name, commit.id, entry["docs"])

    def _checked(self, heads: DataFrame, s, skip_empty: bool) -> tuple[dict, int]:
        """Counts of a commit, after the checks that need them; the number of texts without a token."""
        per = heads.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("doc_len").alias("doc_len"), F.max("tf").alias("over"))
        found = per.agg(
            F.expr("count_if(doc_len > 0) as docs"), F.sum("doc_len").alias("words"), F.min(F.when(F.col("n") > 1, F.col("doc_id"))).alias("twice"),
            F.expr("count_if(doc_len = 0) as empty"), F.max("over").alias("over"), F.expr("count_if(doc_id is null or doc_id < 1) as bad"),
        ).first()
        if found["bad"]:
            raise InvalidError("document ID must be a positive number")
        if found["over"]:
            raise LimitError(f"term too long ({found['over']})")
        known = found["twice"]
        if known is None and s.doc_count:
            clash = heads.select("doc_id").join(self.store.docs(s), "doc_id", "left_semi").agg(F.min("doc_id")).first()
            known = clash[0]
        if known is not None:
            raise ExistsError(f"document {known} is already indexed")
        if found["empty"] and not skip_empty:
            raise MissingError("the text is empty or no meaningful tokens found")
        return {"docs": found["docs"], "words": found["words"] or 0}, found["empty"]

    def _write_postings(self, rows: DataFrame, n: int, commit: Commit) -> None:
        """In ranges of (term, doc_id), so that a term of most documents spreads over many tasks.

        As many ranges as the session has shuffle partitions, or more where those would be too large to sort in memory.
        """
        least = -(-n // RANGE_ROWS)
        ranges = [least] if least > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else []
        rows.select("term", "doc_id", "tf", "doc_len").repartitionByRange(*ranges, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(commit.path("postings"))

    def _write_terms(self, terms: DataFrame, commit: Commit) -> None:
        terms.select("term", "doc_freq", "total").sortWithinPartitions("term").write.parquet(commit.path("terms"))

    def remove(self, doc_id: int) -> None:
        self.remove_documents(self.spark.createDataFrame([(doc_id,)], "doc_id long"))

    def remove_documents(self, ids: DataFrame) -> None:
        """Remove documents as one commit; MissingError if one of them isn't indexed."""
        s = self.store.snapshot()
        commit = self.store.begin(s)
        try:
            ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().write.parquet(commit.path("removed"))
            ids = self.spark.read.schema("doc_id long").parquet(commit.path("removed"))
            live = self.store.docs(s)
            unknown = ids.join(live, "doc_id", "left_anti").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).first()
            if unknown["n"]:
                raise MissingError(f"document {unknown['id']} does not exist")
            gone = live.join(ids, "doc_id", "left_semi").agg(F.count("*").alias("docs"), F.sum("doc_len").alias("words")).first()
            lost = self.store.postings(s).join(ids, "doc_id", "left_semi").groupBy("term").agg((-F.count("*")).alias("doc_freq"), (-F.sum("tf")).alias("total"))
            self._write_terms(lost, commit)
            commit.publish(kind="remove", docs=-gone["docs"], words=-(gone["words"] or 0))
        except Exception:
            commit.discard()
            raise

    def compact(self) -> None:
        """Rewrite all commits as one, without what is removed; terms of removed documents stay known.

        The new entry takes the place of the old ones in one step. Their files stay for searches under way
        until ``vacuum``.
        """
        s = self.store.snapshot()
        if len(s.commits) < 2:
            return
        commit = self.store.begin(s)
        try:
            self.store.docs(s).sortWithinPartitions("doc_id").write.parquet(commit.path("docs"))
            live = self.store.terms(s).agg(F.sum("doc_freq")).first()[0]
            self._write_postings(self.store.postings(s), live or 0, commit)
            self._write_terms(self.store.terms(s), commit)
            content = any(c.get("content") for c in s.commits)
            if content:
                self.store.content(s).write.parquet(commit.path("content"))
            commit.publish(kind="compact", content=content, docs=s.doc_count, words=s.token_count, replaces=[c["id"] for c in s.commits])
        except Exception:
            commit.discard()
            raise

    def vacuum(self, seconds: float = 86_400) -> None:
        """Delete files that no commit in use names and that are older than so many seconds."""
        self.store.vacuum(seconds)

    # ---- reading ------------------------------------------------------------------------------------

    def terms(self) -> DataFrame:
        return self.store.terms(self.store.snapshot())

    def postings(self) -> DataFrame:
        return self.store.postings(self.store.snapshot())

    def documents(self) -> DataFrame:
        return self.store.docs(self.store.snapshot())

    def resolve(self, values: list[str], s, fuzzymatch: bool) -> dict[str, str]:
        """Index terms of filtered values: the value itself if it is a term, else the best near one."""
        terms = self.store.terms(s)
        found = {v: v for (v,) in terms.where(F.col("term").isin(values)).select("term").collect()} if values else {}
        rest = [v for v in values if v not in found]
        if rest and fuzzymatch:
            near = fuzzy.candidates(rest, terms)
            found |= {r["value"]: r["term"] for r in fuzzy.best(near).collect()}
        return found

    def search(self, query: str, algo: str | None = None, limit: int = search_plan.LIMIT, fuzzymatch: bool = True, fetch: bool = False) -> DataFrame:
        """(doc_id, score) of the best documents, best first; with ``fetch`` also their stored content."""
        algo = algo or self.params.get("algo")
        algorithm(algo)
        search_plan.check_limit(limit)
        tree = query_lang.parse(query)
        s = self.store.snapshot()
        token = {v: self.pipeline(v) for v in query_lang.leaves(tree)}
        term = self.resolve(sorted({t for t in token.values() if t}), s, fuzzymatch)
        of_value = {v: term[t] for v, t in token.items() if t in term}
        tokens = [term[t] for t in dict.fromkeys(token.values()) if t in term]
        postings = self.store.postings(s, sorted(set(tokens)))
        df = {r["term"]: r["doc_freq"] for r in self.store.terms(s).where(F.col("term").isin(tokens)).collect()} if tokens else {}
        found = search_plan.ranked(postings, tree, of_value, tokens, df, s.doc_count, s.token_count, algo, limit)
        if fetch:
            found = found.join(self.store.content(s), "doc_id", "left").orderBy(F.desc("score"), "doc_id")
        return found


def results_to_json(results: DataFrame) -> str:
    """The response text: results in rank order, then their count."""
    rows = [r.asDict() for r in results.collect()]
    return json.dumps({"results": rows, "count": len(rows)}, separators=(",", ":"), ensure_ascii=False)
