"""Registered queries over the test tables, each with the SQL that gives the same result.

The search queries run on an index, built once for each session and folder of tables and kept in the shared
folder. Document ids of the tables start at 0 and those of the engine at 1, hence the ``+ 1``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.engine import Engine, Index, results_to_json
from millstone.functions.text import STOPWORDS, normalize, simple_words
from millstone.operators import fuzzy
from millstone.operators.analysis import HEADER, analyze
from millstone.plans import query_lang
from millstone.plans.search_plan import LIMIT
from millstone.sources.fs import shared_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BENCH = ["index_build", "entry_bm25", "corpus_stats", "term_stats", "postings", "bm25_or", "bool_and", "bool_nested", "fuzzy_candidates", "fuzzy_search", "remove_docs", "stopword_filter", "content_fetch"]
ALL = 2**31 - 1  # more results than there are documents

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOPWORDS["en"]))
_TOKENS = r"""tok as (select doc_id + 1 as doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from documents)"""
_POSTINGS = _TOKENS + ", p as (select doc_id, term, count(*) as tf from tok group by all), dd as (select doc_id, sum(tf) as dl from p group by 1), st as (select count(*) as n, sum(dl)::bigint as tc from dd), df as (select term, count(*) as df, sum(tf) as total from p group by 1)"
_BM25 = "ln(tf+1)/(ln(tf+1)+1.2*(0.25+0.75*dl/(tc//n))) * ln((n-df+0.5)/(df+0.5)+1)"
_TFIDF = "ln(tf+1) * (ln(n/df) + 1)"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("doc_id"), "text")


def build(spark: SparkSession, sf_dir: str, store: bool = False, **params) -> Index:
    """A new index of all documents that the filters leave a token of, in a folder of its own."""
    base = f"{shared_root(spark)}/search-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    index = Engine(spark, base).create_index("documents", {"tokenizer": "simple", "filters": []} | params)
    index.add_documents(docs(spark, sf_dir), store, skip_empty=True)
    return index


_built: dict[tuple, Index] = {}


def index_of(spark: SparkSession, sf_dir: str, *filters: str) -> Index:
    """The index of all documents with these filters, built at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, filters)
    if key not in _built or not _built[key].engine.files.is_dir(_built[key].store.files.root):
        _built[key] = build(spark, sf_dir, store=not filters, filters=list(filters))
    return _built[key]


def _scores(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.round("score", 6).alias("score"))


def _search(query: str, algo: str = "BM25", limit: int | None = None):
    return lambda spark, sf_dir: _scores(index_of(spark, sf_dir).search(query, algo, limit or ALL, fuzzymatch=False))


def _condition(node) -> str:
    if isinstance(node, query_lang.Leaf):
        return f"bool_or(term = '{node.value}')"
    a, b = _condition(node.left), _condition(node.right)
    return f"({a} {'or' if node.op == 'OR' else 'and'} {'not ' if node.op == 'NOT' else ''}{b})"


def _search_sql(query: str, formula: str = _BM25, tail: str = "") -> str:
    tree = query_lang.parse(query)
    terms = ", ".join(f"'{t}'" for t in dict.fromkeys(query_lang.leaves(tree)))
    return f"with {_POSTINGS} select doc_id, round(sum({formula}), 6) as score from p join dd using (doc_id) join df using (term), st where term in ({terms}) group by doc_id having {_condition(tree)} {tail}"


def _register_search(name: str, query: str, algo: str = "BM25", limit: int | None = None) -> None:
    # with a limit, ranks are by the exact score and then by doc_id, so the cut is at the same place
    formula = _BM25 if algo == "BM25" else _TFIDF
    tail = f"order by sum({formula}) desc, doc_id limit {limit}" if limit else ""
    register(name, _search_sql(query, formula, tail))(_search(query, algo, limit))


_register_search("entry_bm25", "the AND of", limit=10)
_register_search("bm25_single_term", "the")
_register_search("tfidf_single_term", "the", "TF-IDF")
_register_search("bm25_or", "the OR of OR und OR les")
_register_search("tfidf_or", "the of und les", "TF-IDF")
_register_search("bool_and", "the AND of AND in")
_register_search("bool_or", "der | die | das")
_register_search("bool_and_not", "the AND NOT 'and'")
_register_search("bool_nested", "(the AND of) OR (the AND NOT 'and')")
_register_search("bool_grouped", "(the OR der OR les) AND (token OR trash OR idiot) AND NOT (clown OR scum)")
_register_search("score_includes_not_terms", "token OR (the AND NOT of)")
_register_search("topk_limit", "the OR 'and'", "TF-IDF", 25)
_register_search("unknown_term", "nonexistentterm OR idiot")
_register_search("unknown_term_empty", "nonexistentterm AND the")


@register("index_build", f"with {_POSTINGS} select n as doc_count, tc::bigint as token_count, (select count(*) from p) as n_postings, (select count(*) from df) as n_terms from st")
def index_build(spark, sf_dir):
    """Sizes of an index that is built from all documents."""
    index = build(spark, sf_dir)
    counts = index.terms().agg(F.lit(index.doc_count).cast("long").alias("doc_count"), F.lit(index.token_count).cast("long").alias("token_count"), F.count("*").alias("n_terms"))
    return counts.crossJoin(index.postings().agg(F.count("*").alias("n_postings")))


@register("postings", f"with {_POSTINGS} select doc_id, term, tf, dl::bigint as doc_len from p join dd using (doc_id)")
def all_postings(spark, sf_dir):
    return index_of(spark, sf_dir).postings()


@register("doc_lengths", f"with {_TOKENS} select doc_id, count(*) as doc_len from tok group by 1")
def doc_lengths(spark, sf_dir):
    return index_of(spark, sf_dir).documents()


@register("term_stats", f"with {_POSTINGS} select term, df as doc_freq, total::bigint as total from df")
def term_stats(spark, sf_dir):
    return index_of(spark, sf_dir).terms()


@register("corpus_stats", f"with {_POSTINGS} select n as doc_count, tc as token_count, tc // n as mean_len from st")
def corpus_stats(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return spark.createDataFrame([(index.doc_count, index.token_count, index.token_count // index.doc_count)], "doc_count long, token_count long, mean_len long")


@register("stopword_filter", f"with {_TOKENS} select term, count(*) as total from tok where term not in ({STOP}) group by 1")
def stopword_filter(spark, sf_dir):
    return index_of(spark, sf_dir, "stopwords").terms().select("term", "total")


@register("stopword_query", _search_sql("idiot").replace("as term from documents)", f"as term from documents), tok as (select * from tok0 where term not in ({STOP}))").replace("tok as (select doc_id + 1", "tok0 as (select doc_id + 1"))
def stopword_query(spark, sf_dir):
    """A value that the stopword filter discards matches nothing and adds nothing to a score."""
    return _scores(index_of(spark, sf_dir, "stopwords").search("the OR idiot", limit=ALL, fuzzymatch=False))


@register("stopword_query_empty", f"with {_TOKENS} select doc_id, 0.0::double as score from tok where term in ('the', 'idiot') and term not in ({STOP}) group by 1 having bool_or(term = 'the') and bool_or(term = 'idiot')")
def stopword_query_empty(spark, sf_dir):
    """Where such a value must hold, nothing does."""
    return _scores(index_of(spark, sf_dir, "stopwords").search("the AND idiot", limit=ALL, fuzzymatch=False))


VALUES = ["tehh", "oneor", "undd", "idoit", "clwn", "tokn", "zzzzzzzz"]
_VALUES_SQL = "q as (select unnest([" + ", ".join(f"'{v}'" for v in VALUES) + "]) as value)"
_NEAR_SQL = "c as (select value, term, total::bigint as total, levenshtein(value, term) as distance from q join df on abs(strlen(value) - strlen(term)) <= 2 where levenshtein(value, term) <= 2)"


def _near(spark, sf_dir):
    return fuzzy.candidates(VALUES, index_of(spark, sf_dir).terms())


@register("fuzzy_candidates", f"with {_POSTINGS}, {_VALUES_SQL}, {_NEAR_SQL} select value, term, total, distance::int as distance from c")
def fuzzy_candidates(spark, sf_dir):
    return _near(spark, sf_dir)


@register("fuzzy_best_term", f"with {_POSTINGS}, {_VALUES_SQL}, {_NEAR_SQL} select value, term from (select *, row_number() over (partition by value order by total desc, term) as r from c) where r = 1")
def fuzzy_best_term(spark, sf_dir):
    return fuzzy.best(_near(spark, sf_dir))


@register(
    "fuzzy_search",
    f"with {_POSTINGS}, q as (select 'idoit' as value), {_NEAR_SQL}, b as (select term from c order by total desc, term limit 1) "
    f"select doc_id, round({_BM25}, 6) as score from p join b using (term) join dd using (doc_id) join df using (term), st",
)
def fuzzy_search(spark, sf_dir):
    """A value that is no term is searched as the most frequent term within two edits."""
    return _scores(index_of(spark, sf_dir).search("idoit", limit=ALL))


PAIRS = [("kitten", "sitten"), ("sitting", "kitten"), ("cat", "cactus"), ("", "a"), ("aabcc", "bccdd"), ("ABCDEF", "abcdef"), ("levenshtein", "frankenstein"), ("é", "e"), ("123456789", "101010101")]


@register("levenshtein_pairs", "select a, b, levenshtein(a, b)::int as distance from (values " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") t(a, b)")
def levenshtein_pairs(spark, sf_dir):
    return spark.createDataFrame(PAIRS, "a string, b string").withColumn("distance", fuzzy.byte_levenshtein(F.col("a"), F.col("b")))


@register("levenshtein_parts", "select p_partkey, levenshtein(p_brand, p_type)::int as distance from part")
def levenshtein_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fuzzy.byte_levenshtein(F.col("p_brand"), F.col("p_type")).alias("distance"))


_LIVE_SQL = _POSTINGS.replace("from documents)", "from documents where doc_id not in (select doc_id from labels where toxic = 1))")


def _toxic(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select((F.col("doc_id") + 1).alias("doc_id"))
    return docs(spark, sf_dir).join(toxic, "doc_id", "left_semi")


@register("remove_docs", _search_sql("the OR idiot").replace(_POSTINGS, _LIVE_SQL))
def remove_docs(spark, sf_dir):
    """Scores after removing all toxic documents: statistics are those of what is left."""
    index = build(spark, sf_dir)
    index.remove_documents(_toxic(spark, sf_dir).join(index.documents(), "doc_id", "left_semi"))
    return _scores(index.search("the OR idiot", limit=ALL, fuzzymatch=False))


@register("readd_docs", _search_sql("the OR idiot"))
def readd_docs(spark, sf_dir):
    """Removed, added again and compacted: as if nothing had happened."""
    index = build(spark, sf_dir)
    index.remove_documents(_toxic(spark, sf_dir).join(index.documents(), "doc_id", "left_semi"))
    index.add_documents(_toxic(spark, sf_dir), skip_empty=True)
    index.compact()
    index.vacuum(0)
    return _scores(index.search("the OR idiot", limit=ALL, fuzzymatch=False))


@register("duplicate_doc_check", "select doc_id + 1 as doc_id from labels where doc_id in (select doc_id from documents)")
def duplicate_doc_check(spark, sf_dir):
    """Ids of a second batch (those of the labels) that are indexed already."""
    batch = table(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("doc_id"))
    return batch.join(index_of(spark, sf_dir).documents(), "doc_id", "left_semi")


@register("empty_doc_check", f"with {_TOKENS} select doc_id + 1 as doc_id from documents where doc_id + 1 not in (select doc_id from tok where term in ('the', 'der', 'les'))")
def empty_doc_check(spark, sf_dir):
    """Documents of which a filter leaves no token."""
    found = analyze(docs(spark, sf_dir), simple_words(F.col("text")), lambda word: word if word in ("the", "der", "les") else None)
    return found.where((F.col("term") == HEADER) & (F.col("doc_len") == 0)).select("doc_id")


@register("results_json", f"with {_POSTINGS}, r as (select doc_id, {_TFIDF} as score from p join df using (term), st where term = 'idiot' order by score desc, doc_id limit 5) select doc_id, round(score, 6) as score, row_number() over (order by r.score desc, doc_id) as place, (select count(*) from r) as n from r")
def results_json(spark, sf_dir):
    """The rows and the count of a JSON response, in rank order."""
    import json

    found = json.loads(results_to_json(index_of(spark, sf_dir).search("idiot", "TF-IDF", 5)))
    rows = [(r["doc_id"], round(r["score"], 6), i + 1, found["count"]) for i, r in enumerate(found["results"])]
    return spark.createDataFrame(rows, "doc_id long, score double, place long, n long")


@register("content_fetch", f"with {_POSTINGS}, r as (select doc_id, {_BM25} as score from p join dd using (doc_id) join df using (term), st where term = 'idiot' order by score desc, doc_id limit {LIMIT}) select r.doc_id, round(score, 6) as score, d.text as content from r join documents d on d.doc_id + 1 = r.doc_id")
def content_fetch(spark, sf_dir):
    return index_of(spark, sf_dir).search("idiot", fetch=True).select("doc_id", F.round("score", 6).alias("score"), "content")


@register("part_name_terms", r"with tok as (select p_partkey + 1 as doc_id, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+')) as term from part), p as (select doc_id, term, count(*) as tf from tok group by all) select term, count(*) as doc_freq, sum(tf)::bigint as total from p group by 1")
def part_name_terms(spark, sf_dir):
    d = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("doc_id"), F.col("p_name").alias("text"))
    found = analyze(d, simple_words(F.col("text")), lambda word: word).where(F.col("term") != HEADER)
    return found.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("total"))


@register("conversation_lengths", r"select conv_id * 1000 + turn + 1 as doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::bigint as doc_len from conversations")
def conversation_lengths(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("doc_id"), F.size(simple_words(F.col("text"))).cast("long").alias("doc_len"))


@register("case_mapping", "select p_partkey, lower(p_name) as low, upper(p_name) as high from part")
def case_mapping(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("low"), F.upper("p_name").alias("high"))


@register("normalized_terms", f"with {_TOKENS} select strip_accents(replace(term, 'ß', 'ss')) as term, count(*) as total from tok group by 1")
def normalized_terms(spark, sf_dir):
    """Term counts after normalization, which runs once for each distinct term."""
    found = analyze(docs(spark, sf_dir), simple_words(F.col("text")), normalize)
    return found.where(F.col("term") != HEADER).groupBy("term").agg(F.sum("tf").alias("total"))


@register("stemmed_terms")
def stemmed_terms(spark, sf_dir):
    """Term counts of the default English pipeline over word segments: the terms table of a default index."""
    base = build(spark, sf_dir, tokenizer="words", filters=["normalizer", "stopwords", "stemmer"], lang="en")
    return base.terms()
