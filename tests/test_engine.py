import math
import random

import pytest
from pyspark.sql import functions as F

from millstone.engine import Engine, log_level, results_to_json
from millstone.errors import ExistsError, FatalError, InvalidError, LimitError, MissingError
from millstone.params import Params
from millstone.streaming.ingest import ingest

DOCS = "doc_id long, text string"


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    yield e
    e.close()


def filled(engine, docs, name="t", **params):
    index = engine.create_index(name, params or {"filters": ["normalizer", "stemmer"]})
    index.add_documents(engine.spark.createDataFrame(docs, DOCS))
    return index


def found(results):
    return {r["doc_id"]: r["score"] for r in results.collect()}


TWO = [(1, "The quick brown fox jumped over the lazy dog"), (2, "Once upon a time there were three little foxes")]
GOLDEN = [
    (TWO, "dog", {1: (1.1736, 0.253785)}),
    (TWO, "fox", {1: (0.693147, 0.066754), 2: (0.693147, 0.066754)}),
    (TWO, "fox dog", {1: (1.866747, 0.320539), 2: (0.693147, 0.066754)}),
    ([(1, "cat dog rat"), (2, "cat cat dog")], "cat", {1: (0.693147, 0.066754), 2: (1.098612, 0.087140)}),
    ([(1, "cat cat dog dog"), (2, "dog dog cat cat"), (3, "cat dog rat cow"), (4, "cat dog rat bat")], "cat dog rat cow", {1: (2.197225, 0.100713), 2: (2.197225, 0.100713), 3: (4.213948, 0.771754), 4: (2.559895, 0.330938)}),
    ([(1, " ".join(["aa"] * 20)), (2, " ".join(["aa"] * 10 + ["bb"] * 10)), (3, " ".join(["aa"] + ["bb"] * 19))], "aa", {1: (3.044523, 0.095780), 2: (2.397895, 0.088995), 3: (0.693147, 0.048890)}),
    ([(1, "This is a very long document about the cats All kind of cats including the tabby and other cats"), (2, "cats cats cats"), (3, "cats cats dogs")], "cats", {1: (1.386294, 0.048411), 2: (1.386294, 0.091469), 3: (1.098612, 0.084499)}),
]


@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_scores(engine, case):
    docs, query, want = GOLDEN[case]
    index = filled(engine, docs)
    for i, algo in enumerate(("TF-IDF", "bm25")):
        got = found(index.search(query, algo=algo))
        assert got.keys() == want.keys()
        for k in want:
            assert math.isclose(got[k], want[k][i], abs_tol=1e-4)


BOOLEAN = [
    (1, "Textbook about Erlang in Linux environment"), (2, "Unix Shell scripting textbook"), (3, "Erlang and Python examples"), (4, "Textbook about Python using Linux and Windows"),
    (5, "All but NOT: Textbook Erlang Python Shell Linux Unix Java"), (6, "All keywords: Textbook Erlang Python Shell Linux Unix"),
]


def test_boolean_logic(engine):
    index = filled(engine, BOOLEAN)
    assert found(index.search("non-existant-term")) == {}
    assert set(found(index.search("unix"))) == {2, 5, 6}
    assert set(found(index.search("textbook AND (Erlang OR Python OR Shell) AND (Linux OR Unix) AND NOT (Windows OR Java)"))) == {1, 2, 6}
    assert found(index.search("unix AND qqqqqqqq")) == {}
    assert set(found(index.search("unix OR qqqqqqqq"))) == {2, 5, 6}


def test_terms_of_other_branches_score(engine):
    index = filled(engine, [(1, "a c"), (2, "a b"), (3, "d")])
    both = found(index.search("a OR (b AND NOT c)", fuzzymatch=False))
    alone = found(index.search("a", fuzzymatch=False))
    assert both[1] > alone[1] and both[2] > alone[2]


def test_fuzzy_terms_score_per_token(engine):
    index = filled(engine, [(1, "cat dog"), (2, "dog")])
    assert math.isclose(found(index.search("cat caat"))[1], 2 * found(index.search("cat"))[1], rel_tol=1e-9)
    assert found(index.search("caat", fuzzymatch=False)) == {}


def test_stopwords(engine):
    index = filled(engine, [(1, "the cat and the hat"), (2, "a dog")], lang="en")
    assert index.token_count == 3
    assert found(index.search("the AND cat")) == {}
    assert set(found(index.search("the OR cat"))) == {1}


def test_lifecycle_errors(engine, spark):
    index = engine.create_index("t")
    with pytest.raises(ExistsError):
        engine.create_index("t")
    with pytest.raises(ExistsError):
        engine.open_index("t")
    with pytest.raises(MissingError):
        engine.open_index("other")
    for bad in ("a/b", "..", ".", "/", ""):
        for call in (engine.create_index, engine.destroy_index, engine.open_index):
            with pytest.raises(InvalidError):
                call(bad)
    for params in ({"algo": "none"}, {"lang": "english"}, {"filters": ["nope"]}, {"filters": "x"}):
        with pytest.raises(InvalidError):
            engine.create_index("u", params)
    with pytest.raises(InvalidError):
        index.add(0, "text")
    index.add(1, "some words here")
    with pytest.raises(ExistsError, match="document 1 is already indexed"):
        index.add(1, "again")
    with pytest.raises(ExistsError):
        index.add_documents(spark.createDataFrame([(7, "x1"), (7, "x2")], DOCS))
    for empty in ("", "  ...  ", None):
        with pytest.raises(MissingError):
            index.add(2, empty)
    with pytest.raises(MissingError):
        index.remove(99)
    for limit in (0, -1, 2**32, "5", True):
        with pytest.raises(InvalidError, match="invalid limit"):
            index.search("words", limit=limit)
    with pytest.raises(InvalidError):
        index.search("")
    with pytest.raises(InvalidError, match="invalid algorithm"):
        index.search("words", algo="x")
    assert (index.doc_count, index.token_count) == (1, 1)
    engine.destroy_index("t")
    with pytest.raises(MissingError):
        engine.destroy_index("t")
    assert engine.create_index("t").doc_count == 0


def test_term_length_limit(engine):
    index = engine.create_index("t", {"filters": [], "tokenizer": "simple"})
    index.add(1, "a" * 65535)
    with pytest.raises(LimitError, match=r"term too long \(65536\)"):
        index.add(2, "a" * 65536)
    assert index.doc_count == 1


def test_remove_readd_compact(engine, spark):
    index = filled(engine, [(i, "abc def ghi") for i in (1, 2, 3)])
    index.remove(2)
    assert (index.doc_count, index.token_count) == (2, 6)
    assert set(found(index.search("abc"))) == {1, 3}
    index.remove_documents(spark.createDataFrame([(1,), (3,)], "doc_id long"))
    assert found(index.search("abc")) == {} and index.doc_count == 0
    # a term whose documents are gone still resolves to itself
    index.add(4, "abd")
    assert found(index.search("abc")) == {}
    index.add(2, "abc abc")
    before = found(index.search("abc"))
    assert set(before) == {2}
    index.compact()
    assert found(index.search("abc")) == before and (index.doc_count, index.token_count) == (2, 3)
    index.close()
    again = engine.open_index("t")
    assert found(again.search("abc")) == before
    assert {r["term"]: r["total"] for r in again.terms().collect()} == {"abc": 2, "def": 0, "ghi": 0, "abd": 1}


def test_forward_index(engine):
    index = filled(engine, [(1001, "some-term another another"), (1002, "third")], tokenizer="simple", filters=[])
    rows = {(r["doc_id"], r["term"]): (r["tf"], r["doc_len"]) for r in index.postings().collect()}
    assert rows == {(1001, "some"): (1, 4), (1001, "term"): (1, 4), (1001, "another"): (2, 4), (1002, "third"): (1, 1)}
    assert {r["doc_id"]: r["doc_len"] for r in index.documents().collect()} == {1001: 4, 1002: 1}


def test_order_ties_and_limit(engine):
    index = filled(engine, [(1, "cat dog cow"), (2, "dog cow"), (3, "cat cat cat")])
    assert [r["doc_id"] for r in index.search("cat").collect()] == [3, 1]
    rng = random.Random(1)
    other = filled(engine, [(i, " ".join(["x"] * rng.randint(1, 5))) for i in range(1, 60)], name="ties")
    rows = [(r["doc_id"], r["score"]) for r in other.search("x").collect()]
    assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r["doc_id"], r["score"]) for r in other.search("x", limit=7).collect()] == rows[:7]


def test_json_and_content(engine, spark):
    index = engine.create_index("t", {"filters": []})
    index.add_documents(spark.createDataFrame([(1, "cat"), (2, "cat cat")], DOCS), store=True)
    assert [r["content"] for r in index.search("cat", algo="TF-IDF", fetch=True).collect()] == ["cat cat", "cat"]
    rows = spark.createDataFrame([(2, 3.0), (1, 1.5)], "doc_id long, score double").coalesce(1)
    assert results_to_json(rows) == '{"results":[{"doc_id":2,"score":3.0},{"doc_id":1,"score":1.5}],"count":2}'


def test_user_filter(engine):
    engine.register_filter("nofoo", lambda ctx, t: None if t == "foo" else t)
    index = filled(engine, [(1, "foo bar")], filters=["normalizer", "nofoo"])
    assert index.token_count == 1 and found(index.search("foo")) == {}
    engine.register_filter("fails", lambda ctx, t: 1 / 0)
    bad = engine.create_index("bad", {"filters": ["fails"]})
    with pytest.raises(Exception):
        bad.add(1, "word")
    assert bad.doc_count == 0


def test_params_and_levels():
    p = Params.from_json('{"a": "x", "n": 3, "b": true, "l": ["u", "v"], "f": -1}')
    assert (p.get_str("a"), p.get_uint("n"), p.get_bool("b"), p.get_strlist("l")) == ("x", 3, True, ["u", "v"])
    assert (p.get_str("n"), p.get_uint("b"), p.get_bool("n"), p.get_strlist("a"), p.get_uint("f")) == (None,) * 5
    assert Params.from_json(p.to_json()) == p
    for bad in ("{", "[1]"):
        with pytest.raises(InvalidError):
            Params.from_json(bad)
    assert log_level("debug") == 10 and log_level("nonsense") == log_level(None) == 25


def test_base_dir(spark, tmp_path, monkeypatch):
    with pytest.raises(MissingError):
        Engine(spark, str(tmp_path / "none"))
    monkeypatch.delenv("MILLSTONE_BASEDIR", raising=False)
    with pytest.raises(InvalidError):
        Engine(spark)
    monkeypatch.setenv("MILLSTONE_BASEDIR", str(tmp_path))
    Engine(spark).close()


def test_format_version(engine):
    index = filled(engine, [(1, "a b")])
    log = index.store.files.path("log", f"{9:012d}.json")
    index.store.files.write_new(log, '{"format_version": 99, "id": 9, "kind": "add", "docs": 0, "words": 0}')
    with pytest.raises(FatalError):
        index.search("a")


def test_snapshots_and_two_writers(engine):
    index = filled(engine, [(1, "a b")])
    before = index.store.snapshot()
    index.add(2, "a")
    assert index.store.docs(before).count() == 1 and index.doc_count == 2
    with pytest.raises(ExistsError, match="another writer"):
        index.store.publish({"id": 1, "part": "x", "kind": "add", "docs": 0, "words": 0})


def docs_of(spark, *rows):
    return spark.createDataFrame(list(rows), DOCS)


@pytest.mark.parametrize("when, loser", [("before", "add"), ("before", "remove"), ("before", "compact"), ("after", "compact")])
def test_writer_that_comes_second_changes_nothing(engine, spark, tmp_path, monkeypatch, when, loser):
    """Another writer publishes while a commit is written; whatever the loser wrote stays unseen."""
    index = filled(engine, [(1, "red fox"), (2, "blue fox")])
    index.add(3, "green fox")
    other = Engine(spark, str(tmp_path)).open_index("t")
    publish = index.store.publish

    def late(entry):
        monkeypatch.setattr(index.store, "publish", publish)
        if when == "before":
            other.add(5, "winning fox")
            publish(entry)
        else:
            publish({**entry, "part": entry["part"]})
            other.add(5, "winning fox")

    monkeypatch.setattr(index.store, "publish", late)
    calls = {"add": lambda: index.add(9, "losing fox"), "remove": lambda: index.remove(1), "compact": index.compact}
    ids = {1, 2, 3, 5}
    if when == "before":
        with pytest.raises(ExistsError, match="another writer"):
            calls[loser]()
    else:
        calls[loser]()
        ids = {"add": ids | {9}, "remove": ids - {1}, "compact": ids}[loser]
    for i in (index, other, Engine(spark, str(tmp_path)).open_index("t")):
        assert set(found(i.search("fox", fuzzymatch=False))) == ids and i.doc_count == len(ids)
        assert i.documents().count() == len(ids) and i.token_count == 2 * len(ids)
    index.vacuum(0)
    assert set(found(other.search("fox"))) == ids
    assert set(found(other.search("losing", fuzzymatch=False))) == ({9} & ids)


@pytest.mark.parametrize("call", ["add", "remove", "compact"])
def test_crash_at_each_step(engine, spark, monkeypatch, call):
    """Nothing of a commit is seen before its log entry, wherever its writer stops."""
    index = filled(engine, [(1, "red fox"), (2, "blue fox")])
    index.add(3, "green fox")
    before = found(index.search("fox"))
    calls = {"add": lambda: index.add(9, "lost fox"), "remove": lambda: index.remove(1), "compact": index.compact}
    steps = {"add": ["_checked", "_write_postings", "_write_terms"], "remove": ["_write_terms"], "compact": ["_write_postings", "_write_terms"]}[call]
    for step in steps:
        def fail(*a, **k):
            raise RuntimeError("crash")

        with monkeypatch.context() as m:
            m.setattr(index, step, fail)
            m.setattr("millstone.sources.index_store.Commit.discard", lambda *a: None)  # a crash cleans nothing up
            with pytest.raises(RuntimeError):
                calls[call]()
        assert found(index.search("fox")) == before and index.doc_count == 3
    calls[call]()
    assert index.doc_count == {"add": 4, "remove": 2, "compact": 3}[call]
    index.vacuum(0)
    assert len(found(index.search("fox"))) == index.doc_count


def test_only_one_creates_a_file(engine):
    from concurrent.futures import ThreadPoolExecutor

    for i in range(5):
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda n, i=i: engine.files.write_new(engine.files.path(f"x{i}.json"), str(n)), range(8)))
        assert sum(won) == 1 and engine.files.read(engine.files.path(f"x{i}.json")) == str(won.index(True))


def test_snapshots_outlive_compaction(engine):
    index = filled(engine, [(1, "a b")])
    index.add(2, "a")
    old = index.store.snapshot()
    index.compact()
    index.remove(1)
    assert index.store.docs(old).count() == 2 and index.doc_count == 1
    assert [c["kind"] for c in index.store.snapshot().commits] == ["compact", "remove"]
    index.compact()
    index.vacuum(0)
    assert len(index.store.files.names(index.store.files.path("log"))) == 2  # the last entry and the pointer to it
    assert set(found(index.search("a"))) == {2}


def test_skewed_postings_spread(engine, spark, monkeypatch):
    index = engine.create_index("s", {"filters": [], "tokenizer": "simple"})
    monkeypatch.setattr(index, "spark", spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.add_documents(spark.range(1, 4001).selectExpr("id as doc_id", "concat('the x', id % 7) as text"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    entry = index.store.snapshot().commits[0]
    sizes = [r[0] for r in spark.read.parquet(index.store.path("postings", entry)).groupBy(F.input_file_name()).count().select("count").collect()]
    assert sum(sizes) == 8000 and max(sizes) < 4000


def test_stopword_files_and_filter_modules(spark, tmp_path):
    (tmp_path / "filters" / "stopwords").mkdir(parents=True)
    (tmp_path / "filters" / "stopwords" / "en").write_text("cat\n\ndog\n")
    folder = tmp_path / "modules"
    folder.mkdir()
    (folder / "twice.py").write_text("def create(params):\n    return [params['lang']]\n\n\ndef filter(context, token):\n    return token * 2 + context[0]\n\n\ndef destroy(context):\n    context.append('gone')\n")
    e = Engine(spark, str(tmp_path), filter_dir=str(folder))
    index = filled(e, [(1, "the cat"), (2, "a dog")], filters=["stopwords", "twice"])
    assert {r["term"] for r in index.terms().collect()} == {"thetheen", "aaen"}
    assert set(found(index.search("the"))) == {1} and found(index.search("cat")) == {}
    context = index.pipeline.filters[1].context
    e.close()
    e.close()
    assert context == ["en", "gone"]


def test_folder_and_command_line(engine, spark, tmp_path, capsys):
    from millstone.__main__ import main
    from millstone.sources.files import read_folder

    folder = tmp_path / "texts"
    folder.mkdir()
    for name, text in (("a.txt", "red fox\nruns"), ("b.txt", "blue fox"), ("c.txt", "green")):
        (folder / name).write_text(text)
    rows = {r["path"]: (r["doc_id"], r["text"]) for r in read_folder(spark, str(folder)).collect()}
    assert set(rows) == {"a.txt", "b.txt", "c.txt"} and rows["a.txt"][1] == "red fox\nruns" and min(i for i, _ in rows.values()) > 0
    base = ["-b", str(tmp_path), "-i", "cli"]
    main([*base, "-a", "-p", str(folder), "-s", "fox"])
    assert f'"doc_id":{rows["a.txt"][0]}' in (out := capsys.readouterr().out) and '"count":2' in out and "indexing:" in out
    main([*base, "-d", "7", "-p", str(folder / "c.txt"), "-s", "green"])
    assert '"count":2' in capsys.readouterr().out
    main([*base, "-r", "-d", "7", "-s", "green"])
    assert '"count":1' in capsys.readouterr().out


def test_streaming(engine, spark, tmp_path):
    index = engine.create_index("s", {"filters": ["normalizer"]})
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (2, "blue fox"), (3, ""), (0, "bad"), (4, None)], DOCS).write.parquet(src)
    stream = spark.readStream.schema(DOCS).parquet(src)
    ingest(index, stream, str(tmp_path / "cp")).awaitTermination()
    assert set(found(index.search("fox"))) == {1, 2}
    spark.createDataFrame([(2, "blue fox"), (5, "fox")], DOCS).write.mode("append").parquet(src)
    ingest(index, stream, str(tmp_path / "cp")).awaitTermination()
    assert set(found(index.search("fox"))) == {1, 2, 5} and index.doc_count == 3


def test_plan_prunes_terms(engine):
    index = filled(engine, [(1, "cat dog"), (2, "dog")])
    df = index.search("cat AND dog")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan and "TakeOrderedAndProject" in plan
    assert F is not None


def test_postings_are_written_in_ranges_that_fit_a_task(spark, engine, monkeypatch):
    monkeypatch.setattr("millstone.engine.RANGE_ROWS", 10)
    index = engine.create_index("ranges", {"tokenizer": "simple", "filters": []})
    index.add_documents(spark.createDataFrame([(i, f"w{i % 7} v{i}") for i in range(1, 101)], "doc_id long, text string"))
    files = lambda: len(index.postings().inputFiles())
    assert files() > 12 and index.postings().count() == 200
    index.remove(5)
    index.compact()
    assert files() > 12 and index.postings().count() == 198


def test_content_is_stored_without_a_join_where_no_text_is_empty(spark, engine, monkeypatch):
    index = engine.create_index("joins")
    texts = spark.createDataFrame([(1, "foo bar"), (2, "bar")], "doc_id long, text string")

    def join(*args):
        raise AssertionError("texts are joined")

    with monkeypatch.context() as m:
        m.setattr(type(texts), "join", join)
        index.add_documents(texts, store=True, skip_empty=True)
    assert {r["doc_id"]: r["content"] for r in index.search("bar", fetch=True).collect()} == {1: "foo bar", 2: "bar"}


@pytest.mark.parametrize("sent", [0, 10])
def test_content_of_texts_without_a_token_is_left_out(spark, engine, monkeypatch, sent):
    monkeypatch.setattr("millstone.engine.MAX_SENT", sent)
    index = engine.create_index("empty")
    index.add_documents(spark.createDataFrame([(1, "foo"), (2, "the"), (3, ""), (4, None)], "doc_id long, text string"), store=True, skip_empty=True)
    s = index.store.snapshot()
    assert [tuple(r) for r in index.store.content(s).select("doc_id", "content").collect()] == [(1, "foo")]
    assert index.doc_count == 1
