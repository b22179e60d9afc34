import pytest
from helpers import SF, same
from pyspark.sql import functions as F
from pyspark.sql import functions as F
from pyspark.sql import functions as F
from pyspark.sql import functions as F
from pyspark.sql import functions as F
from pyspark.sql import functions as F
from pyspark.sql import functions as F
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from millstone import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        same(got.toPandas(), duck(SF).sql(queries.ORACLE_SQL[name]).df())
    else:
        assert got.count() > 0


@pytest.fixture(scope="module")
def wordless(spark, tmp_path_factory):
    """Tables with texts of which the stopword filter, or even the tokenizer, leaves nothing."""
    folder = str(tmp_path_factory.mktemp("wordless"))
    texts = ["That it.", "the idiot and the dog", "!!! ...", "", None, "an idiot", "the of and"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in (1, 2, 4))) for i in range(len(texts))], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", ["stopword_filter", "stopword_query", "stopword_query_empty", "remove_docs", "readd_docs"])
def test_texts_without_a_token_are_left_out(spark, duck, wordless, name):
    con = duck(SF)
    for table in ("documents", "labels"):
        con.execute(f"create or replace view {table} as select * from '{wordless}/{table}.parquet/*.parquet'")
    same(queries.QUERIES[name](spark, wordless).toPandas(), con.sql(queries.ORACLE_SQL[name]).df())


def test_stemmed_terms_without_a_token(spark, wordless):
    assert {tuple(r) for r in queries.stemmed_terms(spark, wordless).collect()} == {("idiot", 2, 2), ("dog", 1, 1)}


@pytest.mark.parametrize("name", ["stopword_filter", "remove_docs", "stemmed_terms", "normalized_terms", "readd_docs", "term_stats", "index_build", "stopword_query", "bm25_or"])
def test_rows_sent_to_python_are_short(spark, monkeypatch, name):
    """Texts of the table have up to 20,000 words."""
    sent, frame = [], type(spark.range(0))
    run = frame.mapInArrow

    def spy(df, *args):
        sent.append(df.agg(F.max(F.size("words"))).first()[0])
        return run(df, *args)

    monkeypatch.setattr(queries, "_built", {})
    monkeypatch.setattr(frame, "mapInArrow", spy)
    queries.QUERIES[name](spark, SF)
    assert sent and max(sent) <= 256


@pytest.mark.parametrize("name", [])
def test_rows_sent_to_python_are_short(spark, monkeypatch, name):
    """Texts of the table have up to 20,000 words."""
    sent, frame = [], type(spark.range(0))
    run = frame.mapInArrow

    def spy(df, *args):
        sent.append(df.agg(F.max(F.size("words"))).first()[0])
        return run(df, *args)

    monkeypatch.setattr(queries, "_built", {})
    monkeypatch.setattr(frame, "mapInArrow", spy)
    queries.QUERIES[name](spark, SF)
    assert sent and max(sent) <= 256


@pytest.mark.parametrize("name", [])
def test_rows_sent_to_python_are_short(spark, monkeypatch, name):
    """Texts of the table have up to 20,000 words."""
    sent, frame = [], type(spark.range(0))
    run = frame.mapInArrow

    def spy(df, *args):
        sent.append(df.agg(F.max(F.size("words"))).first()[0])
        return run(df, *args)

    monkeypatch.setattr(queries, "_built", {})
    monkeypatch.setattr(frame, "mapInArrow", spy)
    queries.QUERIES[name](spark, SF)
    assert sent and max(sent) <= 256


@pytest.mark.parametrize("name", [])
def test_rows_sent_to_python_are_short(spark, monkeypatch, name):
    """Texts of the table have up to 20,000 words."""
    sent, frame = [], type(spark.range(0))
    run = frame.mapInArrow

    def spy(df, *args):
        sent.append(df.agg(F.max(F.size("words"))).first()[0])
        return run(df, *args)

    monkeypatch.setattr(queries, "_built", {})
    monkeypatch.setattr(frame, "mapInArrow", spy)
    queries.QUERIES[name](spark, SF)
    assert sent and max(sent) <= 256


@pytest.mark.parametrize("name", [])
def test_rows_sent_to_python_are_short(spark, monkeypatch, name):
    """Texts of the table have up to 20,000 words."""
    sent, frame = [], type(spark.range(0))
    run = frame.mapInArrow

    def spy(df, *args):
        sent.append(df.agg(F.max(F.size("words"))).first()[0])
        return run(df, *args)

    monkeypatch.setattr(queries, "_built", {})
    monkeypatch.setattr(frame, "mapInArrow", spy)
    queries.QUERIES[name](spark, SF)
    assert sent and max(sent) <= 256


@pytest.mark.parametrize("name", [])
def test_rows_sent_to_python_are_short(spark, monkeypatch, name):
    """Texts of the table have up to 20,000 words."""
    sent, frame = [], type(spark.range(0))
    run = frame.mapInArrow

    def spy(df, *args):
        sent.append(df.agg(F.max(F.size("words"))).first()[0])
        return run(df, *args)

    monkeypatch.setattr(queries, "_built", {})
    monkeypatch.setattr(frame, "mapInArrow", spy)
    queries.QUERIES[name](spark, SF)
    assert sent and max(sent) <= 256


@pytest.mark.parametrize("name", [])
def test_rows_sent_to_python_are_short(spark, monkeypatch, name):
    """Texts of the table have up to 20,000 words."""
    sent, frame = [], type(spark.range(0))
    run = frame.mapInArrow

    def spy(df, *args):
        sent.append(df.agg(F.max(F.size("words"))).first()[0])
        return run(df, *args)

    monkeypatch.setattr(queries, "_built", {})
    monkeypatch.setattr(frame, "mapInArrow", spy)
    queries.QUERIES[name](spark, SF)
    assert sent and max(sent) <= 256


@pytest.mark.parametrize("name", [])
def test_rows_sent_to_python_are_short(spark, monkeypatch, name):
    """Texts of the table have up to 20,000 words."""
    sent, frame = [], type(spark.range(0))
    run = frame.mapInArrow

    def spy(df, *args):
        sent.append(df.agg(F.max(F.size("words"))).first()[0])
        return run(df, *args)

    monkeypatch.setattr(queries, "_built", {})
    monkeypatch.setattr(frame, "mapInArrow", spy)
    queries.QUERIES[name](spark, SF)
    assert sent and max(sent) <= 256


@pytest.mark.parametrize("name", [])
def test_rows_sent_to_python_are_short(spark, monkeypatch, name):
    """Texts of the table have up to 20,000 words."""
    sent, frame = [], type(spark.range(0))
    run = frame.mapInArrow

    def spy(df, *args):
        sent.append(df.agg(F.max(F.size("words"))).first()[0])
        return run(df, *args)

    monkeypatch.setattr(queries, "_built", {})
    monkeypatch.setattr(frame, "mapInArrow", spy)
    queries.QUERIES[name](spark, SF)
    assert sent and max(sent) <= 256


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
