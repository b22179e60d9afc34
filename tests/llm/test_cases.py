"""The cases that every operator and stage defines: nulls, empty and very long texts, repeats, no rows, extra columns."""

import random

import pytest
from llm_ops import OPERATORS, STAGES
from pyspark.sql import functions as F

from millstone.llm import language_id

from tests_util import prose

LONG = " ".join(prose(60_000, 1))
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, LONG), (6, "!!! ### ..."), (None, "a text without an id"), (7, "same same"), (7, "same same"), (8, "é" * 5000), (9, "x" * 70_000)]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(make, name):
    rows = OPERATORS[name](make(ODD)).collect()
    assert OPERATORS[name](make(ODD)).columns
    again = OPERATORS[name](make(random.Random(2).sample(ODD, len(ODD)))).collect()
    per = {"bpe", "orc", "omh", "langid", "quality"}
    assert len(rows) == len(again)
    if name in per:
        assert len(rows) == len(ODD)
    if name == "jaccard":
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == {i: (i, 0) for i in range(1, 10)}
    if name in ("dedup", "secrets"):
        assert rows == []
    if name == "packing":
        packed = sorted((d is None, d or 0) for r in rows for d in r["doc_ids"])
        assert set(packed) == {(False, i) for i in (4, 5, 7, 8, 9)} | {(True, 0)} and packed.count((False, 7)) == 2


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(make, name):
    assert OPERATORS[name](make([])).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_extra_columns(make, name):
    extra = ["row", "hub", "key", "first", "start", "anchor", "spans", "route", "__gone", "copies", "labelled", "words", "terms", "hash", "set_id", "__hash", "rest", "class_id", "meet", "cell"]
    plain = make([*ODD, "one more text"])
    wide = plain.select("*", *[F.lit("z").alias(c) for c in extra])
    assert sorted(map(str, OPERATORS[name](wide).collect())) == sorted(map(str, OPERATORS[name](plain).collect()))


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stage_keeps_columns(spark, make, name):
    extra = ["row", "hub", "first", "spans", "copies", "__row", "__spans", "__gone", "gone", "id", "hash", "__hash", "rest", "changed", "before", "island", "class_id", "lang.name", "none", "c0"]
    d = make([*ODD, (20, "passage " + " ".join(prose(70, 5))), (21, " ".join(prose(70, 5)) + " end")]).select("*", *[F.lit("z").alias(c) for c in extra])
    for frame in (d, d.limit(0)):
        out = STAGES[name](spark, frame, None)
        assert out.schema.names == frame.schema.names
        rows = out.collect()
        assert len(rows) <= frame.count() and all(r[c] == "z" for r in rows for c in extra)
    texts = {r["doc_id"]: r["text"] for r in STAGES[name](spark, d, None).collect()}
    if name in ("suffix_dedup", "ngram_jaccard", "secret_scan"):
        assert texts[1] is None and texts[2] == "" and texts[3] == "   \n\t " and texts[4] == "word" and texts[None] == "a text without an id"
    else:
        assert not {1, 2, 3} & set(texts)
    assert texts.get(21, "end") in (" ".join(prose(70, 5)) + " end", "end")


def test_repeated_text_of_any_size_stays_bounded_in_training(spark):
    """All labelled rows equal: one of them is trained on, and there is a model."""
    d = spark.range(2500).selectExpr("3L doc_id", "'the cat is in the house' text", "'en' lang", "'s' source", "24L n_chars")
    assert {(r["lang"], r["n"]) for r in language_id.language_id(d).groupBy("lang").agg(F.count("*").alias("n")).collect()} == {("en", 2500)}
    assert language_id.sample_rows(d, ["doc_id", "text", "lang"], 100).count() == 1
    many = spark.range(5000).selectExpr("id doc_id", "'x' text")
    assert language_id.sample_rows(many, ["doc_id", "text"], 300).count() == 300
