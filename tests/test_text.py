import pytest
from pyspark.sql import functions as F

from millstone.errors import EngineSystemError, ExistsError, InvalidError
from millstone.functions import text
from millstone.functions.stemmer import english, stemmer
from millstone.operators.fuzzy import best, byte_levenshtein, candidates

CASES = [
    ("a", ["a"]),
    ("The quick brown fox jumped over the lazy dog.", ["the", "quick", "brown", "fox", "jumped", "over", "lazy", "dog"]),
    ("We will play with I.B.M.", ["we", "will", "play", "with", "i.b.m"]),
    ("Hello_I_m_arbitrary_concatenated, foo and bar", ["hello_i_m_arbitrary_concatenated", "foo", "and", "bar"]),
    ("the [client] is <foo>, some *bold* marks.", ["the", "client", "is", "foo", "some", "bold", "marks"]),
    ("Text,which doesn't  have spaces right;one;two;three..", ["text", "which", "doesn't", "have", "spaces", "right", "one", "two", "three"]),
    ("", []),
]


def test_word_segments(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string").select("i", text.word_segments(F.col("t"), "en").alias("w")).orderBy("i").collect()
    for row, (_, want) in zip(rows, CASES):
        assert list(dict.fromkeys(text.normalize(w) for w in row["w"])) == want


def test_normalization():
    assert text.nfkc_casefold("Henry Ⅷ") == "henry viii"
    assert text.nfkc_casefold("AirForce ①") == "airforce 1"
    for a, b in (("azúl", "azul"), ("ĄŽUOLĖLIS", "AZUOLELIS"), ("Fuglafjørður", "Fuglafjordur"), ("Árbæ", "Arbae")):
        assert text.strip_diacritics(a) == b


def test_case_mapping(spark):
    row = spark.sql("select lower('ĄČĘĖĮŠŲŪŽ') a, upper('straße') b, upper('Дніпр') c").first()
    assert tuple(row) == ("ąčęėįšųūž", "STRASSE", "ДНІПР")


def test_stemmer():
    pairs = "foxes fox cats cat consigned consign consistency consist knackeries knackeri happy happi hopping hop hoped hope generously generous communication communic relational relat sky sky dying die cry cri say say succeed succeed controlling control agreed agre feed feed plastered plaster lazy lazi gas gas this this".split()
    for a, b in zip(pairs[::2], pairs[1::2]):
        assert english(a) == b
    with pytest.raises(EngineSystemError):
        stemmer("xx")


def test_registry_and_pipeline():
    r = text.Registry()
    r.register("upper", lambda ctx, t: None if t == "drop" else "" if t == "void" else t.upper() + ctx, create=lambda p: p["mark"])
    run = r.pipeline(["normalizer", "upper"], {"mark": "!"})
    assert run("Ab") == "AB!" and run("drop") is None and run("VOID") is None
    with pytest.raises(ExistsError):
        r.register("upper", lambda c, t: t)
    with pytest.raises(InvalidError):
        r.register("none", None)
    with pytest.raises(InvalidError, match="not found"):
        r.pipeline(["nope"], {})


LEV = [("kitten", "kitten", 0), ("kitten", "sitten", 1), ("sitting", "kitten", 3), ("cat", "chat", 1), ("cat", "cactus", 3), ("cat", "gato", 2), ("", "", 0), ("", "a", 1), ("aabcc", "bccdd", 4), ("ABCDEF", "abcdef", 6), ("variable", "valuable", 2), ("leaf", "leaves", 3), ("john smith", "johnathan smith", 5), ("levenshtein", "frankenstein", 6), ("123456789", "101010101", 8), ("something", "different", 8), ("é", "e", 2)]


def test_byte_levenshtein(spark):
    df = spark.createDataFrame(LEV, "a string, b string, d int")
    assert df.where(byte_levenshtein(F.col("a"), F.col("b")) != F.col("d")).count() == 0


def test_fuzzy(spark):
    words = "the quick brown fox jumped over lazy dog".split()
    terms = spark.createDataFrame([(w, 1) for w in words] + [("gone", 0), ("thee", 1), ("tea", 1)], "term string, total long")
    pairs = {"qvick": "quick", "brawn": "brown", "jumps": "jumped", "llazy": "lazy", "gome": None, "zzzzzz": None}
    found = {r["value"]: r["term"] for r in best(candidates(list(pairs), terms)).collect()}
    assert candidates([], terms).collect() == []
    assert found == {k: v for k, v in pairs.items() if v}
    tie = {r["term"] for r in candidates(["thea"], terms).collect()}
    assert tie == {"the", "thee", "tea"}
    assert best(candidates(["thea"], terms)).first()["term"] == "tea"
