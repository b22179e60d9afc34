import glob

import pyarrow as pa
import pyarrow.orc
from hypothesis import given, settings
from hypothesis import strategies as st

from millstone.llm import byte_bpe, pieces, token_orc
from millstone.llm import textcore as tc

TEXTS = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t \u0085'’aé漢🎉1.,")), max_size=60)


def reference(texts):
    return [token_orc._encoder(pieces.VOCABULARY).encode_ordinary(t) for t in texts]


def units(texts, encode):
    values, off = pieces.encode_texts(tc.text_array(pa.array(texts, pa.string())), encode)
    return [values[a:b].tolist() for a, b in zip(off, off[1:])]


@given(st.lists(TEXTS, min_size=1, max_size=6))
@settings(max_examples=120, deadline=None)
def test_recursive_merges_equal_the_reference_tokenizer(texts):
    own = byte_bpe.codec(pieces.VOCABULARY)
    want = reference(texts)
    assert units(texts, own.encode_units) == want
    assert units(texts, token_orc._units(pieces.VOCABULARY)) == want
    values, off = pieces.encode_texts(tc.text_array(pa.array(texts, pa.string())), own.encode_units)
    assert [b.decode() for b in own.decode((values, off))] == texts


def test_whole_table_round_trip(spark, sample):
    tokens = byte_bpe.encode(sample, check=True)
    rows = {r["doc_id"]: r for r in tokens.collect()}
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    assert rows.keys() == texts.keys() and all(r["decoded"] for r in rows.values())
    for (k, t), want in zip(texts.items(), reference(texts.values())):
        assert rows[k]["token_ids"] == want and rows[k]["n_tokens"] == len(want)
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decode(tokens).collect()} == texts


def test_null_and_empty(make):
    rows = {r["doc_id"]: r for r in byte_bpe.encode(make([None, "", "a"]), check=True).collect()}
    assert rows[0]["token_ids"] is None and rows[0]["n_tokens"] is None and rows[0]["decoded"] is None
    assert rows[1]["token_ids"] == [] and rows[1]["decoded"]
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode(byte_bpe.encode(make([None, "", "a"]))).collect()}
    assert back == {0: None, 1: "", 2: "a"}


def test_orc_has_stripes_index_and_bloom_filters(spark, sample, tmp_path):
    out = str(tmp_path / "orc")
    token_orc.write_tokens(sample.coalesce(1), out, stripe=64 << 10)
    files = glob.glob(f"{out}/*.orc")
    f = pyarrow.orc.ORCFile(files[0])
    assert f.nrows == sample.count() and f.nstripes >= 1
    assert f.row_index_stride == token_orc.ROW_STRIDE
    got = pa.concat_tables([pa.Table.from_batches([f.read_stripe(i)]) for i in range(f.nstripes)])
    assert got.column("doc_id").to_pylist() == sorted(got.column("doc_id").to_pylist())
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    want = dict(zip(texts, reference(texts.values())))
    assert {r["doc_id"]: r["token_ids"] for r in token_orc.read_tokens(spark, out).collect()} == want
    few = token_orc.read_tokens(spark, out, [5, 17, 10**9])
    assert {r["doc_id"]: r["token_ids"] for r in few.collect()} == {5: want[5], 17: want[17]}
    assert "PushedFilters: [In(doc_id" in few._jdf.queryExecution().executedPlan().toString()
