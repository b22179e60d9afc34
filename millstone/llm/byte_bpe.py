"""Byte-level BPE encoding and decoding by recursive queries.

Each partition runs DuckDB inside its Python worker. The distinct pre-tokens of a slice of documents
become rows (word, position, token); a recursive query joins neighbouring tokens with the merge table,
contracts the leftmost pair of the lowest rank of every word, and ends when no word has a pair that
merges. Words of over ``LONG`` bytes, such as encoded binary data, contract all places of their lowest
rank in one step, from left to right (a merge never makes a pair of a lower rank than its own, so the
tokens are the same), and a query ends after some steps and is asked again with what it came to, so that
memory stays in proportion to the word. Decoding joins token ids with the vocabulary and aggregates the
pieces in token order.

The vocabulary is a file of base64 tokens and ranks whose path is a parameter; executors read it there.
A pair merges if its joined bytes are a token, and its rank is that token's id.

Defined cases: a null text has null token_ids and n_tokens; an empty text has an empty list; a null
doc_id is kept; repeated rows are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.llm import pieces
from millstone.llm import textcore as tc

SLICE_BYTES = 12 << 20
WORD_BATCH = 50_000
BATCH_BYTES = 1 << 20
LONG = 128
LONG_ROWS = 4 << 20
TOKEN_BATCH = 1_000_000

_ENCODE = """
with recursive step(word, pos, tok, nxt, best) as (
    select word, pos, tok, nxt, best
    from initial left join (
        select word, min(rank::bigint << 32 | pos) best from initial join merges on pair = (tok::bigint << 32 | nxt) group by word
    ) using (word)
  union all (
    with hit as (
        select word, best, max(case when pos = (best & 4294967295) + 1 then nxt end) as after from step where best is not null group by word, best
    ), contracted as (
        select s.word,
            case when s.pos > (s.best & 4294967295) then s.pos - 1 else s.pos end as pos,
            case when s.pos = (s.best & 4294967295) then (s.best >> 32)::int else s.tok end as tok,
            case s.pos - (s.best & 4294967295) when 0 then hit.after when -1 then (s.best >> 32)::int else s.nxt end as nxt
        from step s join hit on s.word = hit.word
        where s.pos != (s.best & 4294967295) + 1
    ), lowest as (
        select word, min(rank::bigint << 32 | pos) best from contracted join merges on pair = (tok::bigint << 32 | nxt) group by word
    )
    select c.word, c.pos, c.tok, c.nxt, lowest.best from contracted c left join lowest on c.word = lowest.word
  )
)
select word, tok from step where best is null order by word, pos
"""

_ENCODE_LONG = """
with recursive step(word, pos, tok, rank, best, depth) as (
    select word, pos, tok, rank, min(rank) over (partition by word), 0
    from (select word, pos, tok, lead(tok) over (partition by word order by pos) as nxt from initial) left join merges on pair = (tok::bigint << 32 | nxt)
  union all (
    with placed as (
        select word, pos, tok, best, depth, coalesce(rank = best, false) as hit,
            pos - coalesce(max(case when rank = best then null else pos end) over (partition by word order by pos rows unbounded preceding), -1) as nth
        from step where best is not null and depth < {steps}
    ), chosen as (
        select *, lag(hit and nth % 2 = 1, 1, false) over (partition by word order by pos) as gone from placed
    ), contracted as (
        select word, (row_number() over (partition by word order by pos) - 1)::int as pos, case when hit and nth % 2 = 1 then best else tok end as tok, depth + 1 as depth
        from chosen where not gone
    ), next as (
        select *, lead(tok) over (partition by word order by pos) as nxt from contracted
    )
    select word, pos, tok, rank, min(rank) over (partition by word), depth from next left join merges on pair = (tok::bigint << 32 | nxt)
  )
)
select word, tok, best is null as ended from step where best is null or depth = {steps} order by word, pos
"""

_DECODE = "select doc, string_agg(hex, '' order by pos) as hex from ids join vocabulary using (tok) group by doc order by doc"


class Codec:
    """Merge table and vocabulary in an in-memory DuckDB of one worker."""

    def __init__(self, path: str):
        import duckdb

        ranks = pieces.read_ranks(path)
        left, right, rank = [], [], []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(i)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1})
        self.con.execute("set temp_directory = ''")
        pair = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self._table("merges", {"pair": pair, "rank": np.array(rank, np.int32)})
        self._table("vocabulary", {"tok": np.array(list(ranks.values()), np.int32), "hex": [t.hex() for t in ranks]})

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.con.execute(f"create table {name} as select * from given")
        self.con.unregister("given")

    def _ask(self, name: str, columns: dict, query: str) -> dict:
        self.con.register(name, pa.table({k: pa.array(v) for k, v in columns.items()}))
        out = self.con.execute(query).fetchnumpy()
        self.con.unregister(name)
        return out

    def encode_words(self, words: list[str]) -> pieces.Lists:
        raw = [w.encode() for w in words]
        n = np.array([len(b) for b in raw], np.int64)
        large = np.flatnonzero(n > LONG).tolist()
        if not large:
            return self._encode_short(raw, n)
        small = np.flatnonzero(n <= LONG).tolist()
        both = [self._encode_short([raw[i] for i in small], n[small]), *(self._encode_long(raw[i]) for i in large)]
        values = np.concatenate([v for v, _ in both])
        off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in both]))])
        return pieces.gather((values, off), np.argsort(np.array(small + large, np.int64), kind="stable"))

    def _encode_long(self, raw: bytes) -> pieces.Lists:
        tok = self.single[np.frombuffer(raw, np.uint8)]
        while True:
            steps = max(4, LONG_ROWS // len(tok))
            at = np.arange(len(tok), dtype=np.int32)
            found = self._ask("initial", {"word": np.zeros(len(tok), np.int32), "pos": at, "tok": tok}, _ENCODE_LONG.format(steps=steps))
            tok = np.asarray(found["tok"], np.int32)
            if found["ended"].all():
                return tok, np.array([0, len(tok)])

    def _encode_short(self, words: list[bytes], size: np.ndarray) -> pieces.Lists:
        values, sizes = [], []
        end, lo = np.cumsum(size), 0
        while lo < len(words):
            hi = min(lo + WORD_BATCH, max(lo + 1, int(np.searchsorted(end, end[lo] + BATCH_BYTES))))
            raw, n = words[lo:hi], size[lo:hi]
            lo = hi
            tok = self.single[np.frombuffer(b"".join(raw), np.uint8)]
            nxt = np.append(tok[1:], -1).astype(np.int32)
            nxt[np.cumsum(n) - 1] = -1
            word = np.repeat(np.arange(len(raw), dtype=np.int32), n)
            pos = (np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            found = self._ask("initial", {"word": word, "pos": pos, "tok": tok, "nxt": nxt}, _ENCODE)
            values.append(np.asarray(found["tok"], np.int32))
            sizes.append(np.bincount(found["word"], minlength=len(raw)))
        if not values:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        return np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def encode_units(self, units: list[str]) -> pieces.Lists:
        words: dict[str, int] = {}
        index, cut = [], [0]
        for u in units:
            index += [words.setdefault(p, len(words)) for p in pieces.pretokens(u)]
            cut.append(len(index))
        return pieces.joined(pieces.gather(self.encode_words(list(words)), np.array(index, np.int64)), np.array(cut))

    def decode(self, lists: pieces.Lists) -> list[bytes]:
        """The bytes of each list of token ids."""
        values, off = lists
        out: list[bytes] = [b""] * (len(off) - 1)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + TOKEN_BATCH, side="right")) - 1)
            hi = min(hi, len(out))
            n = np.diff(off[lo : hi + 1])
            doc = np.repeat(np.arange(lo, hi, dtype=np.int32), n)
            pos = (np.arange(len(doc)) - np.repeat(off[lo:hi] - off[lo], n)).astype(np.int32)
            found = self._ask("ids", {"doc": doc, "pos": pos, "tok": np.ascontiguousarray(values[off[lo] : off[hi]])}, _DECODE)
            for d, h in zip(found["doc"].tolist(), found["hex"].tolist()):
                out[d] = bytes.fromhex(h)
            lo = hi
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encode_batches(path: str, check: bool):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = codec(path), batch.column("text")
            arr = tc.text_array(texts)
            for lo, hi in tc.slices(arr, SLICE_BYTES):
                part = arr[lo:hi]
                values, off = pieces.encode_texts(part, own.encode_units)
                null = np.asarray(texts[lo:hi].is_null())
                ids = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, pa.int32()), mask=pa.array(null))
                n = pa.array(np.diff(off), pa.int64(), mask=null)
                out = [batch.column("doc_id")[lo:hi], n, ids]
                names = ["doc_id", "n_tokens", "token_ids"]
                if check:
                    data, cut = tc.flat(part)
                    raw = data.tobytes()
                    back = own.decode((values, off))
                    out.append(pa.array([b == raw[x:y] for b, x, y in zip(back, cut.tolist(), cut[1:].tolist())], pa.bool_(), mask=null))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return fn


def encode(docs: DataFrame, path: str = pieces.VOCABULARY, check: bool = False) -> DataFrame:
    """(doc_id, n_tokens, token_ids); with ``check`` also ``decoded``: decoding gives the text's bytes."""
    schema = "doc_id long, n_tokens long, token_ids array<int>" + (", decoded boolean" if check else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode_batches(path, check), schema)


def _decode_batches(path: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("token_ids")
            off = np.asarray(ids.offsets).astype(np.int64)
            # null slots may span values; give them none
            size = np.where(np.asarray(ids.is_null()), 0, np.diff(off))
            keep = np.repeat(size > 0, np.diff(off))
            values = np.asarray(ids.values)[off[0] : off[-1]][keep]
            back = codec(path).decode((values, np.concatenate([[0], np.cumsum(size)])))
            text = pa.array([b.decode("utf-8", "replace") for b in back], pa.string(), mask=np.asarray(ids.is_null()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], names=["doc_id", "text"])

    return fn


def decode(tokens: DataFrame, path: str = pieces.VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids); ids outside the vocabulary are skipped."""
    return tokens.select("doc_id", F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(_decode_batches(path), "doc_id long, text string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(tc.documents(spark, sf_dir), check=True)
