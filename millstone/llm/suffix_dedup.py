"""Repeated passages by a depth-limited radix sort of the corpus' suffixes.

A suffix is ordered only through its first ``depth`` words, so suffixes that stay equal through the
last pass are exactly the windows of ``depth`` words that occur more than once. The sort runs most
significant digit first and drops a suffix as soon as its group has one member:

1. *Distribution pass* (the one shuffle). The first digit of a suffix is the hash of the smallest
   ``ANCHOR``-word gram inside its window, and that gram's offset. Equal windows choose the same gram
   at the same offset, so equal suffixes always meet in one partition. Neighbouring suffixes mostly
   share their gram, so a run of them travels as one row.
2. *Passes inside a partition*, with two further digits, each a hash of one half of the window.
   Groups are split by each digit in turn and singletons leave after every pass.
3. *Hot digits.* Grams are counted first. One that more than ``HOT`` runs share (a license line, say) is
   not gathered in a task: its suffixes are grouped by all of their digits at once, in an aggregation that
   begins in the map tasks and gives each group's size and first member, and are then joined with the
   groups of two or more. At most ``HOT_GRAMS`` grams, the most frequent, are listed as hot; the others take
   the way of step 2, which gives the same result.

No suffix is skipped and there is no limit on the size of a group. The first pass removes most of a
natural corpus, since grams that occur once leave before anything is sorted.

Defined cases: a null or short text (fewer than ``depth`` words) has no window and no rows; rows with
a null doc_id take part and sort after the others; repeated rows are occurrences like any other; the
first occurrence in the order (doc_id, position in the table, word) is the one marked ``first``; a very
long text is taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millstone.llm import textcore as tc

DEPTH = 50
ANCHOR = 8
HOT = 20_000
HOT_GRAMS = 1 << 20
RUNS = "anchor long, row long, doc_id long, start int, off int, high array<int>, low array<int>"
WINDOWS = "anchor long, off int, high int, low int, row long, doc_id long, start int"
SPANS = "row long, doc_id long, start_word long, end_word long, first boolean"


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of every ``width`` consecutive values."""
    value, pos, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        a, b = value[:-step], value[step:]
        left = a <= b
        value, pos = np.where(left, a, b), np.where(left, pos[:-step], pos[step:])
        have += step
    return pos


def _runs(arr: pa.Array, rows: np.ndarray, docs: pa.Array, depth: int, anchor: int, hot: np.ndarray) -> pa.RecordBatch | None:
    """Runs of suffixes that share their gram, which isn't hot."""
    words = tc.words_of(arr, ~tc.SPACE)
    n = np.diff(words.first)
    if not len(n) or n.max() < depth:
        return None
    h = words.hashes()
    row_of = words.rows()
    last = words.first[1:][row_of]
    grams = tc.window_hash(h, anchor)
    pick = _sliding_argmin(grams, depth - anchor + 1)
    starts = np.arange(len(pick))
    ok = starts + depth <= last[: len(pick)]
    starts, pick = starts[ok], pick[ok]
    half = depth // 2
    high = tc.window_hash(h, half)[starts].astype(np.uint32).view(np.int32)
    low = tc.window_hash(h, depth - half)[starts + half].astype(np.uint32).view(np.int32)
    new = np.ones(len(starts), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    if len(hot):
        cold = ~np.isin(tc.signed(grams[pick[at]]), hot)
        stay = np.repeat(cold, np.diff(np.append(at, len(starts))))
        starts, pick, high, low, new = starts[stay], pick[stay], high[stay], low[stay], new[stay]
        at = np.flatnonzero(new)
        if not len(at):
            return None
    bounds = np.append(at, len(starts))
    row = row_of[starts[at]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(tc.signed(grams[pick[at]])),
            pa.array(rows[row]),
            docs.take(pa.array(row)),
            pa.array((starts[at] - words.first[row]).astype(np.int32)),
            pa.array((pick[at] - starts[at]).astype(np.int32)),
            tc.list_array(high, bounds, pa.int32()),
            tc.list_array(low, bounds, pa.int32()),
        ],
        names=["anchor", "row", "doc_id", "start", "off", "high", "low"],
    )


def _single(arr: pa.Array, rows: np.ndarray, docs: pa.Array, depth: int, anchor: int, hot: np.ndarray) -> pa.RecordBatch | None:
    """Every suffix with a hot gram, by itself."""
    t = _runs(arr, rows, docs, depth, anchor, np.zeros(0, np.int64))
    if t is None:
        return None
    t = t.filter(pa.array(np.isin(t.column("anchor").to_numpy(), hot)))
    high, bounds = _lists(t.column("high"))
    low, _ = _lists(t.column("low"))
    run = np.repeat(np.arange(t.num_rows), np.diff(bounds))
    step = (np.arange(len(run)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.int32)
    take = lambda c: t.column(c).take(pa.array(run))
    start, off = t.column("start").to_numpy()[run] + step, t.column("off").to_numpy()[run] - step
    return pa.RecordBatch.from_arrays([take("anchor"), pa.array(off), pa.array(high), pa.array(low), take("row"), take("doc_id"), pa.array(start)], names=["anchor", "off", "high", "low", "row", "doc_id", "start"])


def _anchors(arr: pa.Array, rows: np.ndarray, docs: pa.Array, depth: int, anchor: int, hot: np.ndarray) -> pa.RecordBatch | None:
    """The gram of every run, counted in the slice."""
    t = _runs(arr, rows, docs, depth, anchor, hot)
    if t is None:
        return None
    gram, n = np.unique(t.column("anchor").to_numpy(), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["anchor", "n"])


def _map(make, depth: int, anchor: int, hot: np.ndarray):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr = tc.text_array(batch.column("text"))
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            docs = batch.column("doc_id")
            for lo, hi in tc.slices(arr):
                out = make(arr[lo:hi], rows[lo:hi], docs[lo:hi], depth, anchor, hot)
                if out is not None:
                    yield out

    return fn


def refine(ids: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One radix pass: (indices that stay, their new group ids); groups of one member leave."""
    order = np.lexsort((digit, ids))
    a, b = ids[order], digit[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    gid = np.cumsum(new) - 1
    stay = np.bincount(gid, minlength=1)[gid] > 1
    return order[stay], gid[stay]


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    off = np.asarray(column.offsets)
    return np.asarray(column.values)[off[0] : off[-1]], off - off[0]


def _resolve(t: pa.RecordBatch, depth: int) -> pa.RecordBatch | None:
    """Spans of the runs of whole anchor groups, which are sorted by anchor."""
    anchor = t.column("anchor").to_numpy()
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    gid = np.cumsum(new) - 1
    many = np.flatnonzero(np.bincount(gid)[gid] > 1)
    if not len(many):
        return None
    t, gid = t.take(pa.array(many)), gid[many]
    high, bounds = _lists(t.column("high"))
    low, _ = _lists(t.column("low"))
    n = np.diff(bounds)
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(run)) - np.repeat(bounds[:-1], n)
    start = t.column("start").to_numpy()[run] + step
    ids = gid[run] * (depth + 1) + t.column("off").to_numpy()[run] - step
    idx = np.arange(len(run))
    for digit in (high, low):
        keep, ids = refine(ids, digit[idx])
        idx = idx[keep]
    if not len(idx):
        return None
    docs = t.column("doc_id")
    key = np.where(np.asarray(docs.is_null()), np.iinfo(np.int64).max, np.asarray(docs.fill_null(0)))
    rows = t.column("row").to_numpy()
    order = np.lexsort((start[idx], rows[run[idx]], key[run[idx]], ids))
    lead = np.ones(len(order), bool)
    lead[1:] = ids[order][1:] != ids[order][:-1]
    first = np.zeros(len(run), np.int8)
    first[idx] = 1
    first[idx[order[lead]]] = 2
    edge = np.ones(len(run), bool)
    edge[1:] = (first[1:] != first[:-1]) | (run[1:] != run[:-1])
    at = np.flatnonzero(edge)
    end = np.append(at[1:], len(run)) - 1
    hit = first[at] > 0
    at, end = at[hit], end[hit]
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[run[at]]), docs.take(pa.array(run[at])), pa.array(start[at].astype(np.int64)), pa.array((start[end] + depth).astype(np.int64)), pa.array(first[at] == 2)],
        names=["row", "doc_id", "start_word", "end_word", "first"],
    )


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Re-cut batches that are sorted by ``column`` so that no group spans two of them."""
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if carry and carry[0].column(column)[0].as_py() != key[-1] or cut:
            yield _joined([*carry, batch.slice(0, cut)])
            carry = []
        carry.append(batch.slice(cut))
    if carry:
        yield _joined(carry)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    return table.to_batches()[0] if table.num_rows else parts[0]


def _reduce_runs(depth: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "anchor"):
            out = _resolve(group, depth)
            if out is not None:
                yield out

    return fn


def numbered(docs: DataFrame, work: tc.Scratch) -> DataFrame:
    """(row, doc_id, text) as a table: row tells rows apart whose doc_id is null or repeated."""
    return work.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "rows")


def hot_grams(rows: DataFrame, depth: int, anchor: int) -> np.ndarray:
    """Grams of more than HOT runs, at most HOT_GRAMS of them, so 8 MB."""
    counts = rows.mapInArrow(_map(_anchors, depth, anchor, np.zeros(0, np.int64)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > HOT).orderBy(F.desc("n"), "anchor").limit(HOT_GRAMS).select("anchor").collect()
    return np.array(sorted(r[0] for r in found), np.int64)


def _hot_spans(rows: DataFrame, depth: int, anchor: int, hot: np.ndarray, work: tc.Scratch) -> DataFrame:
    digits = ["anchor", "off", "high", "low"]
    windows = work.keep(rows.mapInArrow(_map(_single, depth, anchor, hot), WINDOWS), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start")
    # a table, so that the join can split a group of many equal windows
    groups = work.keep(windows.groupBy(*digits).agg(F.count("*").alias("n"), F.min(place).alias("lead")).where("n > 1").select(*digits, F.col("lead.row").alias("lead_row"), F.col("lead.start").alias("lead_start")), "groups")
    found = windows.join(groups, digits)
    return found.selectExpr("row", "doc_id", "cast(start as long) start_word", f"cast(start + {depth} as long) end_word", "row = lead_row and start = lead_start as first")


def raw_spans(rows: DataFrame, work: tc.Scratch, depth: int = DEPTH, anchor: int = ANCHOR) -> DataFrame:
    """Repeated stretches, not yet merged where they overlap, of a ``numbered`` table."""
    if depth <= anchor:
        anchor = max(1, depth // 2)
    hot = hot_grams(rows, depth, anchor)
    runs = rows.mapInArrow(_map(_runs, depth, anchor, hot), RUNS)
    spans = runs.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_reduce_runs(depth), SPANS)
    return spans.union(_hot_spans(rows, depth, anchor, hot, work)) if len(hot) else spans


def repeated_spans(rows: DataFrame, work: tc.Scratch, depth: int = DEPTH, anchor: int = ANCHOR) -> DataFrame:
    """Maximal stretches of words covered by repeated windows, one row a stretch.

    ``first`` stretches hold the first occurrence of each of their windows; the others are later
    copies. (row, doc_id, start_word, end_word exclusive, first).
    """
    w = W.partitionBy("row", "first").orderBy("start_word", "end_word")
    before = F.max("end_word").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_word") <= F.col("before"), 0).otherwise(1)).over(w)
    return (
        raw_spans(rows, work, depth, anchor)
        .withColumn("before", before)
        .withColumn("island", island)
        .groupBy("row", "doc_id", "first", "island")
        .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
        .select("row", "doc_id", "start_word", "end_word", "first")
    )


def suffix_dedup(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, start_word, n_words, first) of every repeated stretch of ``docs``."""
    work = tc.Scratch(docs.sparkSession, "suffixes")
    return repeated_spans(numbered(docs, work), work, depth).select("doc_id", "start_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    # group 0 is a word with the white space before it, so what stays keeps its own layout
    word = re.compile(r"[\t-\r ]*[^\t-\r ]+")
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        out, changed = [], []
        for text, cut in zip(texts, spans):
            changed.append(bool(cut) and text is not None)
            if not changed[-1]:
                out.append(text)
                continue
            pieces = [m.group() for m in word.finditer(text)]
            gone, kept = np.zeros(len(pieces), bool), np.zeros(len(pieces), bool)
            for s in cut:
                (kept if s["first"] else gone)[s["start_word"] : s["end_word"]] = True
            out.append("".join(p for p, g in zip(pieces, gone & ~kept) if not g).lstrip("\t\n\v\f\r "))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(changed, pa.bool_()), batch.column("rest")], names=["text", "changed", "rest"])


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs`` without the later copies of repeated passages; columns stay, n_chars is renewed where a text is cut.

    A word goes if a later copy covers it and no first occurrence does. Defined cases: a document of which
    nothing is left goes; null texts, and texts that were empty or blank from the start, stay as they are; rows
    with a null doc_id take part, after the others; of repeated rows the first keeps its text; an empty table
    stays empty; columns may have any names.
    """
    names = docs.columns
    work = tc.Scratch(docs.sparkSession, "repeats")
    # the other columns travel as one, under names of their own
    at = {c: f"c{i}" for i, c in enumerate(names)}
    rest = F.struct(F.lit(0).alias("none"), *[at[c] for c in names if c != "text"])
    rows = docs.toDF(*at.values()).select(F.monotonically_increasing_id().alias("row"), F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["text"]).cast("string").alias("text"), rest.alias("rest"))
    rows = work.keep(rows, "rows")
    spans = repeated_spans(rows.select("row", "doc_id", "text"), work, depth)
    cut = spans.groupBy("row").agg(F.collect_list(F.struct("start_word", "end_word", "first")).alias("spans"), F.bool_or(~F.col("first")).alias("copies")).where("copies").drop("copies")
    cut = work.keep(cut, "cut")  # so that the files of the sort go before the texts are joined
    work.drop("windows", "groups")
    both = rows.select("row", "text", "rest").join(cut, "row", "left")
    schema = both.select("text", F.lit(True).alias("changed"), "rest").schema
    out = both.mapInArrow(_cut, schema).where("not changed or text != ''")
    column = {c: F.col("rest").getField(f"c{i}") for i, c in enumerate(names)} | {"text": F.col("text")}
    if "n_chars" in names:
        column["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(column["n_chars"])
    return out.select(*[column[c].alias(c) for c in names])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(tc.documents(spark, sf_dir))


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(text, '[^\x09-\x0d ]+') ws from documents where text is not null),
 s as (select doc_id, ws, unnest(range(len(ws) - 49)) p from w where len(ws) >= 50),
 k as (select doc_id, p, array_to_string(ws[p+1:p+50], ' ') win from s),
 g as (select doc_id, p, count(*) over (partition by win) n,
              row_number() over (partition by win order by doc_id, p) = 1 as first from k),
 r as (select doc_id, p, first from g where n > 1),
 i as (select doc_id, p, first, case when p <= lag(p) over (partition by doc_id, first order by p) + 50 then 0 else 1 end as brk from r),
 j as (select doc_id, p, first, sum(brk) over (partition by doc_id, first order by p) as island from i)
select doc_id, min(p)::bigint as start_word, (max(p) + 50 - min(p))::bigint as n_words, first
from j group by doc_id, first, island
"""
