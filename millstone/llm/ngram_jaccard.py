"""N-gram Jaccard join through rare shingles and parity sketches.

A document is its set of ``n``-word shingles (ASCII case folded, punctuation ignored). Of a set of size n, a
set of Jaccard similarity ``t`` or more and of no larger size lacks at most n - t*n shingles, so among any
n - t*n + 1 shingles of the set one is common (pigeonhole); if both take the first ones of one order, they
have one of these in common. This holds for sets of all sizes: nothing is sampled or cut.

* **Equal sets first.** Documents are aggregated by the identity of their set, partially in each map task,
  and one representative of each set goes on.
* **Rarest first.** The order is that of the number of documents that hold a shingle. Shingles go to
  slices of the hash range, packed in buffers, to be counted there. Those of a single set, most of them,
  are first in the order and stay there, as no other set can have them; so only what more than one set
  has and is among the first comes back to the set. Shingles that are frequent in a sample of
  ``SAMPLE`` documents don't go to the slices and are the last in the order, so no slice gets a large group.
* **Size bands.** Band edges grow by 1/t, so the smaller set of a similar pair lies in the band of the
  larger one or in the band below; every set is entered in its own band and, by fewer shingles, in the next.
* **Meetings.** The sets of a key meet at the key's smallest member. A meeting of more than ``BLOCK`` sets
  or ``BLOCK_SHINGLES`` shingles is cut into blocks, and each pair of blocks is a cell, a task's unit of
  work; so no task holds a large group. A pair that has several meetings counts in its largest one.
* **Sketch filter.** In a cell, pairs whose parity sketches of the whole sets (bits in proportion to the
  size; the wider one is folded) differ in more bits than their sizes allow leave. Only sets with a pair
  left go on.
* **Verification** is on the whole sets, by 64-bit shingle hashes. A cell gives for each set its number of
  links there and the smallest document of its connected part, so what leaves a cell is in proportion to
  its sets, not to its pairs.

Result, one row a document: (doc_id, class_id, n_links). A class is a connected component of the links
between sets, named by its smallest doc_id; n_links is the number of other sets (different texts) that are
similar to the document's. Sets are told apart by 64-bit hashes.

Defined cases: a null doc_id has no row; null text and texts without a word are alone in their class, with
no links; texts shorter than n words are one shingle; repeated rows of one doc_id count once, and a doc_id
with different texts has the smallest of their classes and the most of their links; very long texts are
compared whole; a pair exactly at the threshold is linked; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.llm import textcore as tc
from millstone.llm.language_id import sample_rows
from millstone.llm.lexical_packing import _packed, _unpacked
from millstone.llm.suffix_dedup import whole_groups

NGRAM = 3
THRESHOLD = 0.6
SLICE = 1 << 21  # shingles of a slice of the hash range
SENT_BYTES = 8 << 20  # text whose shingles are sent together
SAMPLE = 8192
FREQUENT = 32  # documents of the sample
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20
SMALL = 24  # cells of up to this many sets are compared many at a time
CHUNK = 1 << 16
TEXT_BYTES = 4 << 20


def band_edges(t: float, largest: int = 1 << 31) -> np.ndarray:
    """Upper size of each band, so that a size is at least t times any size of the band above."""
    if not 0 < t < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    edges = [1]
    while edges[-1] < largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] / t)))
    return np.array(edges, dtype=np.int64)


class Shingles:
    """Distinct shingles of consecutive rows, sorted by row and hash; ``size`` of a row, of which ``alone`` are no other set's and not listed."""

    def __init__(self, arr: pa.Array, n: int):
        words = tc.words_of(arr, tc.WORDCHAR)
        count = np.diff(words.first)
        h = words.hashes(fold=True)
        rows = words.rows()
        if len(h) >= n:
            at = np.flatnonzero(rows[: len(h) - n + 1] == rows[n - 1 :])
            grams, row = tc.window_hash(h, n)[at], rows[at]
        else:
            grams, row = h[:0], rows[:0]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            extra = [tc.window_hash(h[a:b], b - a)[0] for a, b in ((words.first[r], words.first[r + 1]) for r in short)]
            grams = np.append(grams, np.array(extra, np.uint64))
            row = np.append(row, short)
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
        self.grams, self.row = grams[new], row[new]
        self.first = np.searchsorted(self.row, np.arange(len(count) + 1))
        self.size = np.diff(self.first)
        self.rank, self.alone = np.zeros(len(self.row), np.uint16), np.zeros(len(count), np.int64)

    def set_ids(self) -> np.ndarray:
        """64-bit identity of each row's set; 0 for an empty set."""
        out = np.zeros(len(self.size), np.uint64)
        has = np.flatnonzero(self.size)
        if len(has):
            out[has] = tc.mix(np.add.reduceat(tc.mix(self.grams), self.first[has]) + self.size[has].astype(np.uint64))
        return out


class Shared:
    """Like ``Shingles``, with the shingles of each set that others have as well, rarest first by ``rank``."""

    def __init__(self, sets: np.ndarray, size: np.ndarray, owner: np.ndarray, grams: np.ndarray, rank: np.ndarray):
        row = np.searchsorted(sets, owner)
        order = np.lexsort((grams, rank, row))
        grams, row, rank = grams[order], row[order], rank[order]
        new = np.ones(len(row), bool)  # copies of a text send its shingles again
        new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
        self.grams, self.row, self.rank, self.size = grams[new], row[new], rank[new], size
        self.first = np.searchsorted(self.row, np.arange(len(sets) + 1))
        self.alone = size - np.diff(self.first)


def _allowed(n: np.ndarray, other: np.ndarray, t: float) -> np.ndarray:
    """Largest difference of similar sets of these sizes."""
    return np.floor((1 - t) / (1 + t) * (n + other) + 1e-9).astype(np.int64)


def sketch_keys(s: Shingles | Shared, t: float, edges: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): what each set is entered by in its own band + ``step``, row after row.

    Its own band is where a set meets those that are no larger, the next one where it meets larger ones.
    """
    band = np.searchsorted(edges, s.size)
    least = t * s.size if step == 0 else t / (1 + t) * (s.size + edges[np.minimum(band, len(edges) - 1)] + 1)  # common shingles
    firsts = s.size - np.ceil(least - 1e-6).astype(np.int64) + 1 - s.alone
    place = np.arange(len(s.row)) - s.first[s.row]
    keep = np.flatnonzero(place < firsts[s.row])
    salt = (band + step).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return tc.mix(s.grams[keep] + salt[s.row[keep]]), np.searchsorted(s.row[keep], np.arange(len(s.size) + 1))


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows, words) as narrower ones; widths are powers of two, and so is their quotient."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), axis=1)


class Sketches:
    """Parity of the shingles that fall on each bit, with 2 to 4 bits a shingle, 64 at least."""

    def __init__(self, words: np.ndarray, off: np.ndarray):
        self.words, self.off = words, off
        self.width = np.diff(off)
        self._folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, row: np.ndarray, grams: np.ndarray, size: np.ndarray) -> Sketches:
        width = 1 << np.ceil(np.log2(np.maximum(1, size / 32))).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(width)])
        mask = (width * 64 - 1).astype(np.uint64)
        bit = (tc.mix(grams ^ np.uint64(0x5851F42D4C957F2D)) & mask[row]).astype(np.int64) + off[row] * 64
        odd = np.bincount(bit, minlength=int(off[-1]) * 64) & 1
        return cls(np.packbits(odd.astype(np.uint8)).view(np.uint64), off)

    @classmethod
    def read(cls, column: pa.BinaryArray) -> Sketches:
        off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        return cls(np.ascontiguousarray(raw).view(np.uint64), (off - off[0]) // 8)

    def column(self) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(self.width), [None, pa.py_buffer((self.off * 8).astype(np.int32)), pa.py_buffer(self.words)])

    def folded(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of each row, sketches of this width) of the rows that are as wide or wider."""
        if width not in self._folded:
            place, parts, total = np.full(len(self.width), -1, np.int64), [], 0
            for w in np.unique(self.width[self.width >= width]).tolist():
                rows = np.flatnonzero(self.width == w)
                place[rows] = total + np.arange(len(rows))
                total += len(rows)
                parts.append(_fold(self.words[self.off[rows][:, None] + np.arange(w)], width))
            self._folded[width] = place, np.concatenate(parts)
        return self._folded[width]

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of each pair, at the width of the narrower sketch: at most the symmetric difference."""
        width = np.minimum(self.width[i], self.width[j])
        out = np.zeros(len(i), np.int64)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            place, bits = self.folded(w)
            for lo in range(0, len(at), max(1, (1 << 20) // w)):
                part = at[lo : lo + max(1, (1 << 20) // w)]
                out[part] = np.bitwise_count(bits[place[i[part]]] ^ bits[place[j[part]]]).sum(1, dtype=np.int64)
        return out


SETS = "doc_id long, hash long, set_id long, n long, sketch binary"
SENT = "slice int, sets binary, grams binary"
BACK = "bucket int, sets binary, grams binary, rank binary"
KEYS = "set_id long, own array<long>, after array<long>"
GRAM = np.uint64((1 << 48) - 1)


def _map_sets(n: int):
    """The set of each document; null where it is empty."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr = tc.text_array(batch.column("text"))
            for lo, hi in tc.slices(arr):
                s = Shingles(arr[lo:hi], n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[lo:hi],
                        batch.column("hash")[lo:hi],
                        pa.array(tc.signed(s.set_ids()), mask=s.size == 0),
                        pa.array(s.size.astype(np.int64)),
                        Sketches.of(s.row, s.grams, s.size).column(),
                    ],
                    names=["doc_id", "hash", "set_id", "n", "sketch"],
                )

    return fn


def _grams(n: int):
    """A row for each shingle."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr = tc.text_array(batch.column("text"))
            for lo, hi in tc.slices(arr):
                yield pa.RecordBatch.from_arrays([pa.array(tc.signed(Shingles(arr[lo:hi], n).grams & GRAM))], names=["gram"])

    return fn


def _frequent(base: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, rank) of those that are frequent in a sample, so SAMPLE / FREQUENT for each shingle of a document."""
    sample = sample_rows(base.where("text is not null"), ["text"], SAMPLE)
    found = sample.mapInArrow(_grams(n), "gram long").groupBy("gram").count().where(F.col("count") >= FREQUENT).toPandas().sort_values("gram")
    return found["gram"].to_numpy(np.uint64), 256 + _rank(found["count"].to_numpy())


def _rank(count: np.ndarray) -> np.ndarray:
    """The count in steps of a 16th power of 2, up to 255."""
    return np.minimum(255, np.log2(np.maximum(count, 1)) * 16).astype(np.uint16)


def _cut(at: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(value of ``at``, its part of each column), in the order of the rows."""
    order = np.argsort(at, kind="stable")
    at, columns = at[order], [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(at[a]), *[c[a:b] for c in columns]


def _send(n: int, slices: int, frequent: np.ndarray):
    """The shingles of each set, by slice of the hash range. Frequent ones go to slices of their own, which don't count."""

    def flush(sets: list[np.ndarray], grams: list[np.ndarray], turn: int) -> pa.RecordBatch:
        owner, gram = np.concatenate(sets), np.concatenate(grams)
        to = ((gram >> np.uint64(48)) % np.uint64(slices)).astype(np.int32)
        gram &= GRAM
        if len(frequent):
            to[frequent[np.minimum(np.searchsorted(frequent, gram), len(frequent) - 1)] == gram] = slices + turn % slices
        rows = [(at, o.tobytes(), _packed(g)) for at, o, g in _cut(to, owner, gram)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "sets", "grams"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, grams, size, turn = [], [], 0, 0
        for batch in batches:
            arr = tc.text_array(batch.column("text"))
            for lo, hi in tc.slices(arr):
                s = Shingles(arr[lo:hi], n)
                if not len(s.grams):
                    continue
                ids = s.set_ids()
                turn = turn or int(ids[s.row[0]] >> np.uint64(33))  # where this task begins
                once = np.zeros(len(ids), bool)
                once[np.unique(ids, return_index=True)[1]] = True
                keep = once[s.row]
                sets.append(ids[s.row[keep]])
                grams.append(s.grams[keep])
                size += int(pc.sum(pc.binary_length(arr[lo:hi])).as_py() or 0)
                if size >= SENT_BYTES:
                    yield flush(sets, grams, turn)
                    sets, grams, size, turn = [], [], 0, turn + 1
        if sets:
            yield flush(sets, grams, turn)

    return fn


def _count(slices: int, frequent: np.ndarray, rank: np.ndarray):
    """Those shingles of a slice that more than one set has, by bucket of the set."""

    def fn(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        owner = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in sent.column("sets")])
        gram = np.concatenate([_unpacked(x.as_buffer()) for x in sent.column("grams")])
        if key[0].as_py() >= slices:
            of = rank[np.searchsorted(frequent, gram)]
        else:
            order = np.argsort(gram)
            gram, owner = gram[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            count = np.diff(np.append(first, len(gram)))
            shared = np.repeat(np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first), count)
            of = np.repeat(_rank(count), count)[shared]
            gram, owner = gram[shared], owner[shared]
        order = np.argsort(owner)  # equal ids in a row take little space
        gram, owner, of = gram[order], owner[order], of[order]
        rows = [(at, o.tobytes(), _packed(g), r.tobytes()) for at, o, g, r in _cut((tc.signed(owner) % slices).astype(np.int32), owner, gram, of)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "sets", "grams", "rank"])

    return fn


def _enter(t: float):
    """The keys of the sets of a bucket that have any."""

    def fn(sets: pa.Table, back: pa.Table) -> pa.Table:
        ids, size = (sets.column(c).to_numpy() for c in ("set_id", "n"))
        order = np.argsort(ids.view(np.uint64))
        joined = lambda name, read: np.concatenate([np.zeros(0, np.uint64), *[read(x.as_buffer()) for x in back.column(name)]])
        owner, rank = joined("sets", lambda x: np.frombuffer(x, np.uint64)), joined("rank", lambda x: np.frombuffer(x, np.uint16).astype(np.uint64))
        s = Shared(ids.view(np.uint64)[order], size[order], owner, joined("grams", _unpacked), rank)
        edges = band_edges(t)
        keys = [tc.list_array(tc.signed(k), off, pa.int64()) for k, off in (sketch_keys(s, t, edges, step) for step in (0, 1))]
        has = pa.array(np.diff(np.asarray(keys[0].offsets)) + np.diff(np.asarray(keys[1].offsets)) > 0)
        return pa.Table.from_arrays([pa.array(ids[order]), *keys], names=["set_id", "own", "after"]).filter(has)

    return fn


def _entries(base: DataFrame, reps: DataFrame, n: int, t: float) -> DataFrame:
    """(set_id, own, after): the keys of each set in its own band and in the next."""
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = max(1, -(-total // SLICE))
    frequent, rank = _frequent(base, n) if slices > 4 else (np.zeros(0, np.uint64), np.zeros(0, np.uint16))
    back = base.select("text").mapInArrow(_send(n, slices, frequent), SENT).groupBy("slice").applyInArrow(_count(slices, frequent, rank), BACK)
    sets = reps.select(F.pmod("set_id", F.lit(slices)).cast("int").alias("bucket"), "set_id", "n")
    return sets.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(_enter(t), KEYS)


class Cells:
    """Rows of whole cells: which pairs of sets each one has to compare."""

    def __init__(self, part: pa.RecordBatch, n: np.ndarray, bits: Sketches, t: float):
        column = lambda name: part.column(name).to_numpy(zero_copy_only=False)
        names = [column(c) for c in ("cell", "meet", "low", "high")]
        new = np.ones(part.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in names], axis=0)
        self.n, self.bits, self.t, self.block, self.cross = n, bits, t, column("block"), names[2] != names[3]
        self.cuts = np.append(np.flatnonzero(new), part.num_rows)
        lists = part.column("before")
        off = np.asarray(lists.offsets).astype(np.int64)
        names, rank = np.unique(np.asarray(lists.values)[off[0] : off[-1]], return_inverse=True)
        self.off, self.rank, self.width = off - off[0], rank, len(names) + 1
        self.code = np.repeat(np.arange(part.num_rows), np.diff(off)) * self.width + rank

    def _near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of these pairs, those that this cell counts and that sizes and sketches allow."""
        a, b = self.n[i], self.n[j]
        ok = np.flatnonzero((np.minimum(a, b) >= self.t * np.maximum(a, b) - 1e-9) & (~self.cross[i] | (self.block[i] != self.block[j])))
        i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        ok = self.bits.distance(i, j) <= _allowed(a, b, self.t)
        i, j = i[ok], j[ok]
        ok = ~self._met_before(i, j)
        return i[ok], j[ok]

    def _met_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether both sets of a pair also have an earlier meeting in common."""
        count = self.off[i + 1] - self.off[i]
        pair = np.repeat(np.arange(len(i)), count)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.off[i], count)
        want = j[pair] * self.width + self.rank[at]
        found = np.searchsorted(self.code, want)
        hit = np.flatnonzero(found < len(self.code))
        hit = hit[self.code[found[hit]] == want[hit]]
        out = np.zeros(len(i), bool)
        out[pair[hit]] = True
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = np.diff(self.cuts)
        rows = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
        of = np.repeat(np.arange(len(size)), size)
        for lo in range(0, len(rows), CHUNK // 4):
            part = rows[lo : lo + CHUNK // 4]
            for step in range(1, SMALL):
                i = part[part + step < len(of)]
                i = i[of[i] == of[i + step]]
                if not len(i):
                    break
                yield self._near(i, i + step)
        for a, b in zip(self.cuts[:-1][size > SMALL].tolist(), self.cuts[1:][size > SMALL].tolist()):
            rows = max(1, CHUNK // (b - a))
            for lo in range(a, b, rows):
                i = np.arange(lo, min(b, lo + rows))
                i, j = np.repeat(i, b - lo), np.tile(np.arange(lo, b), len(i))
                up = i < j
                yield self._near(i[up], j[up])


def _sift(t: float):
    """The sets of each cell that have a pair there whose sketches don't rule it out."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "cell"):
            bits = Sketches.read(part.column("sketch"))
            has = np.zeros(part.num_rows, bool)
            for i, j in Cells(part, part.column("n").to_numpy(), bits, t).pairs():
                has[i] = has[j] = True
            yield part.drop_columns(["sketch"]).filter(pa.array(has))

    return fn


def union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the parts of each pair; a label is the smallest index of its part."""
    while True:
        a, b = label[i], label[j]
        if not (a != b).any():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


class Whole:
    """Whole sets of the rows of some cells, as sorted shingle hashes; ``n`` is 0 where the text is of another set."""

    def __init__(self, part: pa.RecordBatch, n: int):
        arr, want = tc.text_array(part.column("text")), part.column("set_id").to_numpy()
        grams, size = [np.zeros(0, np.uint64)], []
        for lo, hi in tc.slices(arr):
            s = Shingles(arr[lo:hi], n)
            size.append(np.where(tc.signed(s.set_ids()) == want[lo:hi], s.size, 0))
            grams.append(s.grams[np.repeat(size[-1] > 0, s.size)])
        self.grams, self.n = np.concatenate(grams), np.concatenate(size)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.row = np.repeat(np.arange(len(self.n)), self.n)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Size of the intersection of each pair, by looking up the smaller set."""
        swap = self.n[i] > self.n[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        names, rank = np.unique(self.grams, return_inverse=True)
        code = self.row * (len(names) + 1) + rank
        out = np.zeros(len(i), np.int64)
        ends = np.cumsum(self.n[i])
        lo = 0
        while lo < len(i):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20))))
            count = self.n[i[lo:hi]]
            pair = np.repeat(np.arange(hi - lo), count)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[i[lo:hi]], count)
            want = j[lo:hi][pair] * (len(names) + 1) + rank[at]
            found = np.minimum(np.searchsorted(code, want), len(code) - 1)
            out[lo:hi] = np.bincount(pair[code[found] == want], minlength=hi - lo)
            lo = hi
        return out

    def common_all(self, rows: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of all pairs of these rows, by products of incidence matrices."""
        owner = np.repeat(np.arange(len(rows)), self.n[rows])
        flat = np.concatenate([self.grams[self.first[r] : self.first[r + 1]] for r in rows.tolist()])
        _, gid, many = np.unique(flat, return_inverse=True, return_counts=True)
        shared = many[gid] > 1
        _, gid = np.unique(gid[shared], return_inverse=True)
        order = np.argsort(gid, kind="stable")
        gid, owner = gid[order], owner[shared][order]
        width = int(gid[-1]) + 1 if len(gid) else 0
        block = max(1, (4 << 20) // len(rows))
        out = np.zeros((len(rows), len(rows)), np.float32)
        for a in range(0, width, block):
            x, y = np.searchsorted(gid, [a, a + block])
            m = np.zeros((len(rows), min(block, width - a)), np.float32)
            m[owner[x:y], gid[x:y] - a] = 1
            out += m @ m.T
        return out.astype(np.int64)


def similar(whole: Whole, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Which of the candidate pairs are similar. Dense parts of the candidates are counted all at a time."""
    common = np.zeros(len(i), np.int64)
    label = union(np.arange(len(whole.n)), i, j)
    of = label[i]
    rows = np.bincount(label, minlength=len(label))
    many = np.bincount(of, minlength=len(label))
    dense = (rows > 16) & (many * 10 >= rows * (rows - 1) // 2)
    rest = ~dense[of]
    common[rest] = whole.common(i[rest], j[rest])
    place = np.zeros(len(label), np.int64)
    for part in np.flatnonzero(dense).tolist():
        inside = np.flatnonzero(label == part)
        place[inside] = np.arange(len(inside))
        at = np.flatnonzero(of == part)
        common[at] = whole.common_all(inside)[place[i[at]], place[j[at]]]
    return common >= t * (whole.n[i] + whole.n[j] - common) - 1e-9


FOUND = "set_id long, doc_id long, links long, low long"


def _verify(n: int, t: float):
    """(set, its document, links in the cell, smallest document of its part) of every set with a link."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "cell"):
            for part in _cell_slices(group):
                whole = Whole(part, n)
                cells = Cells(part, whole.n, Sketches.of(whole.row, whole.grams, whole.n), t)
                docs = part.column("doc_id").to_numpy()
                label, links = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
                found = [(i, j) for i, j in cells.pairs() if len(i)]
                if not found:
                    continue
                i, j = (np.concatenate(c) for c in zip(*found))
                ok = (whole.n[i] > 0) & (whole.n[j] > 0)
                i, j = i[ok], j[ok]
                ok = similar(whole, i, j, t)
                i, j = i[ok], j[ok]
                label = union(label, i, j)
                links += np.bincount(i, minlength=len(links)) + np.bincount(j, minlength=len(links))
                low = docs.copy()
                np.minimum.at(low, label, docs)
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([part.column("set_id").take(pa.array(at)), pa.array(docs[at]), pa.array(links[at]), pa.array(low[label[at]])], names=["set_id", "doc_id", "links", "low"])

    return fn


def _cell_slices(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of whole cells of about TEXT_BYTES of text."""
    cell = part.column("cell").to_numpy()
    cuts = np.append(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell))
    off = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(part.column("text")).fill_null(0)))])
    lo = 0
    while lo < len(cuts) - 1:
        hi = max(lo + 1, int(np.searchsorted(off[cuts], off[cuts[lo]] + TEXT_BYTES, side="right")) - 1)
        yield part.slice(cuts[lo], cuts[hi] - cuts[lo])
        lo = hi


def _meetings(sets: DataFrame) -> DataFrame:
    """``sets`` with ``at``: the (meet, blocks) of each of their hubs. Larger meetings have smaller numbers."""
    size = sets.select(F.explode("hubs").alias("hub"), "n").groupBy("hub").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    rank = 62 - F.floor(F.log2("sets")).cast("long")
    named = size.select(
        "hub",
        (F.shiftleft(rank, 56) + F.xxhash64("hub").bitwiseAND(F.lit((1 << 56) - 1))).alias("meet"),
        F.ceil(F.greatest(F.col("sets") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).alias("blocks"),
    )
    return sets.select("set_id", F.explode("hubs").alias("hub")).join(named, "hub").groupBy("set_id").agg(F.collect_set(F.struct("meet", "blocks")).alias("at"))


def _cells(sets: DataFrame) -> DataFrame:
    """A row for each cell that a set takes part in."""
    rows = sets.join(_meetings(sets), "set_id").select("set_id", "doc_id", "hash", "n", "sketch", F.array_sort(F.transform("at", lambda x: x["meet"])).alias("meets"), F.explode("at").alias("a"))
    rows = rows.selectExpr("*", "a.meet", "filter(meets, x -> x < a.meet) before", "pmod(xxhash64(set_id), a.blocks) block").drop("meets")
    rows = rows.selectExpr("*", "explode(sequence(0L, a.blocks - 1)) other").selectExpr("*", "least(block, other) low", "greatest(block, other) high")
    return rows.selectExpr("xxhash64(meet, low, high) cell", "meet", "low", "high", "block", "set_id", "doc_id", "hash", "n", "before", "sketch")


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell", "meet", "low", "high", "set_id")


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """(doc_id, hash of the text, class_id, n_links) of every row that has a doc_id."""
    band_edges(threshold)
    work = tc.Scratch(docs.sparkSession, "jaccard")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("hash", F.xxhash64("text"))
    every = work.keep(base.mapInArrow(_map_sets(n), SETS), "every")
    reps = work.keep(every.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "hash")).alias("m"), *[F.first(c).alias(c) for c in ("n", "sketch")]).selectExpr("set_id", "m.*", "n", "sketch"), "reps")
    entries = work.keep(_entries(base, reps, n, threshold), "entries").selectExpr("set_id", "inline(concat(transform(own, k -> struct(k as key, true as owned)), transform(after, k -> struct(k as key, false as owned))))")
    members = work.keep(every.select("doc_id", "hash", "set_id"), "members")
    work.drop("every")
    # a table, so that the next join can split a key that many sets have
    keys = work.keep(entries.groupBy("key").agg(F.min("set_id").alias("hub"), F.max("set_id").alias("other"), F.bool_or("owned").alias("used")).where("hub < other and used").select("key", "hub"), "keys")
    hubs = entries.select("key", "set_id").join(keys, "key").groupBy("set_id").agg(F.collect_set("hub").alias("hubs"))
    sets = work.keep(reps.select("set_id", "doc_id", "hash", "n", "sketch").join(hubs, "set_id"), "sets")
    columns = _cells(sets).drop("sketch").schema
    texts = base.where("text is not null").groupBy("hash").agg(F.first("text").alias("text"))
    chosen = work.keep(_by_cell(_cells(sets)).mapInArrow(_sift(threshold), columns), "chosen")
    work.drop("entries", "keys", "sets")
    found = work.keep(_by_cell(chosen.join(texts, "hash")).mapInArrow(_verify(n, threshold), FOUND), "found")
    work.drop("chosen")
    parts = components(found.select(F.col("doc_id").alias("doc_a"), F.col("low").alias("doc_b")), work)
    links = found.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    one = (
        reps.select("set_id", F.col("doc_id").alias("rep"))
        .join(links, "set_id", "left")
        .join(parts.select(F.col("doc_id").alias("rep"), "group"), "rep", "left")
        .select("set_id", F.coalesce("group", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    one = work.keep(one, "classes")
    work.drop("reps", "found")
    alone = members.where("set_id is null").select("doc_id", "hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return members.where("set_id is not null").join(one, "set_id").select("doc_id", "hash", "class_id", "n_links").union(alone)


def ngram_jaccard(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """(doc_id, class_id, n_links) of every document; see the module for what they mean."""
    return classes(docs, threshold, n).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))


def components(edges: DataFrame, work: tc.Scratch | None = None) -> DataFrame:
    """(doc_id, group): the smallest id reachable from each endpoint of (doc_a, doc_b) edges.

    Alternating large-star and small-star steps, which need a logarithmic number of rounds; every round
    is written to the shared folder, so that a lost executor never recomputes earlier rounds.
    """
    work = work or tc.Scratch(edges.sparkSession, "components")
    now = work.keep(edges.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u != v").distinct(), "edges0")
    seen, step = None, 0
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every node points its smaller neighbours, and itself, at the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        step += 1
        now = work.keep(small, f"edges{step}")
        work.drop(f"edges{step - 1}")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("doc_id")).distinct()
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("group")).union(roots.select("doc_id", F.col("doc_id").alias("group")))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """``docs`` with one document, that of the smallest doc_id, of each class.

    A row is judged by its own text. Defined cases: rows with a null doc_id stay, and so do null texts and
    texts without a word; repeated rows of the document that stays are all kept; an empty table stays
    empty; all columns, of whatever names, stay as they are.
    """
    gone = classes(docs, threshold, n).where("doc_id != class_id").select(F.col("doc_id").alias("id"), "hash").distinct()
    gone = gone.select(F.struct("id", "hash").alias("gone"))
    row = F.struct(docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("hash"))
    return docs.join(gone, row == gone["gone"], "left_anti")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(tc.documents(spark, sf_dir))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') ws from documents where doc_id is not null and text is not null),
 g as (select distinct doc_id, unnest(case when len(ws) < 3 then [array_to_string(ws, ' ')]
                    else list_transform(range(len(ws) - 2), lambda i: array_to_string(ws[i+1:i+3], ' ')) end) gram from w where len(ws) > 0),
 s as (select doc_id, count(*) n, md5(string_agg(gram, '|' order by gram)) set_id from g group by 1),
 m as (select set_id, min(doc_id) rep, any_value(n) n from s group by 1),
 r as (select rep, n, gram from m join g on g.doc_id = m.rep),
 p as (select a.rep as x, b.rep as y, any_value(a.n) nx, any_value(b.n) ny, count(*) c from r a join r b on a.gram = b.gram and a.rep < b.rep group by 1, 2),
 l as (select x, y from p where c >= 0.6 * (nx + ny - c) - 1e-9 union all select y, x from p where c >= 0.6 * (nx + ny - c) - 1e-9),
 d as (select x as rep, count(*) k from l group by 1),
 c as (select rep, rep as low from m union select l.y, c.low from c join l on l.x = c.rep where c.low < l.y),
 f as (select rep, min(low) as class_id from c group by 1)
select t.doc_id, coalesce(f.class_id, t.doc_id) as class_id, coalesce(d.k, 0)::bigint as n_links
from (select distinct doc_id from documents where doc_id is not null) t left join s using (doc_id) left join m using (set_id) left join f using (rep) left join d using (rep)
"""
