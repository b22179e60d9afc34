"""Secret scanning with a linear-chain conditional random field.

Tokens (runs of letters and digits, or of punctuation) are tagged O, B (secret begins) or I (inside).
Features are the token's shape, its length and mix of character classes, the words and shapes around it,
and features of the whole document (density of digits and punctuation). Weights are trained here by
maximum likelihood (forward-backward, Adam) on ``SNIPPETS`` places of each of at most ``TRAIN_DOCS``
documents (those of the smallest hashes of doc_id and text), and on every assignment to a credential word
in them: text of the corpus, with credentials that follow an assignment to a credential word, or that the
generator below plants in known formats, as positives, and numbers, addresses, hashes without a
credential word and ordinary words as negatives.

Decoding is Viterbi. A token whose O score exceeds the others by more than any change of transitions
could repay is O on every best path, so sequences are cut there and only the stretches between are
decoded; the result is that of decoding the whole text.

Defined cases: a null, empty or blank text has no secret; a null doc_id is kept null in the result;
repeated rows are scanned each; a very long text is scanned whole, and a very long token is a token like
any other; an empty table gives no rows; other columns are ignored. Ties between paths go to O before B
before I.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.llm import textcore as tc
from millstone.llm.language_id import sample_rows

TRAIN_DOCS = 300
SNIPPETS = 3
MASK = "[SECRET]"
RESULT = "doc_id long, start_char long, n_chars long, n_tokens long, score double"
LABELS = 3  # O, B, I
ORDER = 0  # index of the O label
REACH = 4  # neighbouring tokens to the left whose words count
WORD_BUCKETS = 1 << 14
_OFFSETS = (-4, -3, -2, -1, 0, 1)

#: bit set of the character classes a byte belongs to
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] |= 1
_CLASS[65:91] |= 2
_CLASS[48:58] |= 4
_CLASS[[*range(103, 123), *range(71, 91)]] |= 8  # letters that no hexadecimal number has
_CLASS[128:] |= 16
_CLASS[[33, 36, 37, 38, 42, 35, 124, 44, 59, 46, 63]] |= 32  # punctuation of prose and of noise
_CLASS[[34, 39, 61, 58, 95, 45, 43, 47, 96]] |= 64  # quotes, assignment, and what joins the parts of a key
_KIND = np.where(tc.WORDCHAR, 1, 2).astype(np.uint8)
_KIND[np.flatnonzero(tc.SPACE)] = 0

N_SHAPE = 128 * 16
GROUPS = [WORD_BUCKETS * len(_OFFSETS), N_SHAPE, N_SHAPE, N_SHAPE, 64, 16, 16]
BASES = np.concatenate([[0], np.cumsum(GROUPS)])


@dataclass
class Model:
    weight: np.ndarray  # (features, 3)
    trans: np.ndarray  # (3, 3), from -> to
    start: np.ndarray


class Tokens:
    """Tokens of consecutive rows; ``first`` is the first token of each row."""

    def __init__(self, data: np.ndarray, row_off: np.ndarray):
        kind = _KIND[data]
        edge = np.ones(len(data) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[row_off] = True
        cuts = np.flatnonzero(edge)
        if len(data):
            keep = kind[cuts[:-1]] > 0
            self.start, self.end = cuts[:-1][keep], cuts[1:][keep]
        else:
            self.start = self.end = cuts[:0]
        self.data, self.row_off = data, row_off
        self.first = np.searchsorted(self.start, row_off)

    def __len__(self):
        return len(self.start)


def features(t: Tokens) -> np.ndarray:
    """(tokens, columns) indices into the weight table; -1 means none."""
    n = len(t)
    if not n:
        return np.zeros((0, len(_OFFSETS) + 6), np.int32)
    size = t.end - t.start
    cls = _CLASS[t.data]
    seen = np.bitwise_or.reduceat(cls, np.stack([t.start, np.minimum(t.end, len(cls) - 1)], 1).ravel())[::2] if n else cls[:0]
    last = t.end == len(cls)
    if last.any():  # reduceat has no end past the array: take the last token apart
        i = int(np.flatnonzero(last)[0])
        seen[i] = np.bitwise_or.reduce(cls[t.start[i] : t.end[i]])
    bucket = np.minimum(15, np.where(size < 8, size, 5 + np.log2(np.maximum(size, 1)).astype(np.int64)))
    digit = (cls & 4) > 0
    turn = np.zeros(len(cls) + 1, np.int32)
    np.cumsum(digit[1:] != digit[:-1], out=turn[2:])
    turns = turn[np.maximum(t.end, 1)] - turn[t.start + 1]
    shape = (seen.astype(np.int64) & 127) * 16 + bucket
    words = tc.Words.__new__(tc.Words)
    words.data, words.row_off, words.start, words.end, words.first = t.data, t.row_off, t.start, t.end, t.first
    word = (words.hashes(fold=True) >> np.uint64(64 - 14)).astype(np.int64)
    row = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    out = np.full((n, len(_OFFSETS) + 6), -1, np.int32)
    for c, o in enumerate(_OFFSETS):
        a, b = max(0, -o), n - max(0, o)
        if b <= a:
            continue
        same = row[a:b] == row[a + o : b + o]
        out[a:b, c] = np.where(same, BASES[0] + c * WORD_BUCKETS + word[a + o : b + o], -1)
    for c, o in enumerate((-1, 0, 1)):
        a, b = max(0, -o), n - max(0, o)
        if b > a:
            out[a:b, len(_OFFSETS) + c] = np.where(row[a:b] == row[a + o : b + o], BASES[1 + c] + shape[a + o : b + o], -1)
    c = len(_OFFSETS) + 3
    out[:, c] = BASES[4] + np.minimum(63, turns)
    run = np.concatenate([[0], np.cumsum(digit)])
    marks = np.concatenate([[0], np.cumsum((cls & 96) > 0)])
    for k, total in enumerate((run, marks)):
        share = (total[t.row_off[1:]] - total[t.row_off[:-1]]) / np.maximum(1, np.diff(t.row_off))
        out[:, c + 1 + k] = BASES[5 + k] + np.minimum(15, (share * 64).astype(np.int64))[row]
    return out


def emissions(feat: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(tokens, 3) sums of the weights of each token's features; ``weight`` ends with a row of zeros."""
    out = np.zeros((len(feat), LABELS), np.float32)
    for c in range(feat.shape[1]):
        out += weight.take(feat[:, c], axis=0, mode="wrap")
    return out


def slack(m: Model) -> float:
    """The most that transitions can gain by a label other than O at one token."""
    into = np.vstack([m.trans, m.start[None, :]])  # from each label, or from the start
    out = np.hstack([m.trans, np.zeros((LABELS, 1))])  # to each label, or to the end
    worst = 0.0
    for y in (1, 2):
        worst = max(worst, float((into[:, y] - into[:, ORDER]).max() + (out[y] - out[ORDER]).max()))
    return worst


def viterbi(e: np.ndarray, first: np.ndarray, m: Model) -> np.ndarray:
    """Best labels of the sequences that start at ``first`` (which ends with the number of tokens)."""
    n = len(e)
    label = np.zeros(n, np.int8)
    if not n:
        return label
    open_ = e[:, ORDER] - np.maximum(e[:, 1], e[:, 2]) <= slack(m) + 1e-6
    starts = np.zeros(n + 1, bool)
    starts[first[:-1][np.diff(first) > 0]] = True
    begin = np.flatnonzero(open_ & (starts[:-1] | ~np.concatenate([[False], open_[:-1]])))
    if not len(begin):
        return label
    stop = np.flatnonzero(open_ & (starts[1:] | ~np.concatenate([open_[1:], [False]]))) + 1
    length = stop - begin
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    enters = np.where(starts[begin][:, None], m.start[None, :], m.trans[ORDER][None, :])
    leaves = np.where((stop[order] < n) & ~starts[stop[order]], 1.0, 0.0)[:, None] * m.trans[:, ORDER][None, :]
    score = e[begin].astype(np.float64) + enters
    back = np.zeros((int(length.sum()), LABELS), np.int8)
    at, places = len(begin), [np.arange(len(begin))]
    for step in range(1, int(length[0])):
        live = int(np.searchsorted(-length, -step, side="left"))
        cand = score[:live, :, None] + m.trans[None]
        arg = cand.argmax(1)
        score[:live] = np.take_along_axis(cand, arg[:, None, :], 1)[:, 0] + e[begin[:live] + step]
        back[at : at + live] = arg
        places.append(np.arange(at, at + live))
        at += live
    now = (score + leaves).argmax(1)
    for step in range(int(length[0]) - 1, -1, -1):
        live = int(np.searchsorted(-length, -step, side="left"))
        label[begin[:live] + step] = now[:live]
        if step:
            now[:live] = back[places[step], now[:live]]
    return label


# ---- training ---------------------------------------------------------------------------------------

_NAMES = ["token", "api_key", "apikey", "secret", "secret_key", "password", "passwd", "pwd", "access_key", "auth_token", "client_secret", "private_key", "key", "credential", "secretAccessKey", "aws_secret_access_key", "authenticationToken", "clientSecretKey", "authorization", "subscriptionKey", "connectionPassword"]
_GIVEN = re.compile(r"(?i)(?:\b|_)(?:token|api_?key|secret|secret_key|access_key|password|passwd|pwd|private_key|credential|secretaccesskey|authenticationtoken|clientsecretkey|authorization|subscriptionkey|connectionpassword)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_\-+/.=]{12,})")


def _draw(rng: np.random.Generator) -> str:
    """A made-up credential in one of the public formats."""
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kind = rng.integers(0, 8)
    if kind <= 2:
        return pick("0123456789abcdef", int(rng.choice([32, 40, 40, 64])))
    if kind == 3:
        return "AKIA" + pick(upper + digits, 16)
    if kind == 4:
        return str(rng.choice(["ghp_", "glpat-", "sk-", "xoxb-"])) + pick(lower + upper + digits, 36)
    if kind == 5:
        return pick(lower + upper + digits + "+/", 40)
    if kind == 6:
        return "eyJ" + pick(lower + upper + digits, 20) + "." + pick(lower + upper + digits, 40) + "." + pick(lower + upper + digits + "_-", 30)
    return pick(lower + upper + digits, int(rng.integers(16, 33)))


def _decoy(rng: np.random.Generator) -> str:
    d = lambda n: "".join(rng.choice(list("0123456789"), n))
    return str(
        rng.choice(
            [d(16), d(int(rng.integers(5, 14))), f"{d(3)}.{d(3)}.{d(2)}.{d(3)}", f"a.{d(2)}@mail{d(1)}.example.com", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"{d(4)}-{d(2)}-{d(2)}", f"id = {d(6)}", f'name = "{d(4)}"', f"key: {d(2)}", f"token {d(2)}", "the secret of", "password is", 'class = "main"', f"v{d(1)}.{d(1)}.{d(2)}"]
        )
    )


def examples(texts: list[str], seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """(snippet, character spans of its secrets)."""
    rng = np.random.default_rng(seed)
    out: list[tuple[str, list[tuple[int, int]]]] = []
    for text in texts:
        hits = [m.span(1) for m in _GIVEN.finditer(text)]
        for a, b in hits:
            lo, hi = max(0, a - 120), min(len(text), b + 80)
            out.append((text[lo:hi], [(x - lo, y - lo) for x, y in hits if lo <= x and y <= hi]))
        words = text.split()
        if len(words) < 8:
            continue
        for _ in range(SNIPPETS):
            at = int(rng.integers(0, len(words)))
            left, right = " ".join(words[max(0, at - 14) : at]), " ".join(words[at : at + 10])
            if _GIVEN.search(left + " " + right):
                continue
            how = rng.integers(0, 3)
            if how == 0:
                out.append((left + " " + right, []))
            elif how == 1:
                out.append((f"{left} {_decoy(rng)} {right}", []))
            else:
                name, value = str(rng.choice(_NAMES)), _draw(rng)
                if rng.random() < 0.2:
                    name, value = name.upper(), value.upper()
                quote = str(rng.choice(['"', '"', "'", ""]))
                head = f"{left} {name}{rng.choice([' = ', '=', ': ', ':'])}{quote}"
                out.append((f"{head}{value}{quote} {right}", [(len(head), len(head) + len(value))]))
    return out


def _encoded(snippets):
    feats, labels = [], []
    for text, spans in snippets:
        data = np.frombuffer(text.encode(), np.uint8)
        t = Tokens(data, np.array([0, len(data)]))
        if not len(t):
            continue
        y = np.zeros(len(t), np.int64)
        for a, b in spans:
            x, z = len(text[:a].encode()), len(text[:b].encode())
            hit = np.flatnonzero((t.start >= x) & (t.end <= z))
            y[hit] = 2
            y[hit[:1]] = 1
        feats.append(features(t))
        labels.append(y)
    return feats, labels


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(texts: list[str], steps: int = 80, l2: float = 2e-5) -> Model:
    """Maximum-likelihood weights; padded sequences, so a step is a few array operations a position."""
    feats, labels = _encoded(examples(texts) or examples(["some plain text of ordinary words without any numbers in it"] * 40))
    top = max(len(y) for y in labels)
    n, width = len(labels), feats[0].shape[1]
    f = np.full((n, top, width), -1, np.int32)
    y = np.zeros((n, top), np.int64)
    live = np.zeros((n, top), bool)
    for i, (a, b) in enumerate(zip(feats, labels)):
        f[i, : len(b)], y[i, : len(b)], live[i, : len(b)] = a, b, True
    used, local = np.unique(f[f >= 0], return_inverse=True)
    slot = np.full(f.shape, len(used), np.int64)
    slot[f >= 0] = local
    w, trans, start = np.zeros((len(used) + 1, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)
    m1, m2 = [np.zeros_like(p) for p in (w, trans, start)], [np.zeros_like(p) for p in (w, trans, start)]
    eye, rows = np.eye(LABELS), np.arange(n)
    gold = eye[y] * live[..., None]
    pair_gold = np.zeros((LABELS, LABELS))
    both = live[:, 1:]
    np.add.at(pair_gold, (y[:, :-1][both], y[:, 1:][both]), 1)
    flat_slot = slot.reshape(-1, width)
    for step in range(1, steps + 1):
        e = w[slot].sum(2)
        alpha, beta = np.zeros((n, top, LABELS)), np.zeros((n, top, LABELS))
        alpha[:, 0] = e[:, 0] + start
        for t in range(1, top):
            nxt = e[:, t] + _logsum(alpha[:, t - 1, :, None] + trans[None], 1)
            alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
        z = _logsum(alpha[:, -1], 1)
        for t in range(top - 2, -1, -1):
            prv = _logsum(trans[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], prv, 0)
        post = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + trans[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        diff = (post - gold).reshape(-1, LABELS)
        gw = np.stack([np.bincount(flat_slot.ravel(), np.repeat(diff[:, k], width), minlength=len(w)) for k in range(LABELS)], 1)
        gw[-1] = 0
        grads = [gw / n + l2 * w, (pair.sum((0, 1)) - pair_gold) / n + l2 * trans, (post[:, 0] - gold[:, 0]).sum(0) / n + l2 * start]
        for k, (p, g) in enumerate(zip((w, trans, start), grads)):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            p -= 0.1 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    del rows
    weight = np.zeros((BASES[-1] + 1, LABELS), np.float32)
    weight[used] = w[:-1]
    return Model(weight, trans, start)


def fit(docs: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    rows = sample_rows(docs.where("text is not null"), ["doc_id", "text"], limit).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    return train([r["text"] for r in rows])


# ---- inference --------------------------------------------------------------------------------------


def scan(arr: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Secrets of a text array: (row, first byte, end byte, tokens, mean margin over O)."""
    data, off = tc.flat(arr)
    t = Tokens(data, off)
    e = emissions(features(t), model.weight)
    label = viterbi(e, t.first, model)
    hit = np.flatnonzero(label > 0)
    if not len(hit):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(float)
    row = np.searchsorted(t.first, hit, side="right") - 1
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (label[hit[1:]] == 1) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(hit)) - 1
    margin = np.add.reduceat((e[hit].max(1) - e[hit, 0]).astype(float), at) / (end - at + 1)
    return row[at], t.start[hit[at]], t.end[hit[end]], end - at + 1, margin


def _chars(data: np.ndarray, a: int, b: int) -> int:
    return int(((data[a:b] & 0xC0) != 0x80).sum())


def _scan_batches(model: Model):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr, docs = tc.text_array(batch.column("text")), batch.column("doc_id")
            for lo, hi in tc.slices(arr):
                part = arr[lo:hi]
                row, a, b, n, score = scan(part, model)
                if len(row):
                    data, off = tc.flat(part)
                    start = [_chars(data, off[r], x) for r, x in zip(row, a)]
                    size = [_chars(data, x, y) for x, y in zip(a, b)]
                    yield pa.RecordBatch.from_arrays([docs[lo:hi].take(pa.array(row)), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(n.astype(np.int64)), pa.array(score)], names=["doc_id", "start_char", "n_chars", "n_tokens", "score"])

    return fn


def secret_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start_char, n_chars, n_tokens, score) of every secret found, one row a secret."""
    model = model or fit(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan_batches(model), RESULT)


def _mask_batches(model: Model):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr = tc.text_array(batch.column("text"))
            i, j = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            for lo, hi in tc.slices(arr):
                part, piece = arr[lo:hi], batch.slice(lo, hi - lo)
                row, a, b, _, _ = scan(part, model)
                if len(row):
                    data, off = tc.flat(part)
                    texts = piece.column(i).to_pylist()
                    sizes = piece.column(j).to_pylist() if j >= 0 else [None] * len(texts)
                    for r in np.unique(row).tolist():
                        raw, done, out = data[off[r] : off[r + 1]].tobytes(), 0, []
                        for x, y in zip(a[row == r] - off[r], b[row == r] - off[r]):
                            out += [raw[done:x], MASK.encode()]
                            done = int(y)
                        texts[r] = b"".join([*out, raw[done:]]).decode()
                        sizes[r] = len(texts[r])
                    piece = piece.set_column(i, piece.schema.field(i), pa.array(texts, pa.string()))
                    if j >= 0:
                        piece = piece.set_column(j, piece.schema.field(j), pa.array(sizes, piece.schema.field(j).type))
                yield piece

    return fn


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]``; no document goes, n_chars is renewed where there is one.

    Defined cases: null, empty and blank texts stay as they are, as does every text without a secret; rows
    with a null doc_id are masked like any other; repeated rows are masked each; an empty table stays empty.
    """
    return tc.map_batches(docs, _mask_batches(fit(docs)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(tc.documents(spark, sf_dir))
