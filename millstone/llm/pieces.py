"""Splitting texts into repeating units before tokenization.

A byte-level tokenizer never merges across a space between two visible characters, so a text falls into
its space-separated chunks, which repeat a lot. ``encode_texts`` finds the distinct chunks of a slice of
rows, lets a callback encode just those, and spreads the token ids back over the rows with array
operations. Texts in which a space touches other white space are cut by the tokenizer's own pattern.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANK = r"\t\n\v\f\r\x1c-\x1f \x{85}\p{Z}"
_TOUCHING = rf"^ | $|[{_BLANK}] | [{_BLANK}]"
_compiled = regex.compile(PATTERN)

Lists = tuple[np.ndarray, np.ndarray]  # values, offsets


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pretokens(text: str) -> list[str]:
    return _compiled.findall(text)


def gather(lists: Lists, index: np.ndarray) -> Lists:
    """The lists with the given indices, one after the other."""
    values, off = lists
    start = off[index]
    n = off[index + 1] - start
    end = np.cumsum(n)
    at = np.repeat(start - end + n, n) + np.arange(int(end[-1]) if len(end) else 0)
    return values[at], np.concatenate([[0], end])


def joined(lists: Lists, groups: np.ndarray) -> Lists:
    """Lists of lists flattened: ``groups`` are offsets into the outer lists."""
    return lists[0], lists[1][groups]


def encode_texts(arr: pa.Array, encode_units: Callable[[list[str]], Lists]) -> Lists:
    """Token ids of each text of a large_string array without nulls."""
    rows = len(arr)
    odd = np.asarray(pc.match_substring_regex(arr, _TOUCHING)) if rows else np.zeros(0, bool)
    plain = arr.filter(pa.array(~odd))
    split = pc.split_pattern(plain, " ")
    coded = split.values[: split.offsets[-1].as_py()].dictionary_encode() if len(plain) else pa.array([], pa.string()).dictionary_encode()
    first = np.asarray(split.offsets)[:-1]
    code = np.asarray(coded.indices).astype(np.int64) * 2
    code[first] += 1
    words = coded.dictionary.to_pylist()
    present = np.zeros(2 * len(words), bool)
    present[code] = True
    used = np.flatnonzero(present)
    units = [words[c >> 1] if c & 1 else " " + words[c >> 1] for c in used.tolist()]
    code = (np.cumsum(present) - 1)[code]
    known: dict[str, int] = {}
    other: list[int] = []
    sizes = np.zeros(rows, np.int64)
    sizes[~odd] = np.diff(np.asarray(split.offsets))
    for r in np.flatnonzero(odd).tolist():
        cut = pretokens(arr[r].as_py())
        other += [known.setdefault(p, len(known)) for p in cut]
        sizes[r] = len(cut)
    unit = np.empty(int(sizes.sum()), np.int64)
    of_odd = np.repeat(odd, sizes)
    unit[~of_odd] = code
    unit[of_odd] = np.array(other, np.int64) + len(units)
    encoded = encode_units(units + list(known))
    values, off = gather(encoded, unit)
    return values, off[np.concatenate([[0], np.cumsum(sizes)])]
