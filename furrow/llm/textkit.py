"""Vectorised helpers that run inside Arrow tasks: word spans, word hashes and shingles of a batch of texts.

A batch of strings is one UTF-8 buffer with offsets, so words of all texts are found and hashed by a few
numpy passes over that buffer instead of a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked through in slices of about so many bytes (a longer text is a slice of its own).
SLICE_BYTES = 1 << 18

_BASE = 0x9E6C63D0876A9A63
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_COEFFS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _lut(separators: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[separators] = True
    return out


#: Words ``[^\x20\x09-\x0D]+``.
SPACE = _lut([0x20, *range(0x09, 0x0E)])
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lower-cased.
NOT_ALNUM = _lut([i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122)])
_FOLD = np.arange(256)
_FOLD[65:91] += 32


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: one thing at a time."""
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Drops what another operator's tasks have left in this worker process."""
    _KEPT.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES["pow"]) < n:
        size = 1 << int(n).bit_length()
        for name, base in (("pow", _BASE), ("inv", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES["pow"][:n], _TABLES["inv"][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes."""
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of Python strings."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=off[1:])
    return np.frombuffer(b"".join(raw), np.uint8), off


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (with the total at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separators[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    begin[off[:-1][full]] = inside[off[:-1][full]]
    finish[off[1:][full] - 1] = inside[off[1:][full] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words (A-Z as a-z if ``fold``), by prefix sums of a polynomial hash.

    A word's hash doesn't depend on its place, so runs of words of about ``SLICE_BYTES`` are hashed one after another;
    tables and sums stay as small, however long the data is.
    """
    values = _VALUES[_FOLD] if fold else _VALUES
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE_BYTES, "right")))
        lo, hi = starts[a], ends[b - 1]
        power, inverse = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * power[:-1], out=sums[1:])
        begin, size = starts[a:b] - lo, (ends[a:b] - starts[a:b]).astype(np.uint64)
        out[a:b] = mix((sums[ends[a:b] - lo] - sums[begin]) * inverse[begin] + size)
        a = b
    return out


def windows(hashes: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words of one text, and each text's first run.

    With ``short`` a text of fewer words, but not none, has its whole sequence as one run.
    """
    n = np.diff(first)
    counts = np.maximum(n - k + 1, 0)
    total = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for j in range(k if len(total) else 0):
        total += hashes[j : j + len(total)] * _COEFFS[j % 64] + np.uint64(j // 64)
    where = np.repeat(first[:-1], counts) + _within(counts)
    runs = mix(total[where]) if len(where) else np.zeros(0, np.uint64)
    if short and (few := np.flatnonzero((n > 0) & (n < k))).size:
        alone = []
        for i in few:
            w = hashes[first[i] : first[i + 1]]
            alone.append((int((w * _COEFFS[: len(w)]).sum(dtype=np.uint64)) + len(w) * 0xD6E8FEB86659FD93) % (1 << 64))
        counts[few] = 1
        at = np.cumsum(counts) - counts
        out = np.zeros(counts.sum(), np.uint64)
        lone = np.zeros(len(out), bool)
        lone[at[few]] = True
        out[lone], out[~lone] = mix(np.array(alone, np.uint64)), runs
        runs = out
    return runs, np.concatenate([[0], np.cumsum(counts)])


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[i]-1 for each i, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def distinct(runs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and each text's first."""
    parts = [np.unique(runs[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate(parts) if parts else runs[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
