"""Vectorised tokenising of Arrow text columns, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow = _inv = np.ones(1, np.uint64)

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate words of digits, lower-case letters and all non-ASCII.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x80] = True
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x61:0x7B] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_PLACES = 64
_PLACED = mixed(np.arange(_PLACES << 8, dtype=np.uint64) * _P + _P)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, 2 * len(_pow), 1 << 16)
        for name, base in (("_pow", _P), ("_inv", _INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            globals()[name] = np.cumprod(x, dtype=np.uint64)
    return _pow, _inv


class Texts(NamedTuple):
    """Rows of a record batch with their texts as one run of bytes."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray  #: of each row's text, and the end


def _texts(rows: pa.RecordBatch, column: str) -> Texts:
    col = rows.column(column)
    col = col.fill_null("") if col.null_count else col
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and len(off) else np.zeros(0, np.uint8)
    return Texts(rows, data, off - off[0])


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 19) -> Iterator[Texts]:
    """Slices of the batches of about ``most`` text bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = _texts(batch, column)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(whole.offsets, whole.offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            base = whole.offsets[at]
            yield Texts(batch.slice(at, to - at), whole.data[base : whole.offsets[to]], whole.offsets[at : to + 1] - base)
            at = to


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  #: index of each row's first word, and the number of words
    hash: np.ndarray  #: 64 bits of each word


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _byte_values(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64 random bits for every byte and its place in its word (``start``: where words begin)."""
    n = len(data)
    origin = np.zeros(n, np.int32)
    origin[start] = start
    np.maximum.accumulate(origin, out=origin)
    place = np.arange(n, dtype=np.int32)
    place -= origin
    late = np.flatnonzero(place >= _PLACES)
    far = (place[late].astype(np.uint64) << np.uint64(8)) | data[late]
    np.minimum(place, _PLACES - 1, out=place)
    place <<= 8
    place |= data
    out = _PLACED.take(place)
    out[late] = mixed(far * _P + _P)
    return out


def words(texts: Texts, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    """Maximal runs of bytes that aren't separators; runs end with their row.

    A word's hash sums random values of its bytes and their places, so that, unlike
    in a polynomial modulo 2^64, no words have equal hashes by their build.
    """
    data = lowered(texts.data) if lower else texts.data
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~separators[data]
    begin = np.zeros(n + 1, bool)
    begin[texts.offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begin[1:]
    stop = np.zeros(n + 1, bool)
    stop[1:] = inside[:-1] & (~inside[1:] | begin[1:])
    s, e = np.flatnonzero(start), np.flatnonzero(stop)
    first = np.searchsorted(s, texts.offsets)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values(data, s), out=total[1:])
    return Words(s, e, first, mixed(total[e] - total[s] + (e - s).astype(np.uint64)))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k consecutive values (len(h) - k + 1 of them)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=total[1:])
    return mixed((total[k:] - total[: n - k + 1]) * inverse[: n - k + 1])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    y, have = x, 1
    while have < w:
        step = min(have, w - have)
        y = np.minimum(y[: len(y) - step], y[step:])
        have += step
    return y
