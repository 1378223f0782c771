"""Periodic runs of words: where a text repeats a stretch of words four times or more.

A run is a stretch of words with smallest period q and at least
``max(LEAST_LENGTH, LEAST_POWER * q)`` words that can't be extended. Words q apart
match over a stretch of at least ``(LEAST_POWER - 1) * q`` words there, so for each
period q a grid of points that far apart meets every run of it: n log n pairs of a
period and a grid point (a harmonic sum) for n words.

1. Words become 64-bit values, and texts of one slice prefix hashes modulo two primes.
2. Of all pairs of all texts of the slice, those whose two words match get the longest
   common extensions to both sides by binary search on the prefix hashes, all pairs at
   once, in blocks of bounded size.
3. Stretches of one start and end are one run: its smallest period is the least found,
   since a shorter period of such a stretch has the same extent.
4. Each run's words are compared as bytes. Equal words have equal hashes, so no run is
   missed; a stretch that hashes alone made equal starts the slice anew with other primes' bases.

Documents need no shuffle. Memory is that of a slice of texts, or of one longer text.

Defined results: a null text has no words and no runs; null doc_ids get no planted
period (see ``planted``); equal rows get equal results; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._bytes import chunks, mixed, words

LEAST_LENGTH, LEAST_POWER = 6, 4
BLOCK = 1 << 18  #: pairs that are extended together
PRIMES = (2147483647, 2147483629)
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _powers_mod(base: int, n: int, prime: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), prime))
        out = np.concatenate((out, out * step % np.uint64(prime)))
    return out[:n]


class _Prefixes:
    """Prefix hashes of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, seed: int):
        n = len(values)
        self.parts = []
        for k, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            salt = mixed(np.array([2 * seed + k + 1], np.uint64))[0]
            power = _powers_mod(int(salt % np.uint64(prime - 1000)) + 500, n + 1, prime)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(mixed(values + salt) % p * power[:n] % p, out=total[1:])  # terms are below 2^31: no overflow
            self.parts.append((total % p, power, p))

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n values from i and from j (i < j) have equal hashes."""
        out = np.ones(len(i), bool)
        for total, power, p in self.parts:
            left, right = total[i + n] + p - total[i], total[j + n] + p - total[j]
            out &= left % p * power[j - i] % p == right % p
        return out


def _longest(most: np.ndarray, fits) -> np.ndarray:
    """The largest length up to ``most`` that fits, for each pair; what fits, fits for all shorter ones."""
    got = np.zeros(len(most), np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step := step >> 1:
        new = got + step
        try_ = np.flatnonzero(new <= most)
        ok = try_[fits(try_, new[try_])]
        got[ok] = new[ok]
    return got


def _distinct(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per stretch, with the least period."""
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return start[first], stop[first], period[first]


def find_runs(values: np.ndarray, first: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs of the texts values[first[k]:first[k + 1]], ordered by start and period."""
    n = np.diff(first)
    most = n // LEAST_POWER
    text = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    stride = (LEAST_POWER - 1) * period
    points = -(-(n[text] - period) // stride)  # the grid points whose partner lies in the text
    upto = np.cumsum(points)
    prefixes = _Prefixes(values, seed)
    found = [(np.zeros(0, np.int64),) * 3]
    for lo in range(0, int(upto[-1]) if len(upto) else 0, BLOCK):
        pair = np.arange(lo, min(lo + BLOCK, int(upto[-1])))
        of = np.searchsorted(upto, pair, side="right")
        p, k = period[of], text[of]
        i = first[k] + stride[of] * (pair - upto[of] + points[of])
        match = values[i] == values[i + p]
        i, p, k = i[match], p[match], k[match]
        if not len(i):
            continue
        forth = _longest(first[k + 1] - i - p, lambda x, m: prefixes.equal(i[x], i[x] + p[x], m))
        back = _longest(i - first[k], lambda x, m: prefixes.equal(i[x] - m, i[x] + p[x] - m, m))
        start, stop = i - back, i + p + forth
        whole = stop - start >= np.maximum(LEAST_LENGTH, LEAST_POWER * p)
        found.append(_distinct(start[whole], stop[whole], p[whole]))
    start, stop, p = _distinct(*(np.concatenate(x) for x in zip(*found)))
    order = np.lexsort((p, start))
    return start[order], stop[order], p[order]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Place and period of the repetition that the evaluation plants in a tenth of the documents; None for the others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _periodic(own: list[bytes], runs: list[tuple[int, int, int]]) -> bool:
    """Whether the words of the runs have the periods that the hashes gave them."""
    return all(own[s : e - p] == own[s + p : e] for s, e, p in runs)


def _report(own: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    gone = np.zeros(len(own) + 1, np.int64)
    for s, e, p in runs:
        gone[s + p] += 1
        gone[e] -= 1
    gone = np.cumsum(gone)
    kept = [w for w, x in zip(own, gone.tolist()) if not x] if runs else own
    told = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
    best = min(((s - e, s, p) for s, e, p in runs), default=None)
    shown = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    return len(runs), *shown, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def _scan(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        w = words(part)
        ids = part.rows.column("doc_id").to_pylist()
        own = [part.data[a:b].tobytes().split() for a, b in zip(part.offsets, part.offsets[1:])]
        values = w.hash
        if plant:
            values = values.copy()
            for k, doc_id in enumerate(ids):
                if at := planted(doc_id, len(own[k])):
                    a, p = at
                    to = np.arange(a, len(own[k]))
                    to = a + (to - a) % p
                    values[w.first[k] + a : w.first[k + 1]] = w.hash[w.first[k] + to]
                    own[k] = own[k][:a] + [own[k][x] for x in to.tolist()]
        for seed in range(99):
            start, stop, period = find_runs(values, w.first, seed)
            cut = np.searchsorted(start, w.first)
            runs = [[*zip((start[a:b] - o).tolist(), (stop[a:b] - o).tolist(), period[a:b].tolist())] for a, b, o in zip(cut, cut[1:], w.first)]
            if all(map(_periodic, own, runs)):
                break
        else:
            raise RuntimeError("the words of a run are not periodic under any hash")
        rows = [*zip(*map(_report, own, runs))]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([part.rows.column("doc_id"), *[pa.array(x, t) for x, t in zip(rows, kinds)]], names=["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]])


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id and the runs of its text; ``plant`` sets the evaluation's repetitions into the texts first."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda x: _scan(x, plant), f"doc_id {kind}, {SCHEMA}")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)


#: Five matching words stand in every run, so equal words are joined five at a time.
OP12_SQL = r"""
WITH c AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
  xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS h FROM documents),
q AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM c),
d AS (SELECT r, doc_id, n, list_transform(range(n), lambda i: CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] ELSE w[i + 1] END) AS w FROM q),
g AS (SELECT r, n, i, md5(array_to_string(w[i + 1:i + 5], ' ')) AS g FROM (SELECT r, n, w, unnest(range(n - 4)) AS i FROM d WHERE n >= 5)),
m AS (SELECT a.r, a.i, b.i - a.i AS p FROM g AS a JOIN g AS b ON a.r = b.r AND a.g = b.g AND b.i > a.i WHERE 4 * (b.i - a.i) <= a.n),
s AS (SELECT r, p, min(i) AS start, count(*) + 4 + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM m) GROUP BY r, p, k),
u AS (SELECT r, start, length, min(p) AS period FROM s WHERE length >= greatest(6, 4 * p) GROUP BY r, start, length),
o AS (SELECT r, count(*) AS n_runs, min_by([start, length, period], [-length, start, period]) AS best, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs FROM u GROUP BY r),
x AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
k AS (SELECT t.r, string_agg(word, ' ' ORDER BY t.i) AS kept FROM (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM d) AS t ANTI JOIN x ON t.r = x.r AND t.i = x.i GROUP BY t.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN o USING (r) LEFT JOIN k USING (r)
"""
