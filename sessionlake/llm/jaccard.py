"""Similarity join of documents on word n-grams: size-aware, heavy and light.

Documents with equal shingle sets form a class; the join is between classes.

* Light sets (at most ``boundary`` shingles): all their subsets of the sizes
  that a partner's overlap can have are enumerated; linked light sets share one.
* Heavy sets: scanned through inverted lists. In an order of all shingles that
  puts common ones last, two linked sets share one of their first
  ``n - ceil(t n) + 1`` shingles; SPARE percent more are listed, so that they
  share as many, and a set that shares fewer with all others together links with
  nothing. Light sets just under the boundary are listed too, for their heavy
  partners.

The boundary is the largest size at which enumerating costs no more than
scanning; the mean length of the lists that small sets scan is counted over all
classes. The order of shingles comes from a sketch of SKETCH counters to which
every document adds; common shingles stand out of it at any size, and no link
depends on it.

Candidates are linear in the length of a list. A list of at most FEW sets gives
its pairs. A longer one gives a star: every set of it and the list's least one,
its pivot. Comparing all members with their pivot leaves, for each, its
difference from the pivot, and differences of two members differ by just what
the members differ by. So members that link must have differences that overlap
(two that are both close to the pivot are linked through it), and the members
are joined once more on the first elements of their differences, those outside
the pivot first. Copies of one text, each with its own changes, share hardly
any of these. Where lists of such elements are long again they give stars again.
Lists of one group of near copies have several least sets, and so the group would
give as many stars. So a set leaves the stars with which it shares fewest shingles,
up to a quarter of the spare ones: two linked sets leave fewer together than they
share. And a star whose members are all in a larger one is left out, since any two
of them meet there. What is left is a row for each member, star and first
element of a difference, of which a member far from its pivot has many.
Two members that share such an element become a candidate only if their
parities allow it: a set's parity is BITS bits, each saying whether an odd number
of its shingles falls on it, and two sets are apart by as many shingles at least
as their parities by bits. So no link is lost.

Class ids are 64 bits of a digest only while candidates are gathered; after
that, classes are known by all 128 and every pair is compared in full.

Defined results: a null or wordless text has no shingles, links with nothing
and is its own component; a text of fewer words than a shingle is one shingle
of all its words; texts of a repeated doc_id have rows of their own and are one
vertex; a text of a null doc_id gets the component of its class, if that has a
doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import SPACES, Texts, chunks, mixed, rolling, words
from ._scratch import released, written
from .components import components

SHINGLE = 4
PERCENT = 85
MOST_LIGHT = 16
SKETCH_BITS = 23
SKETCH = 1 << SKETCH_BITS  #: counters of the sketch, whatever the input
SKETCH_BLOCK = 1 << 17
SKETCH_FAN = 64  #: sketches that one task adds up
OCTAVE = 8  #: steps of the counts' logarithm
FEW = 4  #: lists of at most so many sets give all their pairs
HOT = 4096  #: sets of a longer list are dealt to tasks in parts of about so many
STAR = 1024  #: members of a star that meet their pivot in one task, about
SPARE = 5  #: percent of a set's size by which its prefix is longer than need be
BITS = 256  #: bits of a set's parity
DENSE = 4  #: pairs a row at which lists give stars once more


def need(n, m, percent: int):
    """Least intersection of linked sets of n and m elements: 100 i >= p (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def most_apart(n, m, percent: int):
    """Largest symmetric difference of linked sets of n and m elements."""
    return n + m - 2 * need(n, m, percent)


def spare(n):
    """How many listed shingles two linked sets share, if the smaller one has n (a number or a Column)."""
    return 1 + (n * SPARE // 100 if isinstance(n, int) else F.floor(n * SPARE / 100))


def dropped(n: Column, percent: int) -> Column:
    """How many of its listed shingles' stars a set of n may leave: two linked sets share more than both leave."""
    return F.floor((spare(F.floor((percent * n + 99) / 100)) - 1) / 4)


def subset_sizes(n: int, percent: int, most: int) -> list[int]:
    """Overlaps that a light set of n can have to have with another light set."""
    return sorted({need(n, m, percent) for m in range(1, most + 1) if need(n, m, percent) <= min(n, m)})


def sets(part: Texts, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and its distinct shingle hashes, ascending, for every row of the part."""
    w = words(part, SPACES, lower=True)
    run = rolling(w.hash, k)
    for i in range(part.rows.num_rows):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= k:
            yield i, np.unique(run[a : b - k + 1])
        elif b > a:
            yield i, mixed(rolling(w.hash[a:b], b - a) + np.uint64(b - a))
        else:
            yield i, np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _profile(batches: Iterator[pa.RecordBatch], k: int, small: int) -> Iterator[pa.RecordBatch]:
    """A row per document (with its shingles, if at most ``small``), then the task's sketch in blocks."""
    names = ["doc_id", "n", "key1", "key2", "small", "block", "counts"]
    counts, waiting, n_waiting = np.zeros(SKETCH, np.uint32), [], 0

    def count() -> None:
        np.add(counts, np.bincount(np.concatenate(waiting), minlength=SKETCH), out=counts, casting="unsafe")

    for part in chunks(batches):
        size, keys, few = [], [], []
        for _, s in sets(part, k):
            size.append(len(s))
            keys.append(_digest(s))
            few.append(s.view(np.int64).tolist() if 0 < len(s) <= small else None)
            waiting.append(_slot(s))
            n_waiting += len(s)
        if n_waiting > 1 << 21:
            count()
            waiting, n_waiting = [], 0
        n = len(size)
        one, two = ([x[i] for x in keys] for i in range(2))
        cols = [part.rows.column("doc_id"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(few, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=names)
    if n_waiting:
        count()
    for b in range(SKETCH // SKETCH_BLOCK):
        own = counts[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK]
        if own.any():
            none = [pa.nulls(1, pa.int64())] * 4
            cols = [*none, pa.nulls(1, pa.list_(pa.int64())), pa.array([b], pa.int32()), pa.array([np.minimum(own, 255).astype(np.uint8).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, counts: sums of the blocks of equal number and group."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block, group, raw in zip(*[batch.column(c) for c in ("block", "group", "counts")]):
            raw = raw.as_buffer()
            x = np.frombuffer(raw, np.uint8 if len(raw) == SKETCH_BLOCK else np.uint32)
            key = (block.as_py(), group.as_py())
            total[key] = total[key] + x if key in total else x.astype(np.uint32)
    for (block, _), x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "counts"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte for each counter: OCTAVE times its logarithm to base 2."""
    for batch in batches:
        for block, raw in zip(batch.column("block"), batch.column("counts")):
            raw = raw.as_buffer()
            x = np.frombuffer(raw, np.uint8 if len(raw) == SKETCH_BLOCK else np.uint32)
            level = np.minimum(255, np.rint(OCTAVE * np.log2(1.0 + x))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "levels"])


def _frequencies(profile: DataFrame) -> np.ndarray:
    """Levels of the counters, of SKETCH bytes: how common shingles are among all documents."""
    parts = profile.filter("block IS NOT NULL").select("block", "counts")
    n = parts.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    while n > 1:
        n = -(-n // SKETCH_FAN)
        group = F.floor(F.rand(3) * n).cast("int")
        dealt = parts.withColumn("group", group).repartition(n * (SKETCH // SKETCH_BLOCK), "block", "group")
        parts = written(dealt.mapInArrow(_added, "block int, counts binary"), "jaccard-sketch")
        n = parts.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    out = np.zeros(SKETCH, np.uint8)
    for block, levels in parts.mapInArrow(_levels, "block int, levels binary").collect():  # SKETCH bytes
        out[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK] = np.frombuffer(levels, np.uint8)
    return out


def _tokens(batches: Iterator[pa.RecordBatch], k: int, percent: int, boundary: int, frequencies, hot: int) -> Iterator[pa.RecordBatch]:
    """key, c, salt: the subsets or listed shingles of each class; a salt of 1 and up deals long lists."""
    levels = frequencies.value
    parts_of = np.floor((2.0 ** (np.arange(256) / OCTAVE) - 1) / hot).astype(np.int64)
    for part in chunks(batches):
        keys, classes, often = [], [], []
        for _, s in sets(part, k):
            n = len(s)
            if not n:
                continue
            level = levels[_slot(s)]
            mine = []
            if n <= boundary:
                for c in subset_sizes(n, percent, boundary):
                    pick = np.array(list(combinations(range(n), c)))
                    mine.append((mixed(mixed(s[pick] + np.uint64(c)).sum(1, dtype=np.uint64)), level[pick].min(1)))
            if 100 * n >= percent * boundary:
                at = np.argsort(level, kind="stable")[: n + spare(n) - -(-percent * n // 100)]
                mine.append((s[at], level[at]))
            for key, seen in mine:
                keys.append(key)
                often.append(seen)
                classes.append(np.full(len(key), _digest(s)[0]))
        if keys:
            key, c, parts = np.concatenate(keys), np.concatenate(classes), parts_of[np.concatenate(often)]
            salt = np.where(parts > 1, 1 + (mixed(c.view(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c), pa.array(salt.astype(np.int32))], names=["key", "c", "salt"])


def _sets_asked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """v, set of the texts whose sets have the digest asked for."""
    for part in chunks(batches):
        one, two, v = (part.rows.column(c).to_pylist() for c in ("key1", "key2", "v"))
        own = [(v[i], s.tobytes()) for i, s in sets(part, k) if _digest(s) == (one[i], two[i])]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.binary())], names=["v", "set"])


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pivot set, its members' rows, their sets in a run and its offsets; pivots come first in their group."""
    pivot = np.zeros(0, np.uint64)
    for batch in batches:
        col = batch.column("set")
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) // 8
        flat = np.frombuffer(col.buffers()[2], np.uint64, count=int(off[-1])) if len(col) else np.zeros(0, np.uint64)
        at = np.flatnonzero(batch.column("x").is_null().to_numpy(zero_copy_only=False))
        for i, j in zip(np.r_[-1, at], np.r_[at, len(col)]):
            if i >= 0:
                pivot = flat[off[i] : off[i + 1]].copy()
            if j > i + 1:
                yield pivot, batch.slice(i + 1, j - i - 1), flat[off[i + 1] : off[j]], off[i + 1 : j + 1] - off[i + 1]


def _found(pivot: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each element would be in the pivot, and whether it is there."""
    at = np.searchsorted(pivot, flat)
    at[at == len(pivot)] = 0
    return at, pivot[at] == flat


def _compared(batches: Iterator[pa.RecordBatch], percent: int, passed: list[str]) -> Iterator[pa.RecordBatch]:
    """a, x, close and the columns passed: whether member x links with pivot a."""
    for pivot, rows, flat, off in _against(batches):
        _, hit = _found(pivot, flat)
        total = np.r_[0, np.cumsum(hit)]
        both, n, m = total[off[1:]] - total[off[:-1]], len(pivot), np.diff(off)
        close = 100 * both >= percent * (n + m - both)
        yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("a", "x", *passed)], pa.array(close)], names=["a", "x", *passed, "close"])


@lru_cache(1 << 16)
def reach(n_a: int, n: int, e: int, close: bool, percent: int) -> tuple[int, int]:
    """How many first elements of a difference of size e are indexed, and how many are probed.

    The member has n elements and the pivot n_a. A member is far if it doesn't
    link with the pivot; of two that may link one is far. In a far and a close
    one the far one probes, in two far ones that of the larger difference. One
    more than e says that a partner's difference need not overlap.
    """
    m = np.arange(-(-percent * n // 100), 100 * n // percent + 1)
    d = most_apart(n, m, percent)
    least = np.maximum(np.maximum(e - d, np.abs(m - n_a)), 0)
    far = np.maximum(np.maximum(least, most_apart(m, n_a, percent) + 1), 0 if close else e)

    def first(partner: np.ndarray) -> int:
        can = partner <= e + d
        if not can.any():
            return 0
        overlap = int((-(-(e + partner[can] - d[can]) // 2)).min())
        return e + 1 if overlap <= 0 else max(0, e - overlap + 1)

    return first(far), 0 if close else first(least)


def parity(s: np.ndarray) -> np.ndarray:
    """BITS bits as longs, each whether an odd number of the set's elements falls on it."""
    odd = np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _differences(batches: Iterator[pa.RecordBatch], percent: int, frequencies) -> Iterator[pa.RecordBatch]:
    """key, x, n, e, at, label, kind, parity: first elements of the members' differences.

    e is the size of the difference and ``at`` the element's place in it; kind is
    1 for indexed elements of close members, of far ones 2 if probed, 3 if both.
    """
    levels = frequencies.value
    for pivot, rows, flat, off in _against(batches):
        at, hit = _found(pivot, flat)
        a, labels = rows.column("a")[0].as_py(), rows.column("label").to_pylist()
        star = mixed(np.array([a], np.int64).view(np.uint64))[0]
        keys, xs, ns, es, ats, owns, kinds, odds = [], [], [], [], [], [], [], []
        for j, x in enumerate(rows.column("x").to_pylist()):
            i, o = off[j], off[j + 1]
            s, inside = flat[i:o], hit[i:o]
            gone = np.ones(len(pivot), bool)
            gone[at[i:o][inside]] = False
            more, less = s[~inside], pivot[gone]
            e, both = len(more) + len(less), int(inside.sum())
            close = 100 * both >= percent * (len(pivot) + len(s) - both)
            index, probe = reach(len(pivot), len(s), e, close, percent)
            most = max(index, probe)
            if not most:
                continue
            more = more[np.argsort(levels[_slot(more)], kind="stable")]
            key = np.concatenate([more, less])[:most]
            if most > e:
                key = np.append(key, mixed(np.array([star]))[0])
            rank = np.arange(len(key))
            keys.append(key ^ star)
            kinds.append((rank < index).astype(np.int32) + 2 * (rank < probe))
            xs.append(np.full(len(key), x))
            ns.append(np.full(len(key), len(s)))
            es.append(np.full(len(key), e))
            ats.append(rank)
            owns.append(np.full(len(key), labels[j]))
            odds += [parity(s).tolist()] * len(key)
        if keys:
            key, x, own = (np.concatenate(c) for c in (keys, xs, owns))
            n, e, at, kind = (pa.array(np.concatenate(c).astype(np.int32)) for c in (ns, es, ats, kinds))
            yield pa.RecordBatch.from_arrays([pa.array(mixed(key).view(np.int64)), pa.array(x), n, e, at, pa.array(own), kind, pa.array(odds, pa.list_(pa.int64()))], names=["key", "x", "n", "e", "at", "label", "kind", "parity"])


def choose_boundary(mean_list: float, percent: int) -> int:
    """Largest size whose subsets cost no more than scanning its lists."""
    best = 1
    for n in range(1, MOST_LIGHT + 1):
        enumerate_cost = sum(comb(n, c) for c in subset_sizes(n, percent, n))
        scan_cost = (n - ceil(percent * n / 100) + 1) * (1 + mean_list)
        if enumerate_cost > scan_cost:
            break
        best = n
    return best


def _lists(tokens: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """key, c, salt, n: each class once a list, without those that share fewer keys than a link needs.

    ``sizes`` holds c and n of every class.
    """
    together = Window.partitionBy("key", "salt")
    seen = tokens.select("key", "c", "salt", F.lag("c").over(together.orderBy("c")).alias("before"), (F.min("c").over(together) < F.max("c").over(together)).alias("shared"))
    seen = written(seen.filter("(before IS NULL OR before <> c) AND (shared OR salt > 0)").select("key", "c", "salt"), "jaccard-lists")
    least = spare(F.floor((percent * F.col("n") + 99) / 100))
    enough = seen.groupBy("c").count().join(sizes, "c").filter(F.col("count") >= least).select("c", "n")
    return seen.join(enough, "c")


def _candidates(lists: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """a, x, star: pairs of short lists, and stars of the others around their least class."""
    together = Window.partitionBy("key", "salt")
    by_class = together.orderBy("c")
    rows = lists.select("key", "c", "salt", F.col("n").alias("nx"), F.count("*").over(together).alias("held"), F.min("c").over(together).alias("lead"), *[F.lag("c", i).over(by_class).alias(f"c{i}") for i in range(1, FEW)])

    def pair(key: Column | None, a: Column, star: bool) -> Column:
        return F.struct((F.lit(None).cast("long") if key is None else key).alias("key"), a.alias("a"), F.lit(star).alias("star"))

    few = F.array(*[pair(None, F.col(f"c{i}"), False) for i in range(1, FEW)])
    of_hot = F.array(pair(F.col("key"), F.col("lead"), True))
    out = F.when(F.col("salt") > 0, of_hot).when(F.col("held") <= FEW, few).otherwise(F.array(pair(None, F.col("lead"), True)))
    rows = rows.select(F.col("c").alias("x"), "nx", F.explode(out).alias("p")).select("p.*", "x", "nx").filter((F.col("a") != F.col("x")) | F.col("key").isNotNull())
    rows = rows.groupBy("key", "a", "star", "x").agg(F.count("*").alias("keys"), F.first("nx").alias("nx"))
    # a set leaves the stars that it shares fewest shingles with, as many as no link depends on
    own = F.col("star") & F.col("key").isNull()
    upto = F.sum(F.when(own, F.col("keys"))).over(Window.partitionBy("x").orderBy(~own, "keys", "a").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).filter(~own | (F.col("upto") > dropped(F.col("nx"), percent))).drop("nx", "upto")
    rows = written(rows, "jaccard-candidates")
    leads = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("a").alias("lead"))
    hot = rows.filter("key IS NOT NULL").join(leads, "key").filter(F.col("lead") != F.col("x")).select(F.col("lead").alias("a"), "star", "x", "keys")
    pairs = rows.filter("key IS NULL").select("a", "star", "x", "keys").union(hot).groupBy("a", "x").agg(F.max("star").alias("star"), F.sum("keys").alias("keys"))
    pairs = pairs.join(sizes.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("v").alias("va")), "a").join(sizes.select(F.col("c").alias("x"), "n", F.col("v").alias("vx")), "x")
    # two sets that link share the spare keys of the smaller one, but for those that they left; in a long list they are compared anyway
    left = dropped(F.col("n"), percent) + dropped(F.col("n_a"), percent)
    fit = (F.col("keys") >= spare(F.least("n", "n_a")) - left) & (100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a"))
    return pairs.filter(F.col("star") | fit).select(F.col("va").alias("a"), F.col("vx").alias("x"), "star")


def _meeting(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Each pivot a's set (x null) followed by the sets of its members x."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    members = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("x"), "salts").cast("int")).drop("salts")
    members = members.join(full.withColumnRenamed("v", "x"), "x")
    pivots = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(full.withColumnRenamed("v", "a"), "a")
    rows = members.unionByName(pivots, allowMissingColumns=True)
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("x").asc_nulls_first())


def _compare(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    passed = [c for c in pairs.columns if c not in ("a", "x")]
    kinds = "".join(f", {c} {pairs.schema[c].dataType.simpleString()}" for c in passed)
    return written(_meeting(pairs, full).mapInArrow(partial(_compared, percent=percent, passed=passed), f"a long, x long{kinds}, close boolean"), "jaccard-compared")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (v, label) after joining the components that the links (a, b) connect."""
    a, b = labels.select(F.col("v").alias("a"), F.col("label").alias("la")), labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b")
    over = components(between).select(F.col("v").alias("label"), F.col("label").alias("top"))
    ends = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    every = labels.join(ends, "v", "full").select("v", F.coalesce("label", "v").alias("label"))
    return written(every.join(over, "label", "left").select("v", F.coalesce("top", "label").alias("label")), "jaccard-labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("v").alias("x"), "label"), "x", "left").withColumn("label", F.coalesce("label", "x"))


def _uncovered(left: DataFrame) -> DataFrame:
    """left (a, x, label) without the stars whose members are all in a larger one.

    A star is held against one other: the largest that any of its members is in.
    """
    sizes = left.groupBy("a").agg(F.count("*").alias("m"))
    ranked = left.join(sizes, "a").withColumn("own", F.struct("m", (-F.col("a")).alias("minus")))
    largest = ranked.groupBy("x").agg(F.max("own").alias("top"), F.count("*").alias("stars")).filter("stars > 1").select("x", "top")
    other = ranked.join(largest, "x").groupBy("a").agg(F.max("top").alias("top"), F.first("own").alias("own")).filter("top > own").select("a", (-F.col("top.minus")).alias("of"))
    both = left.join(other, "a").join(left.select(F.col("a").alias("of"), "x"), ["of", "x"], "left_semi")
    covered = both.groupBy("a").agg(F.count("*").alias("both")).join(sizes, "a").filter("both = m").select("a")
    return left.join(covered, "a", "left_anti")


def _links(pairs: DataFrame, full: DataFrame, percent: int, frequencies) -> DataFrame:
    """v, label: components of the classes that candidates (a, x, star) lead to."""
    seen = _compare(pairs, full, percent)
    labels = components(seen.filter("close").select("a", F.col("x").alias("b")))
    fewest = None
    while True:
        members = _labelled(seen.filter("star"), labels)
        split = members.groupBy("a").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(~F.col("close")).alias("far")).filter("lo < hi AND far").select("a")
        left = written(members.join(split, "a").select("a", "x", "label"), "jaccard-split")
        if left.isEmpty():
            return labels
        left = written(_uncovered(left), "jaccard-stars")
        rows = _meeting(left, full).mapInArrow(partial(_differences, percent=percent, frequencies=frequencies), "key long, x long, n int, e int, at int, label long, kind int, parity array<long>")
        in_list = Window.partitionBy("key")
        probed = F.max(F.col("kind") > 1).over(in_list)
        split_list = F.min("label").over(in_list) < F.max("label").over(in_list)
        rows = rows.withColumns({"a": F.min("x").over(in_list), "ok": probed & split_list}).filter("ok").drop("ok")
        rows = written(rows, "jaccard-differences")
        sums = rows.groupBy("key").agg(F.count_if(F.col("kind") % 2 == 1).alias("i"), F.count_if(F.col("kind") > 1).alias("p"), F.count("*").alias("n"))
        cost, n = sums.agg(F.sum(F.col("i") * F.col("p")), F.sum("n")).first()
        if not n:
            return labels
        if cost > DENSE * n and (fewest is None or cost < fewest):
            fewest = cost
            again = rows.filter("a <> x").select("a", "x", F.lit(True).alias("star")).distinct()
        else:
            fewest = 0
            i, p = rows.filter("kind % 2 = 1").alias("i"), rows.filter("kind > 1").alias("p")
            near = 100 * F.least("i.n", "p.n") >= percent * F.greatest("i.n", "p.n")
            # the first common element has as many behind it, in both, as the overlap needs
            both = F.col("i.n") + F.col("p.n")
            overlap = F.ceil((F.col("i.e") + F.col("p.e") - both + 2 * F.ceil(percent * both / (100 + percent))) / 2)
            placed = (F.col("i.at") + overlap <= F.col("i.e")) & (F.col("p.at") + overlap <= F.col("p.e"))
            smaller = (F.col("i.kind") == 1) | (F.struct("i.e", "i.x") < F.struct("p.e", "p.x"))
            bits = [F.bit_count(F.col("i.parity")[b].bitwiseXOR(F.col("p.parity")[b])) for b in range(BITS // 64)]
            apart = sum(bits[1:], bits[0]) <= both - 2 * F.ceil(percent * both / (100 + percent))
            again = i.join(p, (F.col("i.key") == F.col("p.key")) & (F.col("i.label") != F.col("p.label")) & near & placed & smaller & apart)
            again = again.select(F.least("i.x", "p.x").alias("a"), F.greatest("i.x", "p.x").alias("x"), F.lit(False).alias("star")).distinct()
        seen = _compare(written(again, "jaccard-again"), full, percent)
        labels = _merged(labels, seen.filter("close").select("a", F.col("x").alias("b")))
        if fewest == 0:
            return labels


def similarity_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    most_small = 100 * MOST_LIGHT // percent
    profile = written(docs.mapInArrow(partial(_profile, k=k, small=most_small), "doc_id long, n long, key1 long, key2 long, small array<long>, block int, counts binary"), "jaccard-profile")
    rows = profile.filter("block IS NULL")
    named = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("small").alias("small"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("key1", "key2"))
    classes = written(classes.withColumn("v", F.when(place == 1, F.col("rep")).otherwise(F.xxhash64("rep", "key1", "key2"))), "jaccard-classes")
    scanned = classes.select(F.explode("small").alias("s")).groupBy("s").count()
    mean_list = scanned.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 1.0
    boundary = choose_boundary(float(mean_list), percent)
    frequencies = docs.sparkSession.sparkContext.broadcast(_frequencies(profile))  # SKETCH bytes

    texts = docs.filter("doc_id IS NOT NULL")
    tokens = texts.mapInArrow(partial(_tokens, k=k, percent=percent, boundary=boundary, frequencies=frequencies, hot=HOT), "key long, c long, salt int")
    sizes = classes.select(F.col("key1").alias("c"), "n", "v")
    pairs = written(_candidates(_lists(tokens, sizes, percent), sizes, percent), "jaccard-pairs")
    asked = pairs.select(F.explode(F.array("a", "x")).alias("v")).distinct().join(classes, "v").select(F.col("rep").alias("doc_id"), "key1", "key2", "v")
    full = texts.join(asked, "doc_id").select("text", "key1", "key2", "v").mapInArrow(partial(_sets_asked, k=k), "v long, set binary")
    full = written(full, "jaccard-sets")
    labels = _links(pairs, full, percent, frequencies)
    released(full, pairs)

    # rows of one doc_id are one vertex
    twice = named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    texts_of = written(named.join(twice, "doc_id").join(classes, ["key1", "key2"]).select("doc_id", "v").distinct(), "jaccard-repeated")
    same = texts_of.join(texts_of.groupBy("doc_id").agg(F.min("v").alias("a")), "doc_id").filter("a <> v").select("a", F.col("v").alias("b"))
    if not same.isEmpty():
        labels = _merged(labels, same)
    of_class = classes.join(labels, "v", "left").select("key1", "key2", "rep", F.coalesce("label", "v").alias("label"))
    least = of_class.groupBy("label").agg(F.min("rep").alias("component"))
    of_class = of_class.join(least, "label").select("key1", "key2", "component")
    out = rows.select("doc_id", "n", "key1", "key2").join(of_class, ["key1", "key2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
