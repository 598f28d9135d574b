"""Periodic runs of words: rare words split a text again and again, lags are scanned in what survives."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataguild.llm.common import raw_text

#: A run is at least this many words long and holds at least this many periods.
SHORTEST = 24
POWERS = 3
#: Longest gram (words) by which lags are looked up.
WIDEST = 64
#: Bytes of text that a task takes up at once; a longer text is taken alone.
SLICE = 4 << 20

Run = tuple[int, int, int]
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def surviving(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int = SHORTEST, powers: int = POWERS) -> list[tuple[int, int]]:
    """Stretches of ``shortest`` words or more in which every word occurs ``powers`` times or more.

    A run holds each of its words at least ``powers`` times, so a word that is rarer in its segment lies in no run
    of it and splits it.  Segments that were split are counted again until none changes.
    """
    settled: list[tuple[int, int]] = []
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    while len(starts):
        sizes = ends - starts
        seg = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)
        codes, _ = pd.factorize(seg * (int(ids.max()) + 1) + ids[at])
        rare = np.bincount(codes)[codes] < powers
        split = np.zeros(len(starts), bool)
        split[seg[rare]] = True
        settled += zip(starts[~split].tolist(), ends[~split].tolist(), strict=True)
        kept = np.flatnonzero(~rare & split[seg])
        if not len(kept):
            break
        pos, own = at[kept], seg[kept]
        first = np.flatnonzero(np.r_[True, (np.diff(pos) != 1) | (np.diff(own) != 0)])
        starts, ends = pos[first], pos[np.r_[first[1:] - 1, len(pos) - 1]] + 1
        long = ends - starts >= shortest
        starts, ends = starts[long], ends[long]
    return settled


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Equal leading entries."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(n, at + step)
        differ = a[at:end] != b[at:end]
        if differ.any():
            return at + int(np.argmax(differ))
        at, step = end, 2 * step
    return n


def _bands(last: int, shortest: int, powers: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of lags (low, high exclusive) up to ``last``, and the words that a run of such a lag repeats at least."""
    low = 1
    while low <= last:
        even = max(1, -(-shortest // powers))
        high = low + 1 if low < even else min(2 * low, last + 1)
        yield low, high, max(shortest - low, (powers - 1) * low) if low < even else (powers - 1) * low
        low = high


def lag_scan(words: np.ndarray, shortest: int = SHORTEST, powers: int = POWERS) -> list[Run]:
    """All runs (start, length, period) of a segment of word ids.

    Words that lie one period apart agree along a run, over ``powers - 1`` periods at least.  So one of a few places
    set that far apart has a gram inside that stretch which returns one lag later: lags are looked up among the places
    of equal grams, and the stretch is followed both ways.  A stretch inside a known run whose period divides the lag
    is that run again.
    """
    m = len(words)
    last = m // powers
    ranks: dict[int, np.ndarray] = {1: words.astype(np.int64)}
    places: dict[int, np.ndarray] = {}

    def rank(width: int) -> np.ndarray:
        if width not in ranks:
            half = rank(width // 2)
            pairs = half[: -(width // 2)] * (int(half.max()) + 1) + half[width // 2 :]
            ranks[width] = pd.factorize(pairs)[0].astype(np.int64)
        return ranks[width]

    found: dict[tuple[int, int], int] = {}
    by_length: list[tuple[int, int, int, int]] = []
    for low, high, agree in _bands(last, shortest, powers):
        width = 1
        while 4 * width <= agree and width < WIDEST:
            width *= 2
        if width + low > m:
            continue
        own = rank(width)
        if width not in places:
            places[width] = np.sort(own * m + np.arange(len(own)))
        spots = np.arange(0, len(own) - low, agree - width + 1)
        base = own[spots] * m
        begin = np.searchsorted(places[width], base + spots + low)
        end = np.searchsorted(places[width], base + np.minimum(spots + high, m))
        n = end - begin
        if not n.sum():
            continue
        here = np.repeat(spots, n)
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)
        lags = places[width][which] % m - here
        order = np.lexsort((here, lags))
        lags, here = lags[order], here[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(lags) != 0]).tolist() + [len(lags)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            lag, spots_of = int(lags[i]), here[i:j].tolist()
            k = 0
            while k < len(spots_of):
                p = spots_of[k]
                known = 0
                for size, start, period, stop in by_length:
                    if -size < lag:
                        break
                    if start <= p and p + lag <= stop and lag % period == 0:
                        known = stop
                        break
                if known:
                    k = max(k + 1, bisect_left(spots_of, known - lag + 1))
                    continue
                to = p + _alike(words[p + lag :], words[p:])
                since = p - _alike(words[p + lag - 1 :: -1] if p + lag else words[:0], words[p - 1 :: -1] if p else words[:0])
                length = to - since + lag
                if length >= max(shortest, powers * lag) and (since, to + lag) not in found:
                    found[since, to + lag] = lag
                    insort(by_length, (-length, since, lag, to + lag))
                k = max(k + 1, bisect_left(spots_of, to))
    return [(start, stop - start, period) for (start, stop), period in found.items()]


def find_in(bodies: list[list[bytes]], orders: list[np.ndarray | None], shortest: int, powers: int) -> Iterator[tuple[list[bytes], list[Run]]]:
    """Words (put in order, where an order is given) and runs of every text."""
    words = [w if o is None else [w[i] for i in o.tolist()] for w, o in zip(bodies, orders, strict=True)]
    flat = np.empty(sum(map(len, words)), object)
    at = 0
    for w in words:
        flat[at : at + len(w)] = w
        at += len(w)
    ids, _ = pd.factorize(flat)
    ends = np.cumsum([len(w) for w in words])
    starts = np.r_[0, ends[:-1]]
    runs: list[list[Run]] = [[] for _ in words]
    for a, b in surviving(ids, starts, ends, shortest, powers):
        doc = int(np.searchsorted(ends, a, "right"))
        runs[doc] += [(a - int(starts[doc]) + s, n, q) for s, n, q in lag_scan(ids[a:b], shortest, powers)]
    for w, r in zip(words, runs, strict=True):
        yield w, sorted(r, key=lambda x: (x[0], x[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(
    docs: DataFrame,
    keys: list[str],
    order: Callable[[object, int], np.ndarray | None] | None = None,
    shortest: int = SHORTEST,
    powers: int = POWERS,
    texts: bool = True,
) -> DataFrame:
    """``keys``, ``n_words``, ``runs`` (start, length, period; by start, then period), the ``best`` run (greatest length
    by period; ties by start, then period), ``runs_sha256`` and ``collapsed_sha256``, and with ``texts`` the
    ``collapsed`` text itself, for every row.

    Words are parted by ASCII white space.  A run is a stretch of at least ``shortest`` words and ``powers`` of its
    smallest period that no neighbouring word extends.  ``order`` may give, from the first key and the number of words,
    the places of the words to look at.  A text that is null, empty or has too few words has no runs; its collapsed text
    are its words.  Repeated rows are answered one by one; other columns are ignored, an empty table gives no rows.
    Texts are taken whole, however long, a slice of ``SLICE`` bytes at a time.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = batch.column(n)
            sizes = np.cumsum(np.diff(np.frombuffer(texts_.buffers()[1], np.int32, len(texts_) + 1, 4 * texts_.offset))) if len(texts_) else []
            at = 0
            while at < len(texts_):
                done = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
                part = batch.slice(at, to - at)
                bodies = [b.split() for b in part.column(n).to_pylist()]
                orders = [order(k, len(b)) if order else None for k, b in zip(part.column(0).to_pylist(), bodies, strict=True)]
                rows: dict[str, list] = {"n_words": [], "runs": [], "runs_sha256": [], "collapsed_sha256": [], "collapsed": []}
                for words, runs in find_in(bodies, orders, shortest, powers):
                    left = collapsed(words, runs)
                    rows["n_words"].append(len(words))
                    rows["runs"].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    rows["runs_sha256"].append(hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest())
                    rows["collapsed_sha256"].append(hashlib.sha256(left).hexdigest())
                    if texts:
                        rows["collapsed"].append(left.decode())
                best = [max(r, key=lambda x: (Fraction(x["length"], x["period"]), -x["start"], -x["period"])) if r else None for r in rows["runs"]]
                rows["best"] = best
                arrays = [part.column(i) for i in range(n)] + [pa.array(rows[f.name], f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays(arrays, names=keys + [f.name for f in kinds])
                at = to

    one = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    kinds = [pa.field("n_words", pa.int64()), pa.field("runs", pa.list_(one)), pa.field("best", one)]
    kinds += [pa.field("runs_sha256", pa.string()), pa.field("collapsed_sha256", pa.string())]
    names = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{names}, n_words long, runs {RUNS}, best {RUNS[6:-1]}, runs_sha256 string, collapsed_sha256 string"
    if texts:
        kinds.append(pa.field("collapsed", pa.string()))
        schema += ", collapsed string"
    return docs.select(*keys, raw_text().alias("body_")).mapInArrow(run, schema)


def sown_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words to look at, so that about one document in ten ends in a run; a null id has none.

    Fixed values: the checksum of the id as text decides which documents, where the run begins and how long it is.
    """
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % p
    return order


def run_rows(docs: DataFrame) -> DataFrame:
    """Runs and digests of every document, with the runs that ``sown_order`` puts in."""
    found = find_runs(docs, ["doc_id"], sown_order, texts=False)
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
        "n_words",
    )
