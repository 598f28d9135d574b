"""Benchmark passages in training documents, found with suffix arrays over shards of the documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataguild.llm.common import raw_text, release_memory, words_of

#: Text bytes of one shard and of one block of benchmark items; a longer single text makes a larger one.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
WINDOW = 10


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark as broadcast blocks of ``(item_id, text)``; the driver holds one block at a time.

    Items without id or words are left out.
    """
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), raw_text().alias("body"))
    blocks, block, size = [], [], 0
    for item, body in rows.toLocalIterator():
        block.append((item, bytes(body)))
        size += len(body)
        if size >= block_bytes:
            blocks.append(sc.broadcast(block))
            block, size = [], 0
    if block:
        blocks.append(sc.broadcast(block))
    return blocks


class TestSuffixes:
    """All suffixes of the items of a block, as numbers of the block's own vocabulary (0: any other word)."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        coded = []
        for item, body in items:
            words = words_of(body)
            if words:
                coded.append((item, [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]))
        self.items = [item for item, _ in coded]
        lengths = np.array([len(w) for _, w in coded], np.int64)
        self.ids = np.array([x for _, w in coded for x in [*w, 0]] + [0], np.int64)
        first = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1].astype(np.int64)
        self.item = np.repeat(np.arange(len(coded)), lengths)
        self.offset = np.arange(len(self.item)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.start = first[self.item] + self.offset
        self.length = lengths[self.item] - self.offset
        # Words a window has that starts here; 0 where the item ends too early.
        whole = np.minimum(lengths, window)[self.item]
        self.window = np.where(self.length >= whole, whole, 0)
        self.window[(lengths[self.item] < window) & (self.offset > 0)] = 0


class Shard:
    """Suffix array over the words of some documents.

    Suffixes that start with a word foreign to the items match no item, so they are left out; a foreign word or the
    end of a document ends a suffix.  Sorted by prefix doubling, only groups that are still tied are sorted again.
    """

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = np.concatenate((ids, [0])).astype(np.int64)
        n = len(self.ids)
        at = np.flatnonzero(self.ids)
        stops = np.flatnonzero(self.ids == 0)
        run = np.zeros(n, np.int64)
        run[at] = stops[np.searchsorted(stops, at)] - at
        order = at[np.argsort(self.ids[at], kind="stable")]
        rank = np.zeros(n, np.int64)
        slots, keys, k = np.arange(len(order)), self.ids[order], 1
        while len(slots):
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(keys)))
            rank[order[slots]] = np.repeat(slots[heads] + 1, sizes)
            open_ = (sizes > 1) & (np.maximum.reduceat(run[order[slots]], heads) > k)
            slots = slots[np.repeat(open_, sizes)]
            if not len(slots):
                break
            p = order[slots]
            second = np.where(run[p] > k, rank[np.minimum(p + k, n - 1)], 0)
            keys = rank[p] * (n + 1) + second
            sort = np.argsort(keys, kind="stable")
            order[slots], keys = p[sort], keys[sort]
            k *= 2
        self.order = order

    def common(self, at: np.ndarray, test: TestSuffixes, which: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that the suffixes ``at`` and the test suffixes ``which`` have in common, up to ``most``."""
        same = np.zeros(len(at), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            a = self.ids[np.minimum(at[live] + same[live], len(self.ids) - 1)]
            b = test.ids[test.start[which[live]] + same[live]]
            live = live[(a == b) & (a > 0)]
            same[live] += 1
            live = live[same[live] < most[live]]
        return same

    def bound(self, test: TestSuffixes, which: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
        """First place in the array whose suffix, cut to ``most`` words, is not below (``after``: is above) the test suffix."""
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.order), np.int64)
        while len(go := np.flatnonzero(low < high)):
            mid = (low[go] + high[go]) // 2
            at, q, m = self.order[mid], which[go], most[go]
            same = self.common(at, test, q, m)
            done = same >= m
            a = self.ids[np.minimum(at + same, len(self.ids) - 1)]
            b = test.ids[test.start[q] + np.minimum(same, m - 1)]
            below = np.where(done, after, a < b)
            low[go[below]] = mid[below] + 1
            high[go[~below]] = mid[~below]
        return low

    def longest(self, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """Length and place of the longest match of every test suffix."""
        which = np.arange(len(test.start))
        if not len(self.order):
            return np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        put = self.bound(test, which, test.length, False)
        best, place = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        for near in (put, put - 1):
            at = self.order[np.clip(near, 0, len(self.order) - 1)]
            same = self.common(at, test, which, test.length)
            better = same > best
            best[better], place[better] = same[better], at[better]
        return best, place


def _numbers(bodies: list[bytes], test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of documents, each followed by a 0, and the documents' word counts."""
    find, parts, counts = test.numbers.get, [], []
    for body in bodies:
        words = words_of(body)
        counts.append(len(words))
        parts.append(np.fromiter(map(find, words, repeat(0)), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(counts, np.int64)


def _tests(blocks: list, window: int, kept: list) -> Iterator[TestSuffixes]:
    """The blocks one after the other; a single one is kept in ``kept`` for the rest of the task."""
    if len(blocks) == 1:
        if not kept:
            kept.append(TestSuffixes(blocks[0].value, window))
        yield kept[0]
        return
    for block in blocks:
        yield TestSuffixes(block.value, window)


def judge(bodies: list[bytes], tests: Iterator[TestSuffixes]) -> list[dict]:
    """What the windows of all items hit in each of some documents."""
    hit, items, counts = None, [set() for _ in bodies], None
    for test in tests:
        ids, counts = _numbers(bodies, test)
        ends = np.cumsum(counts + 1)
        marks = np.zeros(len(ids) + 1, np.int32)
        shard = Shard(ids)
        best, _ = shard.longest(test)
        which = np.flatnonzero((test.window > 0) & (best >= test.window))
        if len(which):
            most = test.window[which]
            low, high = shard.bound(test, which, most, False), shard.bound(test, which, most, True)
            found = high - low
            at = shard.order[np.repeat(low - np.cumsum(found) + found, found) + np.arange(found.sum())]
            np.add.at(marks, at, 1)
            np.add.at(marks, at + np.repeat(most, found), -1)
            doc = np.searchsorted(ends, at, side="right")
            pairs = np.unique(doc * len(test.items) + np.repeat(test.item[which], found))
            for pair in pairs.tolist():
                items[pair // len(test.items)].add(test.items[pair % len(test.items)])
        covered = np.cumsum(marks[:-1]) > 0
        hit = covered if hit is None else hit | covered
    if counts is None:
        counts = np.array([len(words_of(b)) for b in bodies])
    out, start = [], 0
    for i, n in enumerate(counts.tolist()):
        own = hit[start : start + n] if hit is not None else np.zeros(n, bool)
        start += n + 1
        at = np.flatnonzero(own)
        runs = np.diff(np.concatenate(([-1], np.flatnonzero(~own), [n]))) - 1
        out.append(
            {
                "n_words": n,
                "n_hit": len(at),
                "n_items": len(items[i]),
                "items": sorted(items[i]),
                "first_hit": int(at[0]) if len(at) else None,
                "longest_run": int(runs.max()),
            }
        )
    return out


def _shards(batches: Iterator[pa.RecordBatch], body: str, shard_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in slices of bounded text size, with their texts."""
    for batch in batches:
        bodies = batch.column(batch.schema.get_field_index(body)).to_pylist()
        start, size = 0, 0
        for i, b in enumerate(bodies):
            if i > start and size + len(b) > shard_bytes:
                yield batch.slice(start, i - start), bodies[start:i]
                start, size = i, 0
            size += len(b)
        if bodies:
            yield batch.slice(start), bodies[start:]
        del batch, bodies
        release_memory()


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Which documents hold windows of benchmark items, and how many of their words.

    A window is ``window`` consecutive words of an item; a shorter item with any word is one window.  Returns per row
    ``doc_id, n_words, n_hit, n_items, items, first_hit, longest_run``: words inside occurrences, distinct items with
    one, the sorted item ids, the first such word (from 0, null if none) and the longest run of such words.

    Every shard of documents gets a suffix array, and every test suffix is searched in each by bisection.  Documents
    are read once and not shuffled.  The benchmark is taken in blocks, one in memory at a time.  Null and empty texts
    have no words; items with a null id or no words are left out, and items with one id count once; repeated rows are
    judged one by one; an empty benchmark hits nothing; other columns are ignored.
    """
    blocks = item_blocks(benchmark, block_bytes)
    rows = docs.select(F.col("doc_id"), raw_text().alias("body"))
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items": pa.list_(pa.string())}
    kinds |= {"first_hit": pa.int64(), "longest_run": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for rows, bodies in _shards(batches, "body", shard_bytes):
            found = judge(bodies, _tests(blocks, window, kept))
            arrays = [rows.column(0)] + [pa.array([x[k] for x in found], t) for k, t in kinds.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *kinds])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, first_hit long, longest_run long",
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The longest verbatim match of every item suffix anywhere in the documents, of ``least`` words or more.

    Returns ``item_id, item_word, n_words, doc_id, doc_word`` (places count words from 0); of matches of equal length
    the one with the smallest doc_id and place is given.  Edge cases as in ``contamination``.
    """
    blocks = item_blocks(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for rows, bodies in _shards(batches, "body", shard_bytes):
            for test in _tests(blocks, least, kept):
                ids, counts = _numbers(bodies, test)
                ends = np.cumsum(counts + 1)
                best, place = Shard(ids).longest(test)
                q = np.flatnonzero(best >= least)
                doc = np.searchsorted(ends, place[q], side="right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([test.items[i] for i in test.item[q]], pa.string()),
                        pa.array(test.offset[q], pa.int64()),
                        pa.array(best[q], pa.int64()),
                        rows.column(0).take(pa.array(doc, pa.int64())),
                        pa.array(place[q] - (ends - counts - 1)[doc], pa.int64()),
                    ],
                    names=["item_id", "item_word", "n_words", "doc_id", "doc_word"],
                )

    found = rows.mapInArrow(run, "item_id string, item_word long, n_words long, doc_id long, doc_word long")
    best = F.max_by(F.struct("n_words", "doc_id", "doc_word"), F.struct("n_words", -F.col("doc_id"), -F.col("doc_word")))
    return found.groupBy("item_id", "item_word").agg(best.alias("m")).select("item_id", "item_word", "m.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item; all columns as they are, no shuffle."""
    blocks, columns = item_blocks(benchmark), docs.columns
    body = "body"
    while body in columns:
        body += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for rows, bodies in _shards(batches, body, shard_bytes):
            clean = pa.array([not x["n_hit"] for x in judge(bodies, _tests(blocks, window, kept))], pa.bool_())
            yield rows.select(columns).filter(clean)

    return docs.select("*", raw_text().alias(body)).mapInArrow(run, docs.schema)


def items_digest(items: str = "items") -> F.Column:
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """The same by definition, for tests: doc_id to (n_words, n_hit, n_items, digest)."""
    wins = set()
    for item, text in items:
        w = words_of((text or "").encode())
        if item is not None and w:
            k = min(window, len(w))
            wins |= {(item, tuple(w[i : i + k])) for i in range(len(w) - k + 1)}
    out = {}
    for doc, text in docs:
        w = words_of((text or "").encode())
        hit, found = set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out
