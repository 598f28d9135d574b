"""Repeated substrings: text that an earlier document already has, found by distributed suffix sorting.

A text's windows (all its substrings of ``LENGTH`` bytes) are too many to shuffle, so they travel in runs.  The key of
a window is the smallest hash of its ``GRAM``-byte grams; equal windows have equal keys, and neighbouring windows
mostly share one, so a run of windows with one key is sent as one short string to the key's bucket.

1. ``chunk``: documents are dealt out in chunks of bounded size; chunks send the keys of their runs, each once.
2. ``bucket``: keys that occur in one document only are settled; the others are reported back to their chunks.
3. ``chunk``: runs with reported keys are sent as strings, each once a chunk, with the smallest doc_id that has it.
4. ``bucket``: the windows of different strings with one key are suffix-sorted by deep-shallow sorting; equal windows
   get the smallest doc_id of all, and what a chunk could not know is reported back.
5. ``chunk``: windows whose smallest doc_id is below their document's are removed, byte by byte.

A chunk or bucket is the unit of memory.  What many documents share is sent once a chunk, and a key with very many
different strings is split further, window by window, so no passage, however common, gathers in one place.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataguild.llm.common import raw_text

LENGTH = 50
GRAM = 24
#: Text bytes of a chunk, and different strings of a key beyond which its windows are dealt out one by one.
CHUNK_BYTES = 12 << 20
SPLIT = 50_000
#: Windows that a bucket sorts at a time; the windows of one key stay together.
SORTED = 400_000
#: Bytes that multikey quicksort compares before blind tries take over.
SHALLOW = 24
_U = np.uint64
_SLICE = 1 << 17
_NONE = np.iinfo(np.int64).max


def _powers() -> dict[int, np.uint64]:
    base = 0x9E3779B97F4A7C15 | 1
    return {k: _U(pow(base, k, 1 << 64)) for k in (1, 2, 4, 8, 16)}


_POW = _powers()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM``-byte grams of some bytes."""
    h1 = (data.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93)
    h2 = h1[:-1] * _POW[1] + h1[1:]
    h4 = h2[:-2] * _POW[2] + h2[2:]
    h8 = h4[:-4] * _POW[4] + h4[4:]
    h16 = h8[:-8] * _POW[8] + h8[8:]
    h = h16[:-8] * _POW[8] + h8[16:]
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def window_keys(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Key of every window: the smallest gram hash in it."""
    h = gram_hashes(data)
    width, size = length - GRAM + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


class Chunk:
    """Documents of one chunk in a fixed order, and the runs of their windows."""

    def __init__(self, table: pa.Table, length: int) -> None:
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("body", "ascending")]))
        bodies = table.column("body").cast(pa.large_binary()).combine_chunks()
        if isinstance(bodies, pa.ChunkedArray):
            bodies = bodies.chunk(0)
        offsets = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
        data = bodies.buffers()[2]
        self.data = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        self.ends = offsets[1:] - offsets[0]
        self.starts = offsets[:-1] - offsets[0]
        self.table, self.length = table, length
        ids = table.column("doc_id").combine_chunks()
        self.null = np.asarray(pc.is_null(ids))
        self.ids = np.asarray(pc.fill_null(ids, 0)).astype(np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, first window, number of windows and key of every run; documents without id have none."""
        starts, counts, keys = [], [], []
        data, length = self.data, self.length
        # Windows that begin in the last bytes of a document would cross its end.
        crossing = self.ends - (length - 1)
        for at in range(0, max(0, len(data) - length + 1), _SLICE):
            to = min(at + _SLICE, len(data) - length + 1)
            key = window_keys(data[at : to + length - 1], length)
            cut = np.concatenate(([True], key[1:] != key[:-1]))
            near = slice(np.searchsorted(self.ends, at, side="right"), np.searchsorted(self.starts, to))
            for edge in (self.starts[near], crossing[near]):
                cut[edge[(edge >= at) & (edge < to)] - at] = True
            first = np.flatnonzero(cut)
            starts.append(first + at)
            counts.append(np.diff(np.append(first, to - at)))
            keys.append(key[first])
        if not starts:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
        start, count, key = np.concatenate(starts), np.concatenate(counts), np.concatenate(keys)
        doc = np.searchsorted(self.ends, start, side="right")
        good = (start + length <= self.ends[doc]) & ~self.null[doc]
        return doc[good], start[good], count[good], key[good]

    def entries(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[bytes, int], list[int]]:
        """Runs with shared keys: document, first window, and number of a string; the strings, and each one's bucket hash.

        Windows of hot keys are runs of their own.
        """
        doc, start, count, key = self.runs()
        keep = np.isin(key, shared)
        doc, start, count, key = doc[keep], start[keep], count[keep], key[keep]
        wide = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
        if wide.any():
            each = np.where(wide, count, 1)
            step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            doc, key, start = np.repeat(doc, each), np.repeat(key, each), np.repeat(start, each) + step
            count, wide = np.where(np.repeat(wide, each), 1, np.repeat(count, each)), np.repeat(wide, each)
        whole = self.data.tobytes()
        numbers: dict[bytes, int] = {}
        which = np.empty(len(doc), np.int64)
        deal: list[int] = []
        for i, (s, e, k, w) in enumerate(zip(start.tolist(), (start + count + self.length - 1).tolist(), key.tolist(), wide.tolist(), strict=True)):
            string = whole[s:e]
            n = numbers.get(string)
            if n is None:
                n = numbers[string] = len(numbers)
                deal.append(xxhash.xxh64_intdigest(string) if w else k)
            which[i] = n
        return doc, start, which, numbers, deal


def _batch(columns: dict, kinds: dict) -> pa.Table:
    return pa.table([pa.array(columns[k], t) for k, t in kinds.items()], names=list(kinds))


KEYS = {"bucket": pa.int32(), "chunk": pa.int32(), "once": pa.binary(), "more": pa.binary()}
REPLY = {"chunk": pa.int32(), "bucket": pa.int32(), "shared": pa.binary(), "detail": pa.binary()}
STRINGS = {"bucket": pa.int32(), "chunk": pa.int32(), "sizes": pa.binary(), "least": pa.binary(), "strings": pa.binary()}


def _lean(step):
    """Give memory of earlier groups back before the next one."""

    @functools.wraps(step)
    def run(*args):
        pa.default_memory_pool().release_unused()
        return step(*args)

    return run


def _chunk_of(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


@_lean
def send_keys(table: pa.Table, buckets: int, length: int) -> pa.Table:
    """Step 1.  ``once``: keys with one string in one document here; ``more``: others, with the count of strings."""
    chunk = Chunk(table, length)
    doc, start, count, key = chunk.runs()
    # A sign of the string is enough for counting: its ends, length and key.
    first = _U(0) + chunk.data[start].astype(_U)
    for j in (1, 2, 3, 5, 8, 13):
        first = first * _U(257) + chunk.data[start + j]
        first = first * _U(257) + chunk.data[start + count + length - 2 - j]
    sign = (first * _U(0x9E3779B97F4A7C15)) ^ (count.astype(_U) << _U(40))
    order = np.lexsort((sign, key))
    key, sign, doc = key[order], sign[order], doc[order]
    out: dict[str, list] = {k: [] for k in KEYS}
    if len(key):
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (sign[1:] != sign[:-1])))
        kinds = np.add.reduceat(new.astype(np.int64), head)
        several = np.maximum.reduceat(doc, head) > np.minimum.reduceat(doc, head)
        key = key[head]
        bucket = (key % _U(buckets)).astype(np.int64)
        lone = (kinds == 1) & ~several
        detail = np.stack((key, (kinds.astype(_U) << _U(1)) | several.astype(_U)), axis=1)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
        for part in np.split(order, cuts[1:]):
            one = part[lone[part]]
            out["bucket"].append(int(bucket[part[0]]))
            out["chunk"].append(_chunk_of(table))
            out["once"].append(key[one].tobytes())
            out["more"].append(detail[part[~lone[part]]].tobytes())
    return _batch(out, KEYS)


@_lean
def settle_keys(table: pa.Table, split: int) -> pa.Table:
    """Step 2.  For every chunk the keys here that more than one document has, and (``detail``) the hot ones of them."""
    keys, kinds, several, chunks = [], [], [], []
    names = table.column("chunk").to_pylist()
    for i, (once, more) in enumerate(zip(table.column("once").to_pylist(), table.column("more").to_pylist(), strict=True)):
        a, b = np.frombuffer(once, _U), np.frombuffer(more, _U).reshape(-1, 2)
        keys += [a, b[:, 0]]
        kinds += [np.ones(len(a), np.int64), (b[:, 1] >> _U(1)).astype(np.int64)]
        several += [np.zeros(len(a), bool), (b[:, 1] & _U(1)).astype(bool)]
        chunks.append(np.full(len(a) + len(b), i))
    key, kinds, several, chunk = (np.concatenate(x) for x in (keys, kinds, several, chunks))
    order = np.argsort(key, kind="stable")
    key, chunk = key[order], chunk[order]
    out: dict[str, list] = {k: [] for k in REPLY}
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(head, len(key)))
    shared = np.repeat((size > 1) | np.logical_or.reduceat(several[order], head), size)
    hot = np.repeat(np.add.reduceat(kinds[order], head) > split, size)
    key, chunk, hot = key[shared], chunk[shared], hot[shared]
    order = np.argsort(chunk, kind="stable")
    cuts = np.flatnonzero(np.diff(chunk[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        out["chunk"].append(names[chunk[part[0]]])
        out["bucket"].append(-1)
        out["shared"].append(key[part].tobytes())
        out["detail"].append(key[part[hot[part]]].tobytes())
    return _batch(out, REPLY)


def _shared(reply: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = reply.filter(pc.less(reply.column("bucket"), 0))
    return tuple(np.frombuffer(b"".join(rows.column(c).to_pylist()), _U) for c in ("shared", "detail"))


@_lean
def send_strings(table: pa.Table, reply: pa.Table, buckets: int, length: int) -> pa.Table:
    """Step 3.  The strings of shared runs, each once, with the smallest doc_id here that has it."""
    out: dict[str, list] = {k: [] for k in STRINGS}
    if len(table) and len(reply):
        chunk = Chunk(table, length)
        doc, _, which, numbers, deal = chunk.entries(*_shared(reply))
        least = np.full(len(numbers), _NONE)
        np.minimum.at(least, which, chunk.ids[doc])
        strings = list(numbers)
        bucket = (np.array(deal, _U) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            own = [strings[i] for i in part.tolist()]
            out["bucket"].append(int(bucket[part[0]]))
            out["chunk"].append(_chunk_of(table))
            out["sizes"].append(np.fromiter(map(len, own), np.uint32, len(own)).tobytes())
            out["least"].append(least[part].tobytes())
            out["strings"].append(zstandard.compress(b"".join(own), 1))
    return _batch(out, STRINGS)


def shallow_sort(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of suffixes within groups, eight bytes a character, to ``depth`` bytes.

    All parts are split in step: each takes the character of its middle suffix as pivot and falls into smaller, equal
    and larger suffixes; the equal part goes on with the next character.  Returns the order of the suffixes and
    numbers that are equal for suffixes not told apart.
    """
    place = np.argsort(group, kind="stable")
    part = np.cumsum(np.concatenate(([0], np.diff(group[place]) != 0))) if len(place) else place
    deep = np.zeros(len(place), np.int64)
    names = part.astype(np.int64)
    live = np.arange(len(place))
    while len(live):
        head = np.flatnonzero(np.concatenate(([True], names[live][1:] != names[live][:-1])))
        size = np.diff(np.append(head, len(live)))
        open_ = np.repeat((size > 1) & (deep[live[head]] < depth), size)
        live = live[open_]
        if not len(live):
            break
        head = np.flatnonzero(np.concatenate(([True], names[live][1:] != names[live][:-1])))
        size = np.diff(np.append(head, len(live)))
        suffix = place[live]
        char = np.zeros(len(live), _U)
        where = at[suffix] + deep[live]
        for j in range(8):
            char = (char << _U(8)) | data[where + j]
        pivot = np.repeat(char[head + size // 2], size)
        side = (char > pivot) * 2 + (char == pivot)
        tag = np.repeat(np.arange(len(head)), size) * 3 + side
        order = np.argsort(tag, kind="stable")
        place[live] = suffix[order]
        deep[live] = deep[live][order] + 8 * (side[order] == 1)
        tag = tag[order]
        fresh = np.flatnonzero(np.concatenate(([True], tag[1:] != tag[:-1])))
        # A part keeps the place of its first suffix as its name; places grow, so names stay in order and apart.
        names[live] = len(place) + np.repeat(live[fresh], np.diff(np.append(fresh, len(live))))
    return place, names


class BlindTrie:
    """Patricia trie over equally long strings, as numbers: inner nodes hold only the bit that tells their sides apart.

    A string is first led down by these bits alone, compared once with the leaf it meets, and then put where the
    first differing bit belongs.
    """

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int, member: int) -> None:
        node = self.root
        if node is None:
            self.root = [-1, value, [member]]
            return
        while node[0] >= 0:
            node = node[2] if value >> node[0] & 1 else node[1]
        differ = value ^ node[1]
        if not differ:
            node[2].append(member)
            return
        bit = differ.bit_length() - 1
        up, side, node = None, 0, self.root
        while node[0] > bit:
            up, side = node, 2 if value >> node[0] & 1 else 1
            node = node[side]
        leaf = [-1, value, [member]]
        new = [bit, node, leaf] if value >> bit & 1 else [bit, leaf, node]
        if up is None:
            self.root = new
        else:
            up[side] = new

    def leaves(self) -> list[list[int]]:
        """Members of equal strings, in the order of the strings."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node is not None and node[0] < 0:
                out.append(node[2])
            elif node is not None:
                stack += [node[2], node[1]]
        return out


def equal_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> list[list[int]]:
    """Deep-shallow sorting of the windows at ``at`` within their groups: lists of equal ones, two or more, in order.

    ``data`` is at least 64 bytes longer than its windows need.
    """
    place, names = shallow_sort(data, at, group)
    head = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(place) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(place)))
    whole, out = memoryview(data), []
    for h, n in zip(head[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        trie = BlindTrie()
        for i in place[h : h + n].tolist():
            s = int(at[i])
            trie.add(int.from_bytes(whole[s + SHALLOW : s + length], "big"), i)
        out += [m for m in trie.leaves() if len(m) > 1]
    return out


@_lean
def settle_strings(table: pa.Table, length: int) -> pa.Table:
    """Step 4.  For every chunk and string whose windows another document has: the windows' smallest doc_ids.

    A report has the string's number and a doc_id if it holds for all windows, else the doc_ids of all windows.
    """
    numbers: dict[bytes, int] = {}
    least: list[int] = []
    sent: list[tuple[int, list[int], list[int]]] = []
    for chunk, sizes, mins, strings in zip(*(table.column(c).to_pylist() for c in ("chunk", "sizes", "least", "strings")), strict=True):
        own, own_least, at, strings = [], np.frombuffer(mins, np.int64).tolist(), 0, zstandard.decompress(strings)
        for size, low in zip(np.frombuffer(sizes, np.uint32).tolist(), own_least, strict=True):
            string = strings[at : at + size]
            at += size
            n = numbers.setdefault(string, len(numbers))
            if n == len(least):
                least.append(low)
            elif low < least[n]:
                least[n] = low
            own.append(n)
        sent.append((chunk, own, own_least))
    strings = list(numbers)
    data = np.frombuffer(b"".join([*strings, bytes(64)]), np.uint8)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    start = np.cumsum(size) - size
    key = window_keys(data, length)[start]
    _, group, times = np.unique(key, return_inverse=True, return_counts=True)
    many = np.flatnonzero(times[group] > 1)
    many = many[np.argsort(group[many], kind="stable")]
    low = np.array(least, np.int64)
    windows = size[many] - length + 1
    changed: dict[int, np.ndarray] = {}
    # Slices of whole keys: a cut is where the windows so far pass a multiple and the key changes.
    turn = np.flatnonzero(np.diff(group[many])) + 1
    slices = np.searchsorted(np.cumsum(windows), np.arange(SORTED, windows.sum() + SORTED, SORTED))
    cuts = np.unique(turn[np.minimum(np.searchsorted(turn, slices), len(turn) - 1)]) if len(turn) else []
    for part in np.split(many, cuts):
        count = size[part] - length + 1
        first = np.cumsum(count) - count
        of = np.repeat(np.arange(len(part)), count)
        step = np.arange(count.sum()) - first[of]
        window_low = low[part[of]]
        for members in equal_windows(data, start[part[of]] + step, group[part[of]], length):
            value = min(window_low[members].tolist())
            for i in members:
                if window_low[i] > value:
                    n, f = int(part[of[i]]), first[of[i]]
                    if n not in changed:
                        changed[n] = window_low[f : f + count[of[i]]].copy()
                    changed[n][step[i]] = value
    out: dict[str, list] = {k: [] for k in REPLY}
    for chunk, own, own_least in sent:
        even, even_low, odd = [], [], []
        for i, (n, was) in enumerate(zip(own, own_least, strict=True)):
            if n in changed:
                now = changed[n]
                odd += [np.array([i, len(now)], np.int64), now]
            elif least[n] < was:
                even.append(i)
                even_low.append(least[n])
        if even or odd:
            out["chunk"].append(chunk)
            out["bucket"].append(table.column("bucket")[0].as_py())
            out["shared"].append(np.array([even, even_low], np.int64).tobytes())
            out["detail"].append(np.concatenate(odd).tobytes() if odd else b"")
    return _batch(out, REPLY)


@_lean
def remove(table: pa.Table, reply: pa.Table, buckets: int, length: int, texts: bool) -> pa.Table:
    """Step 5.  The removed spans of every document, and what is left of it (or its digest)."""
    if not len(table):
        return _batch({k: [] for k in _kinds(texts)}, _kinds(texts))
    chunk = Chunk(table, length)
    marks = np.zeros(len(chunk.data) + 1, np.int32)
    if len(reply):
        doc, start, which, numbers, deal = chunk.entries(*_shared(reply))
        size = np.fromiter(map(len, numbers), np.int64, len(numbers))
        least = np.full(len(numbers), _NONE)
        np.minimum.at(least, which, chunk.ids[doc])
        bucket = (np.array(deal, _U) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = {int(b): int(i) for b, i in zip(*np.unique(bucket[order], return_index=True), strict=True)}
        odd: dict[int, np.ndarray] = {}
        rows = reply.filter(pc.greater_equal(reply.column("bucket"), 0))
        for b, even, detail in zip(*(rows.column(c).to_pylist() for c in ("bucket", "shared", "detail")), strict=True):
            at, low = np.frombuffer(even, np.int64).reshape(2, -1)
            least[order[first[b] + at]] = low
            values, i = np.frombuffer(detail, np.int64), 0
            while i < len(values):
                n = int(values[i + 1])
                odd[int(order[first[b] + values[i]])] = values[i + 2 : i + 2 + n]
                i += 2 + n
        strange = np.zeros(len(numbers), bool)
        strange[list(odd)] = True
        plain = ~strange[which] & (least[which] < chunk.ids[doc])
        np.add.at(marks, start[plain], 1)
        np.add.at(marks, start[plain] + size[which[plain]], -1)
        for i in np.flatnonzero(strange[which]).tolist():
            at = start[i] + np.flatnonzero(odd[int(which[i])] < chunk.ids[doc[i]])
            np.add.at(marks, at, 1)
            np.add.at(marks, at + length, -1)
    gone = np.cumsum(marks[:-1]) > 0
    out: dict[str, list] = {k: [] for k in _kinds(texts)}
    out["doc_id"] = chunk.table.column("doc_id").to_pylist()
    for s, e in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
        own = gone[s:e]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
        left = chunk.data[s:e][~own].tobytes()
        out["n_bytes"].append(e - s)
        out["starts"].append(edge[::2])
        out["ends"].append(edge[1::2])
        out["kept"].append(left if texts else hashlib.sha256(left).hexdigest())
    return _batch(out, _kinds(texts))


def _kinds(texts: bool) -> dict:
    spans = {"starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}
    return {"doc_id": pa.int64(), "n_bytes": pa.int64(), **spans, "kept": pa.binary() if texts else pa.string()}


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, texts: bool = True, chunk_bytes: int = CHUNK_BYTES, split: int = SPLIT
) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a document with a smaller doc_id.

    Returns ``doc_id, n_bytes, starts, ends, kept``: the removed spans as byte offsets, and the bytes that remain (or,
    without ``texts``, their SHA-256 as lowercase hex).  Matches never cross documents and are judged on the input.
    Null and empty texts have no bytes; rows of one doc_id remove nothing from each other and get the same spans
    where they are equal; rows without doc_id lose nothing and count for no other.  Other columns are ignored.
    """
    if length < GRAM + 1 or length < SHALLOW:
        raise ValueError(f"length must be more than {GRAM}")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("body"))
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // chunk_bytes))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "body"), F.lit(parts)).cast("int")).select("chunk", "doc_id", "body")
    reply = "chunk int, bucket int, shared binary, detail binary"

    keys = dealt.groupBy("chunk").applyInArrow(lambda t: send_keys(t, parts, length), "bucket int, chunk int, once binary, more binary")
    known = keys.groupBy("bucket").applyInArrow(lambda t: settle_keys(t, split), reply)
    strings = (
        dealt.groupBy("chunk")
        .cogroup(known.groupBy("chunk"))
        .applyInArrow(lambda t, r: send_strings(t, r, parts, length), "bucket int, chunk int, sizes binary, least binary, strings binary")
    )
    found = strings.groupBy("bucket").applyInArrow(lambda t: settle_strings(t, length), reply)
    kind = "binary" if texts else "string"
    return (
        dealt.groupBy("chunk")
        .cogroup(known.unionByName(found).groupBy("chunk"))
        .applyInArrow(
            lambda t, r: remove(t, r, parts, length, texts), f"doc_id long, n_bytes long, starts array<long>, ends array<long>, kept {kind}"
        )
    )


def brute_force(docs: list[tuple[int, bytes]], length: int = LENGTH) -> list[tuple]:
    """The same by definition, for tests: (doc_id, n_bytes, n_removed, n_spans, sha256) in the order given."""
    first: dict[bytes, int] = {}
    for doc, body in docs:
        for i in range(len(body) - length + 1):
            w = body[i : i + length]
            first[w] = min(doc, first.get(w, doc))
    out = []
    for doc, body in docs:
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - length + 1):
            if first[body[i : i + length]] < doc:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        left = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out.append((doc, len(body), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out
