"""A context-mixing range coder for token ids below 65,536, many blocks in step.

Blocks of ``BLOCK`` ids are coded side by side in groups of up to ``LANES``.  For every id the model mixes

* order 2 and order 1: the id that followed the last two ids, and the last one, before in this block.  Both know whether
  they are empty, new, or held the last time; the chances that either holds are learned for all pairs of these states,
  and for agreeing guesses;
* order 0: adaptive frequencies of the id's high byte; its low byte is taken as even.

Guesses are a block's own and learned with every id; chances and frequencies are a group's, which starts afresh, and
learned at the steps in ``REFRESH``.  All are whole numbers, so that any machine decodes what another has coded.  Arrays
hold one entry a block ("lane"), and the lanes of a group take a step at once.  Coded bytes of a block: header (magic,
which tells a group's first block from the others, ids, bytes, crc32 of the ids as little-endian unsigned 32-bit
numbers), then the range coder's 32-bit words, little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

BLOCK = 2048
FIRST, NEXT = b"RC14", b"rc14"
HEAD = struct.Struct("<4sIII")
#: Blocks of a group: few enough that their tables stay near the processor.
LANES = 2048
W1, W2 = 256, 512
#: Steps before which chances and order-0 frequencies are taken anew from the counts.
REFRESH = (0, 32, 128, 512)
#: Rows of ids that are prepared at once; they end where ``REFRESH`` has a step.
ROWS = 32
_I, _J = np.int64, np.int32
K1, K2 = _I(2654435761), _I(2246822519)
SHIFT1, SHIFT2, MASK1, MASK2 = _I(24), _I(23), _I(W1 - 1), _I(W2 - 1)
#: Bits of a whole: 8 for the choice of the order, 12 for the high byte, 8 for the low byte.
WHOLE = _I(28)
#: An interval is a part of 62 bits; below this width it sends its first 32 bits.
NARROW, REST, WORD = _I(1 << 30), _I(30), _I(32)
LOW32, LOW30, SHARE, FREQ = _I((1 << 32) - 1), _I((1 << 30) - 1), _I(511), _I(8191)
#: What guesses of order 2 and 1 are worth before any count, of 256, by their states (empty, new, -, held).
FIRST2, FIRST1 = (2, 70, 70, 150), (2, 30, 30, 60)
#: Whole numbers above 2**40 / f and 2**32 / f: products with them, shifted, are exact quotients here.
BY40 = np.array([0] + [-(-(1 << 40) // f) for f in range(1, 257)], _I)
BY32 = np.array([0] + [-(-(1 << 32) // f) for f in range(1, 4097)], _I)


class _Model:
    """What the lanes of a group have learned.

    Table entries are an id times 16 and the guess's state: 1 new or 3 held, in the two lowest bits for order 1 and the
    next two for order 2.  A case is a number below 128: both states, 16 unless both guess the same, 32 unless order 2
    held and 64 unless order 1 held.
    """

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes, dtype=_I)
        self.of1, self.of2 = lane * W1, lane * W2
        self.t1, self.t2 = np.zeros(lanes * W1, _J), np.zeros(lanes * W2, _J)
        self.counts = np.zeros(128, _I)
        self.high = 2000 // (np.arange(256) + 4) + 1
        #: Cases of the steps since the last refresh.
        self.cases: list[np.ndarray] = []

    def refresh(self, rows: np.ndarray) -> None:
        """Chances and frequencies from the counts and the ids (a row a step) since the last refresh."""
        if len(rows):
            self.high += np.bincount((rows >> 8).ravel(), minlength=256) * 32
            self.counts += np.bincount(np.concatenate(self.cases), minlength=128)
            self.cases = []
        # Order 0: shares of 4,096; what rounding leaves goes to the last byte.
        share = self.high * (4096 - 256) // self.high.sum() + 1
        start = np.cumsum(share) - share
        share[255] = 4096 - start[255]
        # A byte's start, times 256, and its width in one number.
        self.freq = (start << 40) + share
        self.slots = np.repeat(np.arange(256), share)
        # Orders 2 and 1: shares of 256 by both states and agreement, order 0 has the rest.
        seen = self.counts.reshape(2, 2, 32)
        total = 16 * seen.sum(axis=(0, 1)) + 64
        state = np.arange(32)
        first2, first1 = np.array(FIRST2)[state >> 2 & 3], np.array(FIRST1)[state & 3]
        q2 = 1 + (16 * seen[:, 0].sum(axis=0) + first2 * 64 // 256) * 250 // total
        q1 = 1 + (16 * seen[0, 1] + first1 * 64 // 256) * 250 // total
        both = q2 + q1
        f = 256 - both
        # The interval of a case, start and width in one number; order 0 has its share of 256 in place of a width.
        cases = np.empty((2, 2, 32), _I)
        cases[:, 0] = q2 << 20
        cases[0, 1] = (q2 << 52) + (q1 << 20)
        cases[1, 1] = (both << 52) + f
        self.interval = cases.ravel()
        self.share = (q2 << 52) + (both << 20) + f


_1, _2, _3, _4, _12, _15, _16 = map(_J, (1, 2, 3, 4, 12, 15, 16))


def _agree(e1: np.ndarray, e2: np.ndarray) -> np.ndarray:
    both = e1 ^ e2
    return (both & _15) + (np.minimum(both, _16) & _16)


def _miss(e: np.ndarray, x16: np.ndarray) -> np.ndarray:
    """16 where a guess fails, else 0."""
    return np.minimum(e ^ x16, _16) & _16


def _encode_lanes(ids: np.ndarray) -> list[bytes]:
    total = len(ids)
    lanes = -(-total // BLOCK)
    steps = min(total, BLOCK)
    # A shorter last lane goes on with zeros, which the reader leaves out; two rows of zeros come before the first.
    grid = np.zeros((steps + 2, lanes), np.uint16)
    full = total // steps
    grid[2:, :full] = ids[: full * steps].reshape(full, steps).T
    if full < lanes:
        grid[2 : 2 + total - full * steps, full] = ids[full * steps :]
    model = _Model(lanes)
    low, span = np.zeros(lanes, _I), np.full(lanes, (1 << 62) - 1, _I)
    words, froms = [], []
    last = 0
    for step in range(steps):
        if step in REFRESH:
            model.refresh(grid[2 + last : 2 + step])
            last, interval, freq, count = step, model.interval, model.freq, step < REFRESH[-1]
            sizes = freq & FREQ
        r = step % ROWS
        if not r:
            own = grid[step : step + ROWS + 2].astype(_I)
            now, mixed = own[2:], own[1:-1] * K1
            at1s = (mixed >> SHIFT1 & MASK1) + model.of1
            at2s = ((own[:-2] * K2 ^ mixed) >> SHIFT2 & MASK2) + model.of2
            x16s, high = (now << 4).astype(_J), now >> 8
            order0 = sizes.take(high) * ((now & 255) << WORD) + freq.take(high) - 1
        at1, at2, x16 = at1s[r], at2s[r], x16s[r]
        e1, e2 = model.t1.take(at1), model.t2.take(at2)
        miss1, miss2 = _miss(e1, x16), _miss(e2, x16)
        case = _agree(e1, e2) + (miss2 << _1) + (miss1 << _2)
        if count:
            model.cases.append(case)
        part = interval.take(case)
        wide = (part & SHARE) * order0[r] + part
        model.t1[at1] = x16 + (_3 - (miss1 >> _3))
        model.t2[at2] = x16 + (_12 - (miss2 >> _1))
        span >>= WHOLE
        low += span * (wide >> WORD)
        span *= wide & LOW32
        go = np.flatnonzero(span < NARROW)
        sent = low[go]
        words.append(sent >> REST)
        froms.append(go.astype(np.uint16))
        low[go] = (sent & LOW30) << WORD
        span[go] <<= WORD
    # A value of the last interval with few bits; words that are missing in the end count as zero.
    words.append(low + LOW30 >> REST)
    froms.append(np.arange(lanes, dtype=np.uint16))
    lane = np.concatenate(froms)
    words = np.concatenate(words)[np.argsort(lane, kind="stable")]
    over = np.flatnonzero(words >> WORD)
    words = words.astype(np.uint32)
    # The first word of a lane never runs over, as the value stays below one.
    _carry(words, over - 1)
    stops = np.cumsum(np.bincount(lane, minlength=lanes)).tolist()
    words, parts = words.astype("<u4"), []
    for i, (start, stop) in enumerate(zip([0, *stops], stops, strict=False)):
        own = ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4")
        body = words[start:stop].tobytes().rstrip(b"\0")
        parts += [HEAD.pack(NEXT if i else FIRST, len(own), len(body), zlib.crc32(own.tobytes())), body]
    return parts


def _carry(words: np.ndarray, at: np.ndarray) -> None:
    """Add one to the words at these places and to the one before where a word runs over."""
    while len(at):
        words[at] += np.uint32(1)
        at = at[words[at] == 0] - 1


def encode(ids: np.ndarray) -> bytes:
    """The coded blocks of a run of ids, one after the other."""
    some = BLOCK * LANES
    return b"".join(part for i in range(0, len(ids), some) for part in _encode_lanes(ids[i : i + some]))


def decode(coded: bytes) -> np.ndarray:
    """The ids of ``encode``'s bytes; raises ``ValueError`` where a block's header or checksum is wrong."""
    at, groups = 0, []
    while at < len(coded):
        if at + HEAD.size > len(coded):
            raise ValueError("cut-off block header")
        magic, n, size, crc = HEAD.unpack_from(coded, at)
        at += HEAD.size
        if magic not in (FIRST, NEXT) or n > BLOCK or at + size > len(coded) or (magic == NEXT and not groups):
            raise ValueError("damaged block header")
        if magic == FIRST:
            groups.append(([], []))
        groups[-1][0].append((n, crc))
        groups[-1][1].append(coded[at : at + size])
        at += size
    parts = [_decode_lanes(heads, bodies) for heads, bodies in groups]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _decode_lanes(heads: Sequence[tuple[int, int]], bodies: Sequence[bytes]) -> np.ndarray:
    lanes, steps = len(heads), max(n for n, _ in heads)
    width = max(map(len, bodies)) // 4 + 4
    words = np.frombuffer(b"".join(b.ljust(4 * width, b"\0") for b in bodies), "<u4").astype(np.uint32)
    places = np.arange(lanes, dtype=_I) * width
    # What the coded value lies above the interval's start: 62 bits; 32 bits are added at a time.
    above = (words[places].astype(_I) << REST) + (words[places + 1] >> 2)
    words[:-1] = ((words[:-1] & np.uint32(3)) << np.uint32(30)) + (words[1:] >> np.uint32(2))
    places += 1
    model = _Model(lanes)
    span = np.full(lanes, (1 << 62) - 1, _I)
    grid = np.zeros((steps, lanes), np.uint16)
    of1, of2, t1, t2 = model.of1, model.of2, model.t1, model.t2
    x = mixed = older = np.zeros(lanes, _I)
    most, shares, zero, four, eight, forty = _I((1 << 28) - 1), _I(0xFFF00000), _I(0), _I(4), _I(8), _I(40)
    last = 0
    for step in range(steps):
        if step in REFRESH:
            model.refresh(grid[last:step])
            last, freq, share, slots, count = step, model.freq, model.share, model.slots, step < REFRESH[-1]
        at1 = (mixed >> SHIFT1 & MASK1) + of1
        at2 = ((older ^ mixed) >> SHIFT2 & MASK2) + of2
        e1, e2 = t1.take(at1), t2.take(at2)
        state = _agree(e1, e2)
        part = share.take(state)
        q2, both, f = part >> WORD, part & shares, part & SHARE
        span >>= WHOLE
        # Only damaged blocks come near the end of the interval.
        value = np.minimum((above.view(np.uint64) // span.view(np.uint64)).view(_I), most)
        is2, deep = value < q2, value >= both
        inner = np.maximum(value - both, zero) * BY40.take(f) >> forty
        high = slots.take(inner >> eight)
        pair = freq.take(high)
        start, fh = pair >> WORD, pair & FREQ
        small = (inner - start) * BY32.take(fh) >> WORD
        older, x = x * K2, np.where(deep, (high << eight) + small, np.where(is2, e2, e1) >> _4)
        mixed = x * K1
        above -= span * np.where(deep, both + f * (start + fh * small), np.where(is2, zero, q2))
        span *= np.where(deep, f * fh, np.where(is2, q2, both - q2))
        grid[step] = x
        x16 = (x << four).astype(_J)
        miss1, miss2 = _miss(e1, x16), _miss(e2, x16)
        if count:
            model.cases.append(state + (miss2 << _1) + (miss1 << _2))
        t1[at1] = x16 + (_3 - (miss1 >> _3))
        t2[at2] = x16 + (_12 - (miss2 >> _1))
        go = np.flatnonzero(span < NARROW)
        at = places[go]
        above[go] = (above[go] << WORD) + words.take(at, mode="clip")
        span[go] <<= WORD
        places[go] = at + 1
    plain, parts = np.ascontiguousarray(grid.T), []
    for i, (n, crc) in enumerate(heads):
        own = plain[i, :n]
        if zlib.crc32(own.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} of a group: checksum differs")
        parts.append(own)
    return np.concatenate(parts)
