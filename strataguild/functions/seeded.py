"""Reproducible pseudo-random integers as expressions of keys.

A draw depends only on its key columns, never on how rows are partitioned or on
which attempt of a task produced it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
# Numbers that are mixed at once, so that they stay near the processor.
NEAR = 1 << 14


def _fold(state: Column, key: Column) -> Column:
    state = (state * 48271 + key.cast("bigint") % PRIME + 11) % PRIME
    state = (state * state) % PRIME
    return (state * 69621 + 7919) % PRIME


def _finish(state: Column) -> Column:
    return ((state * state) % PRIME * 16807 + 5) % PRIME


def mix_state(cols: Sequence[Column], seed: int) -> Column:
    """Fold whole-number columns into a state below 2^31 - 1."""
    return reduce(_fold, cols, F.lit(seed % PRIME).cast("bigint"))


def mix31(cols: Sequence[Column], seed: int = 0) -> Column:
    """Fold whole-number columns into [0, 2^31 - 1) with modular arithmetic.

    Only products below 2^62 appear, so any engine with 64-bit integers gives
    the same value.
    """
    return _finish(mix_state(cols, seed))


def key_number(cols: Sequence[Column]) -> Column:
    """Whole number below 2^52 for keys of any type: the first 13 digits of the md5 of their texts."""
    text = F.concat_ws("\x01", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def key_state(cols: Sequence[Column], seed: int, rng: str) -> Column:
    """State of a work item's keys.

    ``rng="mix"`` wants whole-number keys; ``rng="hash"`` turns keys of any type into one
    number first.  Either can be repeated by other SQL engines.
    """
    if rng == "hash":
        return mix_state([key_number(cols)], seed)
    if rng == "mix":
        return mix_state(cols, seed)
    raise ValueError(f"unknown rng {rng!r}")


def draw_states(keys: Sequence[Column], seed: int, rng: str) -> dict[str, Column]:
    """Part of a draw that its work item shares, computed once per item."""
    return {"_s0": key_state(keys, seed, rng), "_s1": key_state(keys, seed + 1, rng)}


def draw_rank(draw: Column, n: Column) -> Column:
    """Whole number in 1..n for a numbered draw of an item with its states."""
    high, low = _finish(_fold(F.col("_s0"), draw)), _finish(_fold(F.col("_s1"), draw))
    return (high * PRIME + low) % n + 1


def fold_in(state, key):
    """``_fold`` for whole numbers or integer arrays."""
    state = (state * 48271 + key % PRIME + 11) % PRIME
    return ((state * state) % PRIME * 69621 + 7919) % PRIME


def finished(state):
    """``_finish`` for whole numbers or integer arrays."""
    return ((state * state) % PRIME * 16807 + 5) % PRIME


def _lowered(x: np.ndarray, spare: np.ndarray) -> None:
    """Numbers replaced by smaller ones that leave the same remainder: 2^31 leaves one."""
    np.right_shift(x, 31, out=spare)
    x &= PRIME
    x += spare


def opened(state):
    """What a key is added to when it is folded into a state."""
    return (state * 48271 + 11) % PRIME


def finish_sums(sums: np.ndarray) -> None:
    """``finished(fold_in(state, key))`` in place of ``opened(state) + key``, for unsigned numbers below 2^32."""
    spares = np.empty(min(len(sums), NEAR), np.uint64)
    for first in range(0, len(sums), NEAR):
        x = sums[first : first + NEAR]
        spare = spares[: len(x)]
        x *= x
        _lowered(x, spare)
        x *= 69621
        x += 7919
        _lowered(x, spare)
        x *= x
        _lowered(x, spare)
        x *= 16807
        x += 5
        _lowered(x, spare)
        # Below two times the prime by now; what is below it wraps around and stays.
        np.subtract(x, PRIME, out=spare)
        np.minimum(x, spare, out=x)
