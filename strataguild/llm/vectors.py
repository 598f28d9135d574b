"""Vector code compression: codebooks per part, fitted with norm-of-sum bounds."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataguild.llm.common import checkpoint_folder, drop_folder, settle
from strataguild.operators.joins import same_keys
from strataguild.session import measured

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Entries whose lower bounds are kept as one.
GROUP = 4
#: Vectors of a block: a row of the tables between rounds.
BLOCK = 4096
#: Rounding of square roots and differences stays far below this share.
SLACK = 1e-9
BLOCKS = (
    "vec_ids array<bigint>, labels array<string>, wide int, data binary, codes binary, bounds binary, stamps binary, "
    "sums array<bigint>, scanned bigint"
)


@dataclass
class Codebooks:
    """Entries of all parts as they were in every round so far: ``history[round][part, entry, place]``."""

    history: list[np.ndarray] = field(default_factory=list)

    @property
    def now(self) -> np.ndarray:
        return self.history[-1]

    def moved(self) -> np.ndarray:
        """``[round, part, group]``: how far an entry of the group now lies from where it was in a round, at most.

        This is the norm of the sum of an entry's steps, never more than the sum of their norms.
        """
        steps = np.stack([np.sqrt(((self.now - old).astype(float) ** 2).sum(axis=2)) for old in self.history])
        ends = range(0, steps.shape[2], GROUP)
        return np.stack([steps[:, :, i : i + GROUP].max(axis=2) for i in ends], axis=2) * (1 + SLACK)

    def digest(self) -> str:
        """sha256 of all components in order of part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.now.ravel().tolist())).encode()).hexdigest()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries.

    Products are summed as floats where whole numbers stay exact in them, else as 64-bit integers.
    """
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return ((x[:, None, :].astype(np.int64) - entries) ** 2).sum(axis=2)


@dataclass
class State:
    """What is known of a block's vectors, part by part.

    ``codes[row, part]`` is the nearest entry so far; ``bounds[row, part, group]`` a distance that no other entry of the
    group fell below in round ``stamps[row, part, group]``.
    """

    codes: np.ndarray
    bounds: np.ndarray
    stamps: np.ndarray

    @classmethod
    def fresh(cls, n: int, parts: int, entries: int) -> State:
        groups = -(-entries // GROUP)
        return cls(np.zeros((n, parts), np.uint8), np.full((n, parts, groups), -1.0, np.float32), np.zeros((n, parts, groups), np.uint8))


def assign(x: np.ndarray, books: Codebooks, state: State) -> tuple[np.ndarray, int]:
    """Bring ``state`` to the present codebooks; exact squared distances to the nearest entries, and entries compared.

    ``x[row, part, place]`` are the parts.  A group is left alone if its bound, less the way its entries went since the
    bound's round, still exceeds the distance to the vector's own entry; every other group is compared exactly.
    """
    n, parts, _ = x.shape
    round_ = len(books.history) - 1
    moved = books.moved()
    nearest = np.zeros((n, parts), np.int64)
    scanned = 0
    for part in range(parts):
        entries, piece = books.now[part], x[:, part]
        own = state.codes[:, part].astype(np.int64)
        best = ((piece.astype(np.int64) - entries[own]) ** 2).sum(axis=1)
        start, before = best.copy(), own.copy()
        root = np.sqrt(best.astype(float)) * (1 + SLACK)
        groups = state.bounds.shape[2]
        valid = np.empty((n, groups))
        found = np.zeros((n, groups), bool)
        seen: list[tuple[int, np.ndarray, np.ndarray]] = []
        for g in range(groups):
            valid[:, g] = state.bounds[:, part, g] - moved[state.stamps[:, part, g], part, g]
            rows = np.flatnonzero(valid[:, g] <= root)
            if not len(rows):
                continue
            found[rows, g] = True
            first = g * GROUP
            far = distances(piece[rows], entries[first : first + GROUP])
            scanned += far.size
            seen.append((g, rows, far))
            at = np.argmin(far, axis=1)
            low = far[np.arange(len(rows)), at]
            nearer = (low < best[rows]) | ((low == best[rows]) & (first + at < own[rows]))
            best[rows[nearer]] = low[nearer]
            own[rows[nearer]] = first + at[nearer]
        # Bounds of compared groups: their nearest entry other than the vector's own.
        for g, rows, far in seen:
            others = far.astype(float)
            inside = own[rows] // GROUP == g
            others[np.flatnonzero(inside), own[rows][inside] - g * GROUP] = np.inf
            state.bounds[rows, part, g] = np.nextafter(np.sqrt(others.min(axis=1)).astype(np.float32), np.float32(0))
            state.stamps[rows, part, g] = round_
        # An entry that was given up without a comparison of its group is one of the others now.
        left = np.flatnonzero((own != before) & ~found[np.arange(n), before // GROUP])
        if len(left):
            g = before[left] // GROUP
            bound = np.minimum(valid[left, g], np.sqrt(start[left].astype(float)))
            state.bounds[left, part, g] = np.nextafter((bound * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))
            state.stamps[left, part, g] = round_
        state.codes[:, part] = own
        nearest[:, part] = best
    return nearest, scanned


def part_sums(x: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """``[part, entry, place]`` sums of the parts by entry, with their number at the last place."""
    n, parts, width = x.shape
    out = np.zeros((parts, entries, width + 1), np.int64)
    for part in range(parts):
        order = np.argsort(codes[:, part], kind="stable")
        sorted_codes = codes[order, part]
        first = np.flatnonzero(np.r_[True, np.diff(sorted_codes) != 0])
        out[part, sorted_codes[first], :width] = np.add.reduceat(x[order, part].astype(np.int64), first, axis=0)
        out[part, :, width] = np.bincount(codes[:, part], minlength=entries)
    return out


def whole_parts(vector: str = "embedding", scale: int = SCALE):
    """Components as whole numbers: the floor of ``scale`` times each."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def usable(vector: str = "embedding"):
    """No null vector, no null, infinite or undefined component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(vector, fine)


def _matrix(row: dict, parts: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[row["wide"]]
    return np.frombuffer(row["data"], kind).reshape(len(row["vec_ids"]), parts, -1)


def _state(row: dict, parts: int) -> State:
    n = len(row["vec_ids"])
    return State(
        np.frombuffer(row["codes"], np.uint8).reshape(n, parts).copy(),
        np.frombuffer(row["bounds"], np.float32).reshape(n, parts, -1).copy(),
        np.frombuffer(row["stamps"], np.uint8).reshape(n, parts, -1).copy(),
    )


def _block(ids: list, labels: list, x: np.ndarray, state: State, books: Codebooks) -> dict:
    """Assign a block and lay it out as a row."""
    _, scanned = assign(x, books, state)
    return {
        "vec_ids": ids,
        "labels": labels,
        "wide": x.dtype.itemsize,
        "data": x.tobytes(),
        "codes": state.codes.tobytes(),
        "bounds": state.bounds.tobytes(),
        "stamps": state.stamps.tobytes(),
        "sums": part_sums(x, state.codes, books.now.shape[1]).ravel().tolist(),
        "scanned": scanned,
    }


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _first_blocks(rows: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    schema = _arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                n = some.num_rows
                values = some.column(2).flatten().to_numpy(zero_copy_only=False)
                top = int(np.abs(values).max(initial=0))
                width = len(values) // n
                if 4 * top * top * width >= 1 << 63:
                    raise ValueError(f"components up to {top} are too large for whole-number distances")
                kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
                x = values.astype(kind).reshape(n, parts, width // parts)
                state = State.fresh(n, parts, books.now.shape[1])
                row = _block(some.column(0).to_pylist(), some.column(1).to_pylist(), x, state, books)
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return rows.mapInArrow(run, BLOCKS)


def _next_blocks(blocks: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    schema = _arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                row = _block(row["vec_ids"], row["labels"], _matrix(row, parts), _state(row, parts), books)
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return blocks.drop("sums", "scanned").mapInArrow(run, BLOCKS)


def _codes(blocks: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """``vec_id, label, code, error`` by the last codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                state = _state(row, parts)
                nearest, _ = assign(_matrix(row, parts), books, state)
                names = state.codes.tobytes().hex()
                arrays = [
                    pa.array(row["vec_ids"], pa.int64()),
                    pa.array(row["labels"], pa.string()),
                    pa.array([names[j : j + 2 * parts] for j in range(0, len(names), 2 * parts)], pa.string()),
                    pa.array(nearest.sum(axis=1), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "code", "error"])

    return blocks.drop("sums", "scanned").mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(
    vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors, ``vec_id, label, code, error`` (settled), and the codebooks with their history.

    Components become whole numbers (floor of ``scale`` times each), vectors ``parts`` equal parts.  Each part's codebook
    starts as the parts of the ``entries`` vectors of smallest vec_id (null ids last, equal ids by their components).
    In every round all parts go to their nearest entry (ties: the lower one) and entries become the floored means of
    their parts; unused entries stay.  A last assignment follows.  Results are exact: bounds only save comparisons.

    Vectors that are null or hold null or non-finite components are left out, and so are vectors of another length
    than the first kept one, which no entry can be compared with; a first length that ``parts`` does not divide, or
    components too large for 64-bit distances, are errors.  Fewer vectors than ``entries`` give as many entries.
    Repeated rows each get their row; null labels are kept; other columns are ignored; an empty table gives no rows.

    Blocks of vectors with their codes, bounds and stamps are written to the shared checkpoint folder in every round
    and read in the next, so a lost executor costs a round's lost tasks; a round's folder is removed after the next.
    Per round the driver gets one sum an entry and place.
    """
    spark = vectors.sparkSession
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.where(usable(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole_parts(vector, scale).alias("x"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(1).select(F.size("x")).collect()
    none = spark.createDataFrame([], "vec_id long, label string, code string, error long")
    if not first:
        return none, Codebooks()
    width = first[0][0]
    if width % parts or not width:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("x") == width)
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    start = np.array([r[0] for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    books = Codebooks([start])

    folder = f"{checkpoint_folder(spark)}/vector-codes-{uuid.uuid4().hex}"
    blocks = _first_blocks(rows, books, parts)
    for n in range(rounds):
        blocks.write.parquet(f"{folder}/{n}")
        blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/{n}")
        if n:
            drop_folder(spark, f"{folder}/{n - 1}")
        books.history.append(updated(blocks, books.now))
        blocks = _next_blocks(blocks, books, parts) if n < rounds - 1 else blocks
    codes = settle(_codes(blocks, books, parts))
    drop_folder(spark, folder)
    return codes, books


def updated(blocks: DataFrame, now: np.ndarray) -> np.ndarray:
    """The next entries: floored means of the blocks' sums, and the present ones where nothing was assigned."""
    parts, entries, width = now.shape
    sums = blocks.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for r in sums.collect():  # one row an entry and place
        total[r["at"]] = r["v"]
    total = total.reshape(parts, entries, width + 1)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), now)


def code_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; errors are summed over equal labels, nulls together."""
    codes, books = compress(vectors)
    # Few labels are sent to the tasks; many are joined by shuffling.
    by_label = measured(codes.groupBy("label").agg(F.sum("error").alias("label_error")))
    digest = books.digest() if books.history else None
    return same_keys(codes, by_label, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
