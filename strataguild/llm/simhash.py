"""Near copies by SimHash with covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataguild.llm.common import map_batches, raw_text, settle

BITS = 64
RADIUS = 2


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Bit masks such that any two values within ``radius`` bits agree on some mask.

    Bit ``i`` gets a non-zero vector ``m(i)`` of ``radius + 1`` bits; for every non-zero ``v`` one mask keeps the
    bits with an odd product of ``v`` and ``m(i)``.  ``radius`` vectors never span all ``radius + 1`` dimensions, so
    some ``v`` is orthogonal to the vectors of all differing bits, and its mask keeps none of these bits.
    """
    vectors = 2 ** (radius + 1) - 1
    return [
        sum(1 << i for i in range(bits) if bin((i % vectors + 1) & v).count("1") % 2) for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit number; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-width])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[s:e], 42) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)),
            np.uint64,
            len(words) - width + 1,
        )
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row; repeated rows stay repeated."""

    def step(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": [fingerprint(t, width) for t in batch.column(1).to_pylist()]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("body"))
    return map_batches(rows, step, "doc_id long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """Links ``a > b`` between distinct fingerprints (``fp``, ``id``) at no more than two differing bits.

    Every covering mask makes one table of buckets.  Inside a bucket only the masked-out bits differ, so a member is
    listed under itself and under each single flip of those bits.  Members that meet under a value are within two
    bits of each other, and all pairs within two bits meet; a value has few possible members whatever the size of
    the bucket, and no pairs of a bucket are ever formed.
    """
    masks = covering_masks()
    flips = [[0] + [_signed(1 << i) for i in range(BITS) if not mask >> i & 1] for mask in masks]
    tables = F.array(*[F.lit(_signed(m)) for m in masks])
    dealt = prints.select("id", "fp", F.posexplode(tables).alias("t", "mask")).select(
        "id", "fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("kept")
    )
    shared = dealt.groupBy("t", "kept").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "kept")
    near = F.element_at(F.array(*[F.array(*[F.lit(x) for x in row]) for row in flips]), F.col("t") + 1)
    met = (
        dealt.join(shared, ["t", "kept"], "left_semi")
        .select("id", "t", "fp", F.explode(near).alias("flip"))
        .select("id", "t", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
        .groupBy("t", "value")
        .agg(F.collect_list("id").alias("ids"))  # at most one member per flip
        .where(F.size("ids") > 1)
    )
    return (
        met.select(F.array_min("ids").alias("b"), F.explode("ids").alias("a")).where("a > b").select("a", "b").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` for every node but the smallest of each component: ``b`` is the smallest node reachable from ``a``.

    Alternates large and small stars until nothing changes.  A step takes minima per node, so hubs are aggregated
    before the shuffle, and every round is kept in the shared checkpoint folder.
    """

    def state(df: DataFrame) -> tuple:
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum("b")).first()

    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = settle(small.unionByName(down.withColumnRenamed("m", "b")).distinct())
        if (then := state(now)) == was:
            break
        was = then
    return now


def near_copies(docs: DataFrame, width: int = 3) -> DataFrame:
    """Groups of documents whose fingerprints are chained by links of two differing bits at most.

    Returns ``doc_id, fp, component_id`` (the smallest doc_id of the group) for every row.  Texts are read whole.  A
    null or blank text has fingerprint zero and is linked like any other; fewer than ``width`` words are one shingle.
    Repeated rows get the same answer each.  Rows without doc_id get a fingerprint, take part in no link and have a
    null component.  Other columns are ignored; an empty table gives an empty result.
    """
    prints = settle(fingerprints(docs, width))
    distinct = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"))
    stars = components(links(distinct))
    named = distinct.join(stars.withColumnRenamed("a", "id"), "id", "left").select(
        "fp", F.coalesce("b", "id").alias("component_id")
    )
    return prints.join(named, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, width: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the document with the smallest doc_id stays.

    All columns are kept as they are.  Repeated rows of one doc_id and text become one row; rows without doc_id stay.
    """
    gone = near_copies(docs, width).where("doc_id <> component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return known.select(docs.columns).unionByName(docs.where("doc_id is null"))
