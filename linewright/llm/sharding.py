"""Minimax contiguous sharding, in DataFrame functions only.

Equal texts form one atomic group; groups are ordered by the hash of their text. The
smallest capacity with which a greedy left-to-right fill needs at most `shards` shards is
found by binary search over the ordered group sizes, and the groups are cut there (law
`bytes`). The driver never holds all groups: it starts from the sizes of 2 ** `BITS` ranges
of the hash, bounds the capacity and every cut from both sides, and splits only ranges a
cut may fall in, until those are single groups. The rest can stay whole, as no feasible
fill cuts there, so the result is that of a fill over the groups themselves.

Null text: size 8, one group. Repeated rows each take a slot. An empty table gives no
rows. Extra columns are ignored. Texts of one 64-bit hash count as one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut, table

BITS, STEP = 16, 8  # bits of the hash that the first ranges go by, and that each split adds


def cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity, and the first index of each shard after the first."""

    def fill(capacity):
        starts, load = [], 0
        for i, s in enumerate(sizes):
            if load + s > capacity and load:
                starts.append(i)
                load = 0
            load += s
        return starts

    low, high = max([*sizes, -(-sum(sizes) // shards), 0]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if len(fill(mid)) < shards:
            high = mid
        else:
            low = mid + 1
    return low, fill(low)


def _floor(edges: np.ndarray, at: int) -> int:
    """The last edge at or before `at`."""
    return int(edges[np.searchsorted(edges, at, "right") - 1])


def bounds(sizes: np.ndarray, shards: int, largest: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Least and greatest smallest capacity of any fill that may also cut inside the ranges, and where each cut may be.

    `largest` is a lower bound on the size of the largest group. Places are in bytes from the start.
    """
    total, edges = int(sizes.sum()), np.concatenate(([0], np.cumsum(sizes)))
    low, high = max(largest, -(-total // shards)), cuts(sizes.tolist(), shards)[0]
    early, late, out = 0, 0, []
    for _ in range(shards - 1):
        early, late = _floor(edges, min(total, early + low)), late + high
        if early >= total:
            break
        out.append((early, min(total, late)))
    return low, high, out


def plan(rows: DataFrame, shards: int) -> list[int]:
    """First hash of each shard after the first. rows: (h, size)."""
    ranges = None  # (bits, prefix) -> (size, whether one group), in order of the hash

    def measured(part: DataFrame, bits: int):
        """Sizes by the first `bits` bits; a range of one hash is a group."""
        prefix = F.shiftright("h", 64 - bits).cast("long")
        found = part.groupBy(prefix.alias("p")).agg(F.sum("size").alias("s"), (F.min("h") == F.max("h")).alias("one")).collect()
        return [(r.p << 64 - bits, bits, r.s, r.one) for r in found]

    ranges = sorted(measured(rows, BITS))
    while ranges:
        sizes = np.array([r[2] for r in ranges], np.int64)
        ends = np.cumsum(sizes)
        largest = max([r[2] for r in ranges if r[3]], default=0)
        touched = np.zeros(len(ranges), bool)
        for first, last in bounds(sizes, shards, largest)[2]:
            touched[np.searchsorted(ends, first, "right") : np.searchsorted(ends, last, "left") + 1] = True
        # a range above the capacity may hide a group that decides it
        touched |= sizes > max(largest, -(-int(ends[-1]) // shards))
        split = [r for r, t in zip(ranges, touched) if t and not r[3]]
        if not split:
            break
        kept = [r for r, t in zip(ranges, touched) if not t or r[3]]
        for bits in sorted({r[1] for r in split}):
            prefixes = [r[0] >> 64 - bits for r in split if r[1] == bits]
            kept += measured(rows.where(F.shiftright("h", 64 - bits).cast("long").isin(prefixes)), min(64, bits + STEP))
        ranges = sorted(kept)
    starts = cuts([r[2] for r in ranges], shards)[1] if ranges else []
    return [ranges[i][0] for i in starts]


def shard(docs: DataFrame, shards: int = 24, buckets: int = 1024) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    at = F.lit(0)
    for first in plan(docs.select(F.xxhash64("text").alias("h"), size.alias("size")), shards):
        at = at + F.when(F.xxhash64("text") >= first, 1).otherwise(0)
    # each shard's rows are dealt to buckets at random, so that no key's rows meet; written once, so that the draw stays
    rows = cut(docs.select("doc_id", size.alias("size"), F.crc32(raw).alias("text_crc32"), at.cast("int").alias("shard"), F.floor(F.rand(3) * buckets).cast("int").alias("bucket")))
    # slots: at most shards x buckets counts give each bucket's first slot
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32"))
    return (rows.withColumn("k", within).join(F.broadcast(first), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def op3_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op3_sharding": op3_sharding}, {}
