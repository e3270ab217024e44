"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are dealt out three times, each time by one third of their bits: two
fingerprints within 2 bits agree on some third, so every link meets in some task. A task
sorts all its fingerprints of one deal by the Gray rank of their bits, the dealt third
first, factors the bits that neighbours share into upper nodes, and walks pairs of nodes
from the top, adding up differences and dropping whole groups beyond the limit. Links
leave a task as a spanning forest, never as all pairs.

Where more than `most` fingerprints share a third (many variants of one template), they
are dealt again by thirds of the other bits, by the same argument and up to `DEPTH` times;
then at most 2 ** 19 fingerprints can share the dealt bits.

Null or wordless text: fingerprint zero, linked like any other. A null doc_id takes part
in linking and is never a component_id unless its component has no other. Repeated rows
give a row each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import components, cut, partitions, slices, table

DEPTH = 3


def fingerprint(text: str | None) -> int:
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        hashes = [digest(joined, 42)]
    else:
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip([0, *ends[:-3]], ends[2:])]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        raw = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(raw, axis=0, dtype=np.int32)
    bits = (ones * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in slices(batches):
        found = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(found.view(np.int64))], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): th is a hash of the text, by which rows of one doc_id differ."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def thirds(mask: int = 0) -> list[int]:
    """`mask` with each third of the other bits in turn."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in rest[k * len(rest) // 3 : (k + 1) * len(rest) // 3]) for k in range(3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def leading(x: np.ndarray, mask: int) -> np.ndarray:
    """x with the bits of the mask moved to the top, in order; distances stay."""
    order = sorted(range(63, -1, -1), key=lambda i: not mask >> i & 1)
    bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    packed = np.packbits(bits[:, [63 - i for i in order]], axis=1)
    return np.ascontiguousarray(packed).view(">u8").ravel().astype(np.uint64)


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def index_links(x: np.ndarray, limit: int, leaf: int = 16, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of {(i, j): at most `limit` bits differ} over distinct fingerprints.

    `counts` gets the tree's levels and the pairs of nodes visited and dropped at each.
    """
    order = np.argsort(gray_rank(x), kind="stable")
    s = x[order]
    parent = list(range(len(s)))
    label = np.arange(len(s))  # roots as of the last batch

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    a, b = [], []
    # nodes of a level: runs of leaf * 2**level fingerprints with the mask of bits all share, and their values
    levels = []
    starts = np.arange(0, len(s), leaf)
    ones, any_ = np.bitwise_and.reduceat(s, starts), np.bitwise_or.reduceat(s, starts)
    while True:
        levels.append((~(ones ^ any_), ones))
        if len(ones) == 1:
            break
        pairs = np.arange(0, len(ones), 2)
        ones, any_ = np.bitwise_and.reduceat(ones, pairs), np.bitwise_or.reduceat(any_, pairs)
    p = q = np.zeros(1, np.int64)
    stack = [(len(levels) - 1, p, q)]
    while stack:
        level, p, q = stack.pop()
        if len(p) > 200_000:  # bounds memory: the frontier is walked in parts
            stack += [(level, p[i : i + 200_000], q[i : i + 200_000]) for i in range(0, len(p), 200_000)]
            continue
        mask, value = levels[level]
        near = np.bitwise_count((value[p] ^ value[q]) & mask[p] & mask[q]) <= limit
        if counts is not None:
            visited, dropped = counts.setdefault(level, (0, 0))
            counts[level] = visited + len(p), dropped + int((~near).sum())
        p, q = p[near], q[near]
        if level:
            n = len(levels[level - 1][0])
            pp = np.concatenate([2 * p, 2 * p, 2 * p + 1, 2 * p + 1])
            qq = np.concatenate([2 * q, 2 * q + 1, 2 * q, 2 * q + 1])
            good = (pp <= qq) & (qq < n) & (pp < n)
            stack.append((level - 1, pp[good], qq[good]))
            continue
        for at in range(0, len(p), 4096):
            u = (p[at : at + 4096, None] * leaf + np.arange(leaf))[:, :, None]
            v = (q[at : at + 4096, None] * leaf + np.arange(leaf))[:, None, :]
            u, v = np.broadcast_arrays(u, v)
            good = (u < v) & (v < len(s))
            u, v = u[good], v[good]
            near = (np.bitwise_count(s[u] ^ s[v]) <= limit) & (label[u] != label[v])
            for i, j in zip(u[near].tolist(), v[near].tolist()):
                i, j = root(i), root(j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
                    a.append(i)
                    b.append(j)
            if near.any():
                label = np.array(parent)
                while not np.array_equal(label, label[label]):
                    label = label[label]
    return order[np.array(a, np.int64)], order[np.array(b, np.int64)]


def _linker(limit: int):
    def run(batches):
        rows = [(b["m"].to_numpy(), b["fp"].to_numpy()) for b in batches]
        if not rows:
            return
        m, fp = (np.concatenate(c) for c in zip(*rows))
        for mask in np.unique(m).tolist():
            x = fp[m == mask].view(np.uint64)
            a, b = index_links(leading(x, mask & (1 << 64) - 1), limit)
            yield pa.RecordBatch.from_arrays([pa.array(x[a].view(np.int64)), pa.array(x[b].view(np.int64))], ["a", "b"])

    return run


def _deal(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """(m, v, fp): every row under each of the masks that follow its mask `m`; v holds the masked bits."""
    follow = F.create_map(*[F.lit(x) for m, n in masks.items() for x in (_signed(m), [_signed(k) for k in n])])
    return rows.select(F.explode(F.element_at(follow, F.col("m"))).alias("m"), "fp").select("m", F.col("fp").bitwiseAND(F.col("m")).alias("v"), "fp")


def dealt(fingerprints: DataFrame, most: int = 20_000) -> DataFrame:
    """(m, v, fp): each fingerprint under three masks, or more where over `most` share what a mask leaves."""
    masks, parts = {0: thirds()}, []
    rows = _deal(fingerprints.select(F.lit(0).cast("long").alias("m"), "fp"), masks)
    for _ in range(DEPTH - 1):
        much = cut(rows.groupBy("m", "v").agg(F.count("*").alias("n")).where(F.col("n") > most).select("m", "v"))
        if much.isEmpty():
            break
        parts.append(rows.join(much, ["m", "v"], "left_anti"))
        masks = {k: thirds(k) for n in masks.values() for k in n}
        rows = _deal(rows.join(much, ["m", "v"]), masks)
    for p in parts:
        rows = rows.union(p)
    return rows.repartition(partitions(fingerprints.sparkSession), "m", "v")


def _named(found: DataFrame, limit: int, most: int) -> DataFrame:
    """(f, head): for each fingerprint the first row of its component, as (no doc_id, doc_id, th)."""
    if not 0 <= limit <= 2:
        raise ValueError("the thirds hold for at most 2 bits")
    firsts = found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("first"))
    roots = components(dealt(firsts.select("fp"), most).select("m", "fp").mapInArrow(_linker(limit), "a long, b long"))
    labelled = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("head"))
    return labelled.join(least, "root").select(F.col("fp").alias("f"), "head")


def near_duplicates(docs: DataFrame, limit: int = 2, most: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) of every row; `limit` is at most 2, what the thirds guarantee."""
    found = cut(fingerprints(docs))
    return found.join(_named(found, limit, most), F.col("fp") == F.col("f")).select("doc_id", "fp", F.col("head.doc_id").alias("component_id"))


def representatives(docs: DataFrame, limit: int = 2, most: int = 20_000) -> DataFrame:
    """One row of each component, in all its columns: of the smallest doc_id (null: after all others), then of the least text hash.

    Of several rows alike in doc_id and text any one stays.
    """
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    doc, text = plain[names.index("doc_id")], plain[names.index("text")]
    found = cut(fingerprints(docs))
    row = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")
    each = found.groupBy("doc_id", "th", "fp").agg(F.count("*").alias("rows")).join(_named(found, limit, most), F.col("fp") == F.col("f"))
    # only rows that go, or stay once, are listed
    listed = each.select(F.coalesce("doc_id", "th").alias("_k"), F.col("doc_id").isNull().alias("_n"), F.col("th").alias("_h"), (row == F.col("head")).alias("_stays"), "rows").where("not _stays or rows > 1").drop("rows")
    rows = docs.toDF(*plain).withColumn("_th", F.xxhash64(text)).withColumn("_doc", F.coalesce(F.col(doc).cast("long"), "_th")).withColumn("_null", F.col(doc).isNull())
    same = (F.col("_doc") == F.col("_k")) & (F.col("_null") == F.col("_n")) & (F.col("_th") == F.col("_h"))
    alone = rows.join(listed, same, "left_anti").select(*plain)
    once = rows.join(listed.where("_stays"), same, "left_semi").dropDuplicates(["_doc", "_null", "_th"]).select(*plain)
    return alone.union(once).toDF(*names)


def op9_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES, SQL = {"op9_simhash": op9_simhash}, {}
