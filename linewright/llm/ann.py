"""Nearest neighbours by collision-counting hashing.

Unit vectors are projected on `lines` random lines; in a chunk of vectors each line keeps
its values sorted. A query looks at the window of half-width r around its own value on
every line and counts how often a vector falls in; vectors over the collision threshold
are verified by exact cosine in double precision. r grows (virtual rehashing: wider
windows of the same arrays) until it covers what the k-th best so far could miss by.

The distinct vectors of the query rows go in blocks of `block_bytes` to every task, the
table is read in place and never shuffled. A task carries each query's best rows from
chunk to chunk, so its windows start as narrow as those allow, and returns k + 1 rows per
query at its end; these are merged per query vector. A table of n rows, read by as many
tasks as the cluster has cores, so returns cores * (k + 1) rows per query, whatever n.

Query rows that share a vector are answered together. A query's own row is no candidate,
other rows of the same vec_id are; repeated rows are separate candidates and separate
queries with an answer each. Vectors null, zero or with null or non-finite components take
no part, nor do rows with a null vec_id. Each vector length is searched on its own. Ties
go to the smaller vec_id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut, table

STRETCH = 0.95  # a line tells vectors at chord distance c apart by c * |N(0, 1)|


def _normal(x: np.ndarray) -> np.ndarray:
    """Vectors whose squares overflow or vanish, scaled by their largest component; the others as they are."""
    with np.errstate(over="ignore", under="ignore"):
        size = (x * x).sum(axis=1)
    odd = ~np.isfinite(size) | (size < 1e-290)
    if odd.any():
        x = x.copy()
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
    return x


class Queries:
    """Queries of one length with the best rows found so far: score falling, ties by id."""

    def __init__(self, vectors: np.ndarray, k: int, lines: int, seed: int = 11):
        self.raw, self.v = vectors, _normal(vectors)
        self.norm = np.sqrt((self.v * self.v).sum(axis=1))
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], lines))
        self.at = (self.v / self.norm[:, None]) @ self.axes
        self.best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))] * len(vectors)
        self.kth = np.full(len(vectors), -np.inf)
        self.k = k

    def offer(self, i: int, score, ids, same) -> None:
        s, d, m = (np.concatenate(x) for x in zip(self.best[i], (score, ids, same)))
        top = np.lexsort((d, -s))[: self.k]
        self.best[i] = s[top], d[top], m[top]
        if len(top) == self.k:
            self.kth[i] = s[top[-1]]

    def wanted(self, who) -> np.ndarray:
        """Half-width that the k-th best so far asks for."""
        return STRETCH * np.sqrt(np.maximum(0, 2 - 2 * np.maximum(self.kth[who], -1.0)))


def chunk_search(ids: np.ndarray, vectors: np.ndarray, queries: Queries, share: float = 0.5) -> None:
    """Offers each query the rows of this chunk that collide with it often enough."""
    x = _normal(vectors)
    norm = np.sqrt((x * x).sum(axis=1))
    values = (x / norm[:, None]) @ queries.axes
    n, lines = values.shape
    order = np.argsort(values, axis=0, kind="stable").astype(np.int32)
    ordered = np.take_along_axis(values, order, axis=0)
    flat, starts = order.T.ravel(), np.arange(lines) * n
    need = int(np.ceil(share * lines))
    active = np.arange(len(queries.v))
    wanted = queries.wanted(active)
    r = np.where(np.isfinite(queries.kth), wanted, 0.35)
    seen = [np.zeros(0, np.int64)] * len(active)
    while len(active):
        low, high = np.empty((len(active), lines), np.int64), np.empty((len(active), lines), np.int64)
        for j in range(lines):
            low[:, j] = np.searchsorted(ordered[:, j], queries.at[active, j] - r, "left")
            high[:, j] = np.searchsorted(ordered[:, j], queries.at[active, j] + r, "right")
        low, high = low + starts, high + starts
        for place, i in enumerate(active):
            hits = np.concatenate([flat[a:b] for a, b in zip(low[place].tolist(), high[place].tolist())])
            found = np.flatnonzero(np.bincount(hits, minlength=n) >= need)
            new = np.setdiff1d(found, seen[i], assume_unique=True) if len(seen[i]) else found
            seen[i] = found
            if not len(new):
                continue
            near = (x[new] @ queries.v[i]) / (norm[new] * queries.norm[i])
            floor = max(queries.kth[i], np.partition(near, -queries.k)[-queries.k] if len(near) > queries.k else -np.inf)
            new = new[near >= floor - 1e-9]
            # summed row by row in one order, so that equal vectors get equal scores
            score = (x[new] * queries.v[i]).sum(axis=1) / (norm[new] * queries.norm[i])
            queries.offer(i, score, ids[new], (vectors[new] == queries.raw[i]).all(axis=1))
        wanted = queries.wanted(active)
        full = np.isfinite(queries.kth[active])
        done = (r >= wanted) & full | (r > 1e8)
        r = np.where(full, wanted, np.where(r > 3, 1e9, r * 1.5))[~done]
        active = active[~done]


def _packed(batches):
    """Distinct query vectors as bytes of doubles."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["k1"], batch["k2"], pa.array([np.array(v, float).tobytes() for v in batch["v"].to_pylist()], pa.binary())], ["k1", "k2", "v"])


def _searcher(held, k: int, lines: int, chunk: int):
    def run(batches):
        by_length: dict[int, list] = {}
        for key, vector in held.value:
            by_length.setdefault(len(vector) // 8, []).append((key, np.frombuffer(vector)))
        asked = {d: Queries(np.array([v for _, v in rows]), k, lines) for d, rows in by_length.items()}
        waiting: dict[int, list] = {}

        def flush():
            for d, parts in waiting.items():
                chunk_search(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), asked[d])
            waiting.clear()

        rows = 0
        for batch in batches:
            ids, v = batch["vec_id"].to_numpy(), batch["v"]
            sizes, flat = np.diff(v.offsets.to_numpy()), v.values.to_numpy()[v.offsets[0].as_py() :]
            first = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                if d in asked:
                    mine = np.flatnonzero(sizes == d)
                    for at in range(0, len(mine), chunk):
                        part = mine[at : at + chunk]
                        waiting.setdefault(d, []).append((ids[part], flat[first[part][:, None] + np.arange(d)]))
                        rows += len(part)
                        if rows >= chunk:
                            flush()
                            rows = 0
        flush()
        for d, queries in asked.items():
            for (key, _), (score, ids, same) in zip(by_length[d], queries.best):
                if len(ids):
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1], np.int32)), pa.array(ids), pa.array(score), pa.array(same)], ["k1", "k2", "vec_id", "score", "same"])

    return run


def search(vectors: DataFrame, chosen, k: int = 5, lines: int = 24, chunk: int = 16_384, block_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score); `chosen` is the condition that marks query rows."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    sane = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where("vec_id is not null").where(sane).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("v"), chosen.alias("q"))
    keys = [F.xxhash64("v").alias("k1"), F.hash("v").alias("k2")]
    asks = rows.where("q").select(F.col("vec_id").alias("query_id"), *keys)
    distinct = rows.where("q").select(*keys, "v").groupBy("k1", "k2").agg(F.first("v").alias("v"))
    size = distinct.agg(F.coalesce(F.sum(F.size("v") * 8), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-size // block_bytes))
    base, found = rows.select("vec_id", "v").coalesce(spark.sparkContext.defaultParallelism), None
    for b in range(blocks):
        part = distinct.where(F.pmod("k1", F.lit(blocks)) == b).mapInArrow(_packed, "k1 long, k2 int, v binary")
        held = spark.sparkContext.broadcast([((r.k1, r.k2), bytes(r.v)) for r in part.collect()])
        got = base.mapInArrow(_searcher(held, k + 1, lines, chunk), "k1 long, k2 int, vec_id long, score double, same boolean")
        if blocks > 1:  # one block of queries at a time on the driver and the executors
            got = cut(got)
            held.unpersist()
        found = got if found is None else found.union(got)
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("place", place).where(F.col("place") <= k + 1)
    lists = best.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("near"))  # at most k + 1
    own = F.coalesce(F.array_position(F.transform("near", lambda n: (n["vec_id"] == F.col("query_id")) & n["same"]), True).cast("int"), F.lit(0))
    others = F.when(own > 0, F.concat(F.slice("near", F.lit(1), own - 1), F.slice("near", own + 1, F.lit(k + 1)))).otherwise(F.col("near"))
    answers = asks.join(lists, ["k1", "k2"]).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "n"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))


def op6_ann(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES, SQL = {"op6_ann": op6_ann}, {}
