"""Toxicity by exact nearest labelled examples in TF-IDF space.

All lower-cased words of all drawn examples span the vector space. A term weighs
(1 + ln TF) times IDF times the square of its relevance frequency, log2(2 + lift / 4), where
lift is how much likelier it is in toxic than in clean examples; vectors are normalised over all their terms, in a text also those that no
example has. The relevance frequency is a deviation from plain TF-IDF, which can't tell
the labels apart here (figures in the README).

The examples lie in an inverted index cut into blocks, with the largest weight of each
term per block. A query adds these up to a bound per block and visits blocks in falling
order of the bound until none can enter its k nearest, so the k nearest are exact. Terms
that many examples have are kept as dense rows and summed for a batch of queries at once.
Votes weigh by cosine and by the labelled rows an example stands for (its label's count
over the number drawn of it), and so do the counts behind IDF and relevance frequency; the
score is a logistic curve of their smoothed share, fitted on the examples with the same
weights, each left out of its own vote. The nearest ids are the evidence.

Examples: at most `per_label` labelled doc_ids of each label, those of least hash among
the rows `learn` allows; of a doc_id with several texts the least text. Both bounds are
parameters. What the driver collects are the words of these examples, not their texts.
Null, empty or wordless text: the toxic share of the labelled rows, 0.49 at most. Repeated
rows score alike; repeated labels: the largest counts; null labels teach nothing; an
empty table gives no rows; extra columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import slices, table

_WORDS = re.compile(r"[^\W\d_]+").findall
BATCH = 128  # queries whose frequent terms are summed at once


def vocabulary(text: str | None) -> dict[str, int]:
    """The words of a text and how often each occurs."""
    return Counter(_WORDS(text.lower())) if text else {}


def damped(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges first..end one after another, and the size of each."""
    size = end - first
    return np.repeat(end - np.cumsum(size), size) + np.arange(size.sum()), size


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(share: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b), drawn lightly to (-4, 8), such that logistic(a + b * share) is the chance of label 1."""
    start = line = np.array([-4.0, 8.0])
    x = np.stack([np.ones(len(y)), share], 1)
    for _ in range(40):
        p = logistic(x @ line)
        slope = x.T @ (weight * (y - p)) - 0.05 * (line - start)
        line = line + np.clip(np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.05 * np.eye(2), slope), -2, 2)
    return tuple((line if line[1] > 0 else start).tolist())


class Index:
    def __init__(self, rows: Iterable[tuple[int, dict[str, int], int]], block: int = 64, k: int = 9, weigh: tuple[float, float] = (1.0, 1.0)):
        """rows: (id, words and their counts, label), gone through once. `weigh`: how many labelled rows an example of label 0 and one of label 1 stand for."""
        self.k, self.block, self.id = k, block, {}
        terms, counts, given, rows = [], [], rows, []
        for d, found, y in given:
            terms.append(np.fromiter((self.id.setdefault(t, len(self.id)) for t in found), np.int32, len(found)))
            counts.append(np.fromiter(found.values(), np.float32, len(found)))
            rows.append((d, y))
        pos, neg = np.zeros(len(self.id)), np.zeros(len(self.id))
        for (*_, y), t in zip(rows, terms):
            (pos if y else neg)[t] += weigh[y]
        size = sum(weigh[y] for *_, y in rows)
        self.unseen = float(np.log(1 + size))  # weight of a term that no example has
        # how much likelier the term is in toxic examples, one of each kind taken from or added to the counts
        toxic = sum(y for *_, y in rows)
        lift = np.maximum(0, pos / weigh[1] - 1) / max(1, toxic) * max(1, len(rows) - toxic) / (neg / weigh[0] + 1)
        self.idf = np.log((1 + size) / np.maximum(1, pos + neg)) * np.log2(2 + lift / 4) ** 2
        vectors = [damped(c) * self.idf[t].astype(np.float32) for t, c in zip(terms, counts)]
        unit = [v / (np.linalg.norm(v) or 1) for v in vectors]
        del counts
        # in order of their heaviest term, so that blocks are alike; a text without a word is near to nothing
        order = sorted((i for i in range(len(rows)) if len(terms[i])), key=lambda i: (int(terms[i][np.argmax(vectors[i])]), rows[i][0]))
        self.ids, self.y = np.array([rows[i][0] for i in order], np.int64), np.array([rows[i][1] for i in order], float)
        self.places = -(-len(order) // block) * block
        t = np.concatenate([np.zeros(0, np.int32), *(terms[i] for i in order)])
        at = np.repeat(np.arange(len(order), dtype=np.int32), [len(terms[i]) for i in order])
        x = np.concatenate([np.zeros(0, np.float32), *(unit[i].astype(np.float32) for i in order)])
        by = np.argsort(t, kind="stable")
        t, self.at, self.x = t[by], at[by], x[by]
        # terms of more than a thirty-second of the examples are summed as dense rows, the others by postings
        often = np.flatnonzero(np.bincount(t, minlength=len(self.id)) * 32 > len(order))
        self.row = np.full(len(self.id), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.places), np.float32)
        mine = self.row[t] >= 0
        self.dense[self.row[t[mine]], self.at[mine]] = self.x[mine]
        # one entry for each block that has the term: its first posting and largest weight
        first = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.diff(self.at // block, prepend=-1) != 0))
        self.at_block, self.bounds = self.at[first] // block, np.maximum.reduceat(self.x, first) if len(first) else self.x
        self.first = np.append(first, len(t)).astype(np.int32)
        self.entries = np.searchsorted(t[first], np.arange(len(self.id) + 1)).astype(np.int32)
        self.prior = sum(weigh[1] for *_, y in rows if y) / size if rows else 0.1
        # in units of their mean, so that the smoothing is the same for any draw
        self.weight = np.array([weigh[rows[i][1]] for i in order]) * (len(rows) / size if rows else 1)
        near = self.nearest([(terms[i], unit[i]) for i in order], np.arange(len(order)))
        self.line = fitted(np.array([self.share(*n) for n in near]), self.y, self.weight)

    def vector(self, found: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that some example has and their weights, normalised over all words, known or not."""
        ids = np.fromiter(map(self.id.get, found, [-1] * len(found)), np.int64, len(found))
        weights, known = damped(np.fromiter(found.values(), float, len(found))), ids >= 0
        weights *= np.where(known, self.idf[ids], self.unseen) if len(self.idf) else 1.0
        return ids[known], weights[known] / (np.linalg.norm(weights) or 1)

    def share(self, near: np.ndarray, at: np.ndarray) -> float:
        """Smoothed toxic share of the votes; each counts for the labelled rows its example stands for."""
        votes = near * self.weight[at]
        return (float(votes @ self.y[at]) + self.prior * 0.05) / (float(votes.sum()) + 0.05)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector cosines and places of the k nearest examples but the one at its `skip`, nearest first, ties to the earlier place."""
        out = []
        for start in range(0, len(vectors), BATCH):
            part = vectors[start : start + BATCH]
            asked = np.zeros((len(part), len(self.dense)), np.float32)
            rest = []
            for i, (terms, weights) in enumerate(part):
                rows = self.row[terms]
                frequent = rows >= 0
                asked[i, rows[frequent]] = weights[frequent]
                rest.append((terms[~frequent], weights[~frequent]))
            sums = asked @ self.dense
            if skip is not None:
                sums[np.arange(len(part)), skip[start : start + BATCH]] = -2
            tops = sums.reshape(len(part), -1, self.block).max(axis=2) if self.places else sums
            for i, (terms, weights) in enumerate(rest):
                out.append(self._best(terms, weights, sums[i], tops[i]))
        return out

    def _best(self, terms, weights, sums, tops):
        """The k nearest, given what frequent terms add to each example (`sums`) and at most to each block (`tops`)."""
        entries, size = ranges(self.entries[terms], self.entries[terms + 1])
        blocks, weight = self.at_block[entries], np.repeat(weights, size)
        bound = tops + np.bincount(blocks, weight * self.bounds[entries], len(tops))
        sums, open_ = sums.astype(float), bound > 0
        # the blocks of the highest bounds first; then those whose bound reaches the k-th best so far
        for now in (np.argpartition(-bound, 7)[:8] if len(bound) > 8 else np.arange(len(bound)), None):
            chosen = np.zeros(len(bound), bool)
            if now is None:
                least = np.partition(sums, -self.k)[-self.k] if len(sums) >= self.k else 0.0
                chosen = open_ & (bound >= least - 1e-6)
            else:
                chosen[now] = True
                chosen &= open_
            open_ &= ~chosen
            mine = chosen[blocks]
            if mine.any():
                postings, size = ranges(self.first[entries[mine]], self.first[entries[mine] + 1])
                sums += np.bincount(self.at[postings], np.repeat(weight[mine], size) * self.x[postings], len(sums))
        least = np.partition(sums, -self.k)[-self.k] if len(sums) >= self.k else 0.0
        best = np.flatnonzero((sums >= least) & (sums > 0))
        best = best[np.lexsort((best, -sums[best]))][: self.k]
        return sums[best], best

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """(score, ids of the nearest examples) of each text."""
        vectors = [self.vector(vocabulary(t)) for t in texts]
        out = []
        for near, at in self.nearest(vectors):
            if len(at):
                out.append((float(logistic(self.line[0] + self.line[1] * self.share(near, at))), self.ids[at].tolist()))
            else:
                out.append((min(self.prior, 0.49), []))
        return out


def held_out():
    return F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False))


def _bags(batches):
    for batch in slices(batches):
        bags = [vocabulary(t) for t in batch["_t"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["_d"], batch["_y"], pa.array([" ".join(b) for b in bags], pa.string()), pa.array([np.fromiter(b.values(), np.int32, len(b)).tobytes() for b in bags], pa.binary())],
            ["d", "y", "words", "counts"])


def train(docs: DataFrame, labels: DataFrame, learn, per_label: int = 3000) -> Index:
    known = (labels.where("doc_id is not null and toxic in (0, 1)").where(learn)
             .groupBy(F.col("doc_id").alias("_k")).agg(F.max("toxic").cast("int").alias("_y")))
    counts = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    # top-k by hash: every task keeps at most per_label ids, and 2 * per_label are broadcast, so no text is shuffled
    chosen = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(per_label) for y in (0, 1)]
    rows = docs.where("text is not null").select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
    bags = rows.join(F.broadcast(chosen[0].union(chosen[1])), F.col("_d") == F.col("_k")).select("_d", "_y", "_t").mapInArrow(_bags, "d long, y int, words string, counts binary")
    one = bags.groupBy("d").agg(F.min(F.struct("y", "words", "counts")).alias("x")).select("d", "x.*")
    found = sorted((r.d, r.words, bytes(r.counts), r.y) for r in one.collect())
    examples = ((d, dict(zip(w.split(" ") if w else (), np.frombuffer(c, np.int32).tolist())), y) for d, w, c, y in found)
    return Index(examples, weigh=tuple(max(1.0, counts.get(y, 0) / per_label) for y in (0, 1)))


def score(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence); evidence lists the nearest examples' doc_id. The index is bounded by its examples."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in slices(batches):
            got = held.value.scores(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<long>")


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


QUERIES, SQL = {"op8_toxicity": op8_toxicity}, {}
