"""Hierarchical language identification with linear support vector machines.

Features are hashed byte trigrams of the lower-cased whole text. A one-versus-one SVM
decides between language families, then one-versus-one SVMs within the family vote.
The score is the logistic of the summed signed margins of the winner, 0 to 1.

Training rows: at most `per_language` (500) distinct rows of each language, chosen by the
hash of doc_id and text among the rows `learn` allows; the bound is that parameter, and
what reaches the driver are their features, of fixed size. Null text or text
without a letter: `und`, score 0. Null languages teach nothing. With no rows to learn
from, every prediction is `und`. Repeated rows are predicted alike; an empty table gives
no rows; extra columns pass through, but for those named lang_pred and score, which
`predict` replaces.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import slices, table

#: Families of languages by ISO code; others form a family of their own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance"}
SIZE = 1 << 12
_WORD = re.compile(r"[^\W\d_]+").finditer


def has_letter(text: str) -> bool:
    """Whether a Unicode letter occurs; other numeric characters, such as a raised two, are none."""
    return any(c.isalpha() for m in _WORD(text) for c in m.group())


def features(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        raw = np.concatenate((raw, np.full(3, 32, np.uint32)))
    h = (raw[:-2] * np.uint32(40503) + raw[1:-1] * np.uint32(30011) + raw[2:] * np.uint32(977)) * np.uint32(2654435761) >> np.uint32(20)
    v = np.sqrt(np.bincount(h, minlength=SIZE).astype(np.float32))
    return v / np.linalg.norm(v)


def svm(x: np.ndarray, y: np.ndarray, passes: int = 20, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """Pegasos with averaging; y is -1 or 1."""
    w, mean, rng, step = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.random.default_rng(5), 0
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    for _ in range(passes):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            step += 1
            bad = rows[y[rows] * (x[rows] @ w) < 1]
            rate = 1 / (reg * (step + 100))
            w *= 1 - rate * reg
            if len(bad):
                w += rate / len(rows) * (y[bad] @ x[bad])
            mean += (w - mean) / step
    return mean[:-1].astype(np.float32), float(mean[-1])


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        family = [FAMILIES.get(c, c) for c in langs]
        self.members = {f: sorted({c for c, g in zip(langs, family) if g == f}) for f in sorted(set(family))}
        pairs = [("", a, b, family) for a, b in combinations(self.members, 2)]
        pairs += [(f, a, b, langs) for f, m in self.members.items() for a, b in combinations(m, 2)]
        self.pairs, weights = [(f, a, b) for f, a, b, _ in pairs], []
        for _, a, b, names in pairs:
            pick = np.array([i for i, c in enumerate(names) if c in (a, b)])
            weights.append(svm(x[pick], np.array([1.0 if names[i] == a else -1.0 for i in pick])))
        self.w = np.array([w for w, _ in weights], np.float32).reshape(len(pairs), SIZE)
        self.b = np.array([b for _, b in weights], np.float32)

    def best(self, level: str, names: list[str], margins) -> tuple[str, float]:
        won, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (f, a, b), m in zip(self.pairs, margins):
            if f == level and a in won and b in won:
                won[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
        first = max(names, key=lambda n: (won[n], sums[n]))
        return first, sums[first] if len(names) > 1 else 4.0

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.members or not has_letter(text):
            return "und", 0.0
        margins = (self.w @ features(text) + self.b).tolist() if self.pairs else []
        family, sure = self.best("", list(self.members), margins)
        lang, inner = self.best(family, self.members[family], margins)
        return lang, float(1 / (1 + np.exp(-3 * max(min(sure, inner), -10.0))))


def train(docs: DataFrame, learn, per_language: int = 500) -> Model:
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in docs.where(learn & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(chance)
    h = F.xxhash64("doc_id", "text")
    drawn = known.select("lang", "text", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < chance * (1 << 30))

    def run(batches):
        for batch in slices(batches):
            rows = [features(t).astype(np.float16).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["h"], pa.array(rows, pa.binary())], ["lang", "h", "x"])

    # repeated rows meet before the shuffle and count once; then the bound holds whatever was drawn
    one = drawn.mapInArrow(run, "lang string, h long, x binary").groupBy("lang", "h").agg(F.min("x").alias("x"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = sorted((r.lang, bytes(r.x)) for r in one.withColumn("r", rank).where(F.col("r") <= per_language).collect())
    x = np.array([np.frombuffer(v, np.float16) for _, v in rows], np.float32).reshape(len(rows), SIZE)
    return Model(x, [c for c, _ in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with lang_pred and score; the model has a fixed size per pair of languages."""
    held, names = docs.sparkSession.sparkContext.broadcast(model), [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[docs[c] for c in names])

    def run(batches):
        for batch in slices(batches):
            got = [held.value(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with a language, in all their columns."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    rows = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([held.value(t)[0] != "und" for t in batch.column(at).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def held_out():
    return F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), F.lit(False))


def fitted(docs: DataFrame) -> Model:
    return train(docs, ~held_out())


def op7_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), fitted(docs)).select("doc_id", "held_out", "lang_pred", "score")


QUERIES, SQL = {"op7_langid": op7_langid}, {}
