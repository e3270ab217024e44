"""Fuzzy grouping: keys that differ little count as one.

The similarity is one minus an approximate edit distance over the longer length. The distance walks
both texts once; where they differ it looks up to `offset` characters ahead for the next place that
agrees, and what agrees in runs is common.

Groups are made over distinct keys with their counts, most frequent first: a key joins the first
representative it is similar enough to. Keys are compared within blocks of one first word (digits
aside), so that no task holds all keys; the result doesn't depend on the order of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distance(a: str, b: str, offset: int) -> int:
    """Approximate edit distance: the longer length less the characters that agree in order."""
    if not a or not b:
        return max(len(a), len(b))
    i = j = common = run = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            run += 1
        else:
            common, run = common + run, 0
            i = j = max(i, j)
            for step in range(offset):
                if i + step >= len(a) and j + step >= len(b):
                    break
                if i + step < len(a) and j < len(b) and a[i + step] == b[j]:
                    i, run = i + step, run + 1
                    break
                if i < len(a) and j + step < len(b) and a[i] == b[j + step]:
                    j, run = j + step, run + 1
                    break
        i, j = i + 1, j + 1
    return max(len(a), len(b)) - common - run


def similarity(a: str, b: str, offset: int) -> float:
    return 1.0 if not a and not b else 1.0 - distance(a, b, offset) / max(len(a), len(b))


def _joined(least: float, offset: int):
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads: list[str] = []
        out = []
        for key in pdf.sort_values(["count", "key"], ascending=[False, True], kind="stable")["key"]:
            head = next((h for h in heads if similarity(h, key, offset) > least), None)
            if head is None:
                heads.append(key)
            out.append((key, head or key))
        return pd.DataFrame(out, columns=["name", "head"])

    return run


def fuzzy_keys(keys: DataFrame, least: float = 0.75, offset: int = 10) -> DataFrame:
    """(key, count): each distinct key's count under the representative it joins."""
    counts = keys.groupBy("key").agg(F.count("*").alias("count"))
    word = F.regexp_replace(F.regexp_extract("key", r"^\s*(\S*)", 1), "[0-9]+", "0")
    heads = counts.withColumn("block", word).groupBy("block").applyInPandas(_joined(least, offset), "name string, head string")
    return counts.join(heads, counts["key"] == heads["name"]).groupBy(F.col("head").alias("key")).agg(F.sum("count").alias("count"))
