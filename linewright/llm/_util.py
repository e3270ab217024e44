"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 1024):
    """Arrow batches in parts of some rows, so that a task's texts and results in Python stay small whatever the session's batches are."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder the cluster names; a private one only in a single local process."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="linewright"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph given as (a, b): root is the least node reachable.

    Minimum labels spread over the edges, then pointers jump; both steps are partial
    aggregates and joins, so no node's neighbours meet in one task. Nodes without an
    edge do not appear. Each round is checkpointed.
    """
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    labels = cut(labels)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        # hook: the root of a node learns the least root seen by any of its members
        told = labels.join(near, labels.node == near.a).select(
            "node", "root", F.least("root", "m").alias("new"))
        hook = told.groupBy(F.col("root").alias("r")).agg(F.min("new").alias("to"))
        step = told.join(hook, told.new == hook.r, "left").select(
            "node", F.col("root").alias("old"), F.coalesce(F.least("new", "to"), "new").alias("root"))
        step = cut(step)
        if step.where("old <> root").limit(1).count() == 0:
            return step.select("node", "root")
        labels = step.select("node", "root")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; LINEWRIGHT_TOKENIZERS overrides the folder."""
    folder = os.environ.get("LINEWRIGHT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
