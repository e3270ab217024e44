"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from linewright.llm import decontaminate, langid, packing, simhash, suffixdedup
from linewright.llm._util import cut, table


def language(spark, docs, sf_dir):
    """Documents without a recognised language (null text, or no letter) go; null ids and repeated rows are judged by their text."""
    return langid.recognised(docs, langid.fitted(table(spark, sf_dir, "documents")))


def near_duplicates(spark, docs, sf_dir):
    """One row of each group stays: of the smallest doc_id, null ids after all others; copies of that row go too. Texts without a word form one group."""
    return simhash.representatives(docs)


def repeated_passages(spark, docs, sf_dir):
    """Repeated passages of 50 words or more are cut, but for one occurrence of each; a text of which nothing is left goes. Null ids and texts pass."""
    return suffixdedup.remove_repeats(docs)


def benchmark_free(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none; null ids and repeated rows are judged by their text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark, docs, sf_dir):
    """All rows in sequences of at most 2048 tokens. A null or empty text is its end mark; null ids and repeated rows are packed like any other."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_free", benchmark_free), ("packed", packed)]
#: No tokenizer can be told in SQL; tests/llm holds run() against a plain version of all stages.
ORACLE_SQL = None


def _remove(spark, path):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark, sf_dir, folder=None):
    """The packed sequences of sf_dir's documents; stages are written in `folder`, else where spark.checkpoint.dir says. What a stage wrote goes once the next is written; the last one's rows stay."""
    docs, folder, last = table(spark, sf_dir, "documents"), folder or spark.conf.get("spark.checkpoint.dir", None), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if folder is None:  # a single local process
            docs = cut(out)
            continue
        path = f"{folder}/stage-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _remove(spark, last)
        last = path
    return docs
