"""Text sources: files, folders, globs and gzip, with path filters; and the CSV sinks."""

from __future__ import annotations

import fnmatch
import glob
import os
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Walk:
    """Regular files under the paths: globs expand, exclusion goes first, links are followed once.

    `total`, `excluded` and `errors` count while the paths are gone through.
    """

    paths: list[str]
    recursive: bool = False
    include: tuple = ()
    exclude: tuple = ()
    exclude_dir: tuple = ()
    follow: bool = False
    one_device: bool = False
    read_links: bool = True
    total: int = 0
    excluded: int = 0
    errors: list[str] = field(default_factory=list)

    def _wanted(self, path: str) -> bool:
        name = os.path.basename(path)
        out = any(fnmatch.fnmatch(name, p) for p in self.exclude) or bool(self.include) and not any(fnmatch.fnmatch(name, p) for p in self.include)
        out = out or (not self.read_links and os.path.islink(path))
        self.total, self.excluded = self.total + (not out), self.excluded + out
        return not out

    def __iter__(self):
        seen = set()
        for pattern in self.paths:
            for top in sorted(glob.glob(pattern)) or [pattern]:
                if not os.path.isdir(top):
                    if self._wanted(top):
                        yield top
                    continue
                if not self.recursive:
                    continue
                device = os.stat(top).st_dev
                for folder, dirs, files in os.walk(top, followlinks=self.follow, onerror=lambda e: self.errors.append(str(e))):
                    real = os.path.realpath(folder)
                    if real in seen:
                        dirs.clear()
                        continue
                    seen.add(real)
                    keep = [d for d in dirs if not any(fnmatch.fnmatch(d, p) for p in self.exclude_dir) and not (self.one_device and os.stat(os.path.join(folder, d)).st_dev != device)]
                    dirs[:] = sorted(keep)
                    yield from (p for f in sorted(files) if os.path.isfile(p := os.path.join(folder, f)) and self._wanted(p))


def walk(paths, recursive=False, include=(), exclude=(), exclude_dir=(), follow=False, one_device=False):
    yield from Walk(list(paths), recursive, tuple(include), tuple(exclude), tuple(exclude_dir), follow, one_device)


def readable(paths) -> tuple[list[str], list[str]]:
    """Local paths that can be opened, and what is wrong with the others."""
    good, bad = [], []
    for p in paths:
        try:
            with open(p, "rb"):
                good.append(p)
        except OSError as e:
            bad.append(f"open {p}: {(e.strerror or '').lower()}")
    return good, bad


def _zipped(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(2) == b"\x1f\x8b"


def _unzip(batches):
    """Lines of gzip contents, whatever the name of the file."""
    import gzip
    import io

    import pyarrow as pa

    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            rows = io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(content)), encoding="utf-8", errors="replace", newline="\n")
            part, n = [], 0
            for n, line in enumerate(rows, 1):
                part.append(line.removesuffix("\n").removesuffix("\r"))
                if len(part) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([path] * len(part)), pa.array(range(n - len(part) + 1, n + 1), pa.int64())], ["value", "src", "line"])
                    part = []
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([path] * len(part)), pa.array(range(n - len(part) + 1, n + 1), pa.int64())], ["value", "src", "line"])


def _names(path, relative: bool = True):
    """Paths as they were given: without the scheme of local files and, where they were relative, the working folder."""
    bare = F.regexp_replace(path, "^file:(//)?", "")
    if not relative:
        return bare
    here = os.getcwd().rstrip("/") + "/"
    return F.when(F.startswith(bare, F.lit(here)), F.substring(bare, len(here) + 1, 1 << 30)).otherwise(bare)


def _blocks(df: DataFrame) -> int:
    """An upper bound on the blocks that a text scan is cut into."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return size // max(1, min(split, 1 << 22)) + len(df.inputFiles())


def numbered_lines(df: DataFrame, relative: bool = True) -> DataFrame:
    """(value, src, line) of the text source: lines are counted per block of a file, and blocks add up.

    Nothing but one row per block is shuffled, so a file may have any size.
    """
    rows = df.select("value", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_r"))
    blocks = rows.groupBy("_p", "_b").agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("_p").alias("_q"), F.col("_b").alias("_c"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    if _blocks(df) <= 100_000:  # some 15 MB; beyond, Spark picks the join
        blocks = F.broadcast(blocks)
    joined = rows.join(blocks, (F.col("_p") == F.col("_q")) & (F.col("_b") == F.col("_c")))
    return joined.select("value", _names(F.col("_p"), relative).alias("src"), (F.col("_before") + F.col("_r") - F.col("_first") + 1).cast("long").alias("line"))


def read(spark: SparkSession, *paths: str, recursive: bool = False, numbered: bool = False, include=(), exclude=(), exclude_dir=(), gunzip: bool = False) -> DataFrame:
    """(value, src[, line]); one trailing CR goes. A path given twice is read twice.

    Path filters list local files on the driver first. `gunzip` unpacks files that hold gzip data under any name and
    reads the others as they are; a zipped file is one task's.
    """
    paths = list(paths)
    if include or exclude or exclude_dir:
        paths = list(walk(paths, recursive, include, exclude, exclude_dir))
        if not paths:
            return spark.createDataFrame([], "value string, src string" + (", line long" if numbered else ""))
    relative = not all(p.startswith("/") or "://" in p for p in paths)
    paths = [p if "://" in p or p.startswith("file:") else os.path.abspath(p) for p in paths]  # the JVM has a working folder of its own
    zipped = [p for p in paths if gunzip and os.path.isfile(p) and _zipped(p)]
    plain, parts, columns = [p for p in paths if p not in zipped], [], ["value", "src", *(["line"] if numbered else [])]
    for group in _distinct(plain):
        df = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower()).text(group)
        rows = numbered_lines(df, relative) if numbered else df.select("value", _names(F.col("_metadata.file_path"), relative).alias("src"))
        parts.append(rows.withColumn("value", F.regexp_replace("value", "\r\\z", "")))
    for group in _distinct(zipped):
        found = spark.read.format("binaryFile").load(group).select("path", "content").mapInArrow(_unzip, "value string, src string, line long")
        parts.append(found.withColumn("src", _names(F.col("src"), relative)).select(*columns))
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionAll(p.select(*columns))
    return out


def _distinct(paths: list[str]) -> list[list[str]]:
    """The paths in lists without repeats: Spark reads a path once however often it is named."""
    out: list[list[str]] = []
    for p in paths:
        for group in out:
            if p not in group:
                group.append(p)
                break
        else:
            out.append([p])
    return out


def from_lines(spark: SparkSession, lines, source: str = "<stdin>") -> DataFrame:
    rows = [(x.rstrip("\n").removesuffix("\r"), source, i) for i, x in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "value string, src string, line long")


def events_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line for each row of events, with its id."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat_ws(
        " ", F.col("event_id").cast("string"), F.concat(F.lit("["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000]")),
        F.concat(F.lit("user="), F.col("user_id").cast("string")), "event_type", F.col("value").cast("string"), "props").alias("value"))


def counter_csv(df: DataFrame, path: str) -> None:
    df.select(F.col("key").alias("group"), F.col("count").alias("value")).orderBy(F.desc("value"), "group").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def table_csv(wide: DataFrame, path: str, by: str = "row") -> None:
    wide.orderBy(by).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv(header: list[str], rows, target: str, out=None) -> None:
    """One local file, or `out` (standard output) for `-`; rows come one by one."""
    import csv
    import sys

    with nullcontext(out or sys.stdout) if target == "-" else open(target, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator="\n")
        writer.writerow(header)
        writer.writerows(rows)
