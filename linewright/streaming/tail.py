"""Following files: a streaming source with a byte offset per file, and live aggregates."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16  # bytes read at a time
PART = 64 << 20  # bytes of a task


@dataclass
class Piece(InputPartition):
    """Bytes [start, end) of a file; lines that begin there are its rows."""

    path: str
    inode: int
    start: int
    end: int


def _line_end(path: str, size: int, least: int) -> int:
    """Place after the last line end before `size`, or `least`; reads backwards by blocks."""
    with open(path, "rb") as f:
        while size > least:
            at = max(least, size - BLOCK)
            f.seek(at)
            found = f.read(size - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            size = at
    return least


class TailReader(DataSourceStreamReader):
    """Whole lines appended since the offset. A file that shrank or was replaced starts anew; a missing file waits.

    The driver reads only as far back as the last line end; what was appended is read by tasks, in pieces.
    """

    def __init__(self, options):
        self.paths, self.tail = options["paths"].split(","), options.get("tail", "false") == "true"
        self.part, self.seen = int(options.get("part", PART)), {}

    def _now(self, path: str, inode: int, at: int) -> list[int]:
        try:
            s = os.stat(path)
            if s.st_ino != inode or s.st_size < at:
                at = 0
            return [s.st_ino, _line_end(path, s.st_size, at)]
        except OSError:
            return [inode, at]

    def initialOffset(self) -> dict:
        out = {}
        for p in self.paths:
            try:
                out[p] = [os.stat(p).st_ino, os.stat(p).st_size] if self.tail else [0, 0]
            except OSError:
                out[p] = [0, 0]
        self.seen = dict(out)
        return out

    def latestOffset(self) -> dict:
        self.seen = {p: self._now(p, *self.seen.get(p, (0, 0))) for p in self.paths}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for p, (inode, stop) in end.items():
            before, at = start.get(p, (0, 0))
            at = at if before == inode and at <= stop or before == 0 else 0
            self.seen.setdefault(p, [inode, stop])
            out += [Piece(p, inode, a, min(a + self.part, stop)) for a in range(at, stop, self.part)]
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        try:
            f = open(piece.path, "rb")
        except OSError:  # gone meanwhile
            return
        with f:
            if os.fstat(f.fileno()).st_ino != piece.inode:
                return
            f.seek(max(0, piece.start - 1))
            if piece.start and f.read(1) != b"\n":
                f.readline()  # belongs to the piece before
            while f.tell() < piece.end:
                line = f.readline()
                if not line:
                    return
                yield line.removesuffix(b"\n").removesuffix(b"\r").decode(errors="replace"), piece.path


class TailSource(DataSource):
    @classmethod
    def name(cls):
        return "tail"

    def schema(self):
        return "value string, src string"

    def streamReader(self, schema):
        return TailReader(self.options)


def follow(spark, *paths: str, tail: bool = False):
    """A stream of (value, src); executors must see the files under the same paths."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("paths", ",".join(paths)).option("tail", str(tail).lower()).load()


def live(aggregated, render, interval: str = "1 second", checkpoint: str | None = None):
    """Renders the whole aggregate after each micro-batch; returns the running query."""
    writer = aggregated.writeStream.outputMode("complete").foreachBatch(lambda df, _: render(df)).trigger(processingTime=interval)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
