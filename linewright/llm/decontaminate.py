"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words and cut into windows of `n` consecutive words
(a shorter item is one window). All windows are patterns of one automaton. A document's
normalised text is scanned once; each match marks its words, which map back to offsets in
the original text (`hits` gives those spans).

The automaton is built on the driver, with its size checked, and broadcast. A benchmark
whose windows come to more than `most` bytes is dealt into several automata, one pass over
the documents each; the marks of all passes are joined per document, so that the result
is the same however many there are.

Null text has no words. Null doc_id, repeated rows and items are handled like any other;
items with null item_id hit like any other and count as one item, without a name in the hash;
an empty benchmark hits nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut, slices, table

_TO = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
MOST = 16 << 20  # bytes of windows in one automaton, of which it takes some 30 times the memory at most


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO).split(b" ") if text else []


def normal(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


def windows(items, n: int) -> Iterator[tuple[str, object]]:
    """(window, as latin-1 text of its bytes between blanks, item) for each window of each item."""
    for item, text in items:
        w = normal(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            yield f" {b' '.join(w[i : i + n]).decode('latin-1')} ", item


class Scanner:
    """The automaton of some windows."""

    def __init__(self, found: dict[str, set]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for w, items in found.items():
            self.automaton.add_word(w, (w.count(" ") - 1, items))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """Number of words, which of them are hit, and the items that hit."""
        w = normal(text)
        marks, items, blanks = np.zeros(len(w) + 1, np.int64), set(), None
        if len(self.automaton) and w:
            line = f" {b' '.join(w).decode('latin-1')} "
            for end, (size, owners) in self.automaton.iter(line):
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                last = int(np.searchsorted(blanks, end))  # words before this blank
                marks[last - size] += 1
                marks[last] -= 1
                items |= owners
        return len(w), np.cumsum(marks)[: len(w)] > 0, items


def scanners(benchmark: DataFrame, n: int, most: int = MOST) -> list:
    """Broadcast automata over all windows of the benchmark; the driver holds one group of windows at a time."""
    sc, out, group, load = benchmark.sparkSession.sparkContext, [], {}, 0
    for w, item in windows(((r.item_id, r.text) for r in benchmark.select("item_id", "text").toLocalIterator()), n):
        if w not in group:
            load += len(w)
            if load > most and group:
                out.append(sc.broadcast(Scanner(group)))
                group, load = {}, len(w)
        group.setdefault(w, set()).add(item)
    return [*out, sc.broadcast(Scanner(group))]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each run of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    return list(zip(edges[::2], edges[1::2]))


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each word of the original text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.frombuffer(text.encode().translate(_TO), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    place = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters before each byte
    return place[edges[::2]], place[edges[1::2]]


FOUND = "n_words long, runs array<struct<first:int,end:int>>, items array<string>, nameless boolean"


def _found(held, keep_text: bool = True):
    def run(batches):
        for batch in slices(batches):
            out = [[], [], [], []]
            for text in batch["text"].to_pylist():
                size, hit, items = held.value(text)
                row = (size, [{"first": a, "end": b} for a, b in runs(hit)], [str(i) for i in items if i is not None], None in items)
                for c, v in zip(out, row):
                    c.append(v)
            types = (pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()), pa.bool_())
            rest = [i for i, f in enumerate(batch.schema.names) if keep_text or f != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], *[pa.array(c, t) for c, t in zip(out, types)]], [*[batch.schema.names[i] for i in rest], *[f.split()[0] for f in FOUND.split(", ")]])

    return run


def _marked(docs: DataFrame, benchmark: DataFrame, n: int, most: int, run, schema: str) -> DataFrame:
    """What `run` makes of (doc_id, text, marks). One automaton: one scan, no shuffle. Several: a scan each, marks joined by row."""
    held = scanners(benchmark, n, most)
    rows = docs.select("doc_id", "text")
    if len(held) == 1:
        return rows.mapInArrow(lambda batches: run(_found(held[0])(batches)), schema)
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))  # written once, so that numbers stay
    found = None
    for h in held:
        part = rows.select("_row", "text").mapInArrow(_found(h, False), f"_row long, {FOUND}").where(F.size("items") + F.col("nameless").cast("int") > 0).drop("n_words")
        found = part if found is None else found.union(part)
    found = found.groupBy("_row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.bool_or("nameless").alias("nameless"))
    return rows.join(found, "_row", "left").select("doc_id", "text", F.lit(None).cast("long").alias("n_words"), "runs", "items", "nameless").mapInArrow(run, schema)


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _merged(batch) -> Iterator[tuple[int, np.ndarray, list[str], bool]]:
    """(words, mask of hit words, items, whether one has no name) of each row of `_marked`."""
    for text, size, parts, items, nameless in zip(batch["text"], *(batch[c].to_pylist() for c in ("n_words", "runs", "items", "nameless"))):
        size = len(normal(text.as_py())) if size is None else size
        hit = np.zeros(size, bool)
        for p in parts or ():
            hit[p["first"] : p["end"]] = True
        yield size, hit, items or [], bool(nameless)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = MOST) -> DataFrame:
    """Per row what of it the benchmark holds, in the columns of SCHEMA."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, (size, hit, items, nameless) in zip(batch["doc_id"].to_pylist(), _merged(batch)):
                digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                out.append((doc, size, int(hit.sum()), len(items) + nameless, digest, bool(hit.any())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(),) * 4 + (pa.string(), pa.bool_()))], [c.split()[0] for c in SCHEMA.split(", ")])

    return _marked(docs, benchmark, n, most, run, SCHEMA)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = MOST) -> DataFrame:
    """(doc_id, start, end, passage, items): maximal hit passages, in characters of the original text, with the items that hit the document."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, (_, hit, items, _) in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), _merged(batch)):
                if hit.any():
                    first, end = word_offsets(text)
                    out += [(doc, a, b, text[a:b], sorted(items)) for a, b in ((int(first[i]), int(end[j - 1])) for i, j in runs(hit))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(),) * 3 + (pa.string(), pa.list_(pa.string())))], ["doc_id", "start", "end", "passage", "items"])

    return _marked(docs, benchmark, n, most, run, "doc_id long, start long, end long, passage string, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = MOST) -> DataFrame:
    """The rows without any hit, in all their columns; each automaton filters what the one before it left, in one scan and without a join."""
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    at = names.index("text")

    def filtered(held):
        def run(batches):
            for batch in slices(batches):
                keep = [not held.value(t)[1].any() for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    rows = docs.toDF(*plain)
    schema = rows.schema
    for held in scanners(benchmark, n, most):
        rows = rows.mapInArrow(filtered(held), schema)
    return rows.toDF(*names)


def op10_decontaminate(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"
SQL10 = rf"""with d as (select doc_id, {_WORDS} w from documents),
b as (select item_id, {_WORDS} w from benchmark),
bw as (select distinct item_id, len(w[i:i+9]) n, array_to_string(w[i:i+9], ' ') s
       from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i+n-1], ' ') s
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, n, s from dw where s in (select s from bw)),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by 1),
items as (select doc_id, list(distinct item_id) l from hits join bw using (s, n) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(l), 0)::bigint as n_items,
       sha256(coalesce(array_to_string(list_sort(list_transform(l, lambda x: x::varchar)), ','), '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""
QUERIES, SQL = {"op10_decontaminate": op10_decontaminate}, {"op10_decontaminate": SQL10}
