"""Repeated passages by a sparse suffix array.

A suffix is kept where its `SEED` words have the least hash of the `RUN` seeds of some
window of SEED + RUN - 1 = 50 words (a content-selected minimiser). Each window has one
such place, its anchor, at the same offset in every copy of the window. Suffixes whose
seed occurs once can't be part of a repeat and go; the others carry the text of their
windows: up to 50 words from the anchor on and up to 24 before it. They are dealt by seed,
sorted by text, and neighbours compared for their common length; matches are then
extended to the left, word by word. Windows of one anchor are equal where both lengths
suffice, so equality rests on the words themselves (words over 40 bytes: a 128-bit digest).

A seed with more than `most` suffixes would be too much for one task. Its windows are
counted one by one under 128-bit digests with partial aggregates and joins that Spark can
split, so no window's copies meet in one task and no pairs of copies are made.

A window found in two documents, or twice in one, is repeated. The occurrence in the
smallest doc_id (there, the first) is kept and the others are removable; `kept` spans are
reported where another document shares them. Adjoining windows form spans.

Null doc_id or null text: the row takes no part and passes unchanged. Rows that repeat a
doc_id and its text are copies: one counts as the document, for the others a removable span
over all words is listed. Different texts of one doc_id have spans each; a window in two of
them counts as twice in one document. Texts under 50 words have no window. An empty table
gives no rows. Extra columns, of any name, pass through `remove_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import partitions, slices, table
from ._words import Powers, mix, prefix, sliding, window_hashes, words_of

LENGTH, SEED, RUN = 50, 26, 25
MOST = 1 << 16  # suffixes of one seed that one task compares: some 25 MB of text
CHUNK = 16_384  # suffixes compared at once


def anchors(h: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, seed hash, first and last window start) of each anchor of a text of hashed words."""
    none = np.zeros(0, np.int64)
    if len(h) < LENGTH:
        return none, none, none, none
    keys = window_hashes(prefix(h, powers), np.arange(len(h) - SEED + 1), SEED, powers)
    order = np.argsort(keys, kind="stable")  # ties go to the left, so that the windows of an anchor adjoin
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    at = order[sliding(rank, RUN, np.minimum)]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], keys[at[first]].view(np.int64), first, np.append(first[1:], len(at)) - 1


def _marker(doc: int, text_hash: int) -> int:
    """The seed of a whole row, by which repeated rows are found."""
    return int.from_bytes(hashlib.blake2b(f"{doc} {text_hash}".encode(), digest_size=8).digest(), "little", signed=True)


def _suffixes(batches):
    powers = Powers()
    for batch in slices(batches):
        out = [[], [], [], []]
        for doc, th, text in zip(batch["doc_id"].to_pylist(), batch["th"].to_pylist(), batch["text"].to_pylist()):
            h = words_of(text.encode().lower(), powers)[2]
            at, seeds, _, _ = anchors(h, powers)
            if len(at):
                for c, v in zip(out, (np.append(seeds, _marker(doc, th)), np.full(len(at) + 1, doc), np.full(len(at) + 1, th), np.append(at, ~len(h)).astype(np.int32))):
                    c.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["h", "doc_id", "th", "at"])


def _short(word: bytes) -> bytes:
    return word if len(word) <= 40 else b"\0" + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def _suffix_texts(batches, name):
    """The surviving suffixes with the words of their windows, from the anchor to the right and to the left; `name` holds the text."""
    powers = Powers()
    for batch in slices(batches):
        out = [[], [], [], [], [], []]
        for doc, th, text, seeds in zip(batch["_doc"].to_pylist(), batch["_th"].to_pylist(), batch[name].to_pylist(), batch["_seeds"].to_pylist()):
            raw = text.encode().lower()
            starts, ends, h = words_of(raw, powers)
            whole = [s for s in seeds if s < 0]
            seeds = set(seeds)
            found = [(p, k, a, b) for p, k, a, b in zip(*(x.tolist() for x in anchors(h, powers))) if p in seeds]
            words = [_short(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())] if found else []
            rows = [(k, b" ".join(words[p : b + LENGTH]) + b" ", b" ".join(words[a:p][::-1]), doc, th, p) for p, k, a, b in found]
            rows += [(_marker(doc, th), b"", b"", doc, th, s) for s in whole]
            for row in rows:
                for c, v in zip(out, row):
                    c.append(v)
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["h", "suffix", "before", "doc_id", "th", "at"])


def _matrix(texts: list[bytes], width: int, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of each text, -1 beyond its end, and how many it has."""
    out, size = np.full((len(texts), width), -1, np.int32), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        ids = [known.setdefault(w, len(known)) for w in t.split()]
        out[i, : len(ids)] = ids
        size[i] = len(ids)
    return out, size


def compare(h, suffix: list[bytes], before: list[bytes], doc, th, at) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes sorted by (h, text), two masks each: bit l tells that the window l words before the anchor is kept, or removable."""
    n = len(h)
    kept, removable = np.zeros(n, np.int32), np.zeros(n, np.int32)
    order = np.lexsort((th, at, doc))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # suffixes alike in all their words are a class; its first member stands for it
    ids: dict[tuple, int] = {}
    member = np.fromiter((ids.setdefault(x, len(ids)) for x in zip(suffix, before)), np.int64, n)
    by = np.lexsort((place, member))
    first = by[np.flatnonzero(np.diff(member[by], prepend=-1))]
    top = np.zeros(len(ids), np.int64)
    np.maximum.at(top, member, place)
    top = doc[order[top]]  # the largest doc of each class
    known: dict[bytes, int] = {}
    right, nright = _matrix([suffix[i] for i in first], LENGTH, known)
    left, nleft = _matrix([before[i] for i in first], RUN - 1, known)
    has = np.array([sum(1 << l for l in range(max(0, LENGTH - r), k + 1)) for r, k in zip(nright.tolist(), nleft.tolist())], np.int32)
    again = np.ones(n, bool)
    again[first] = False
    removable[again] = has[member[again]]
    # common words of sorted neighbours; a class keeps the place of its texts in that order
    g = h[first]
    equal = (right[1:] == right[:-1]) & (right[1:] >= 0)
    common = np.where(equal.all(axis=1), LENGTH, equal.argmin(axis=1))
    common = np.concatenate(([0], np.where(g[1:] == g[:-1], common, 0)))
    alike = np.cumsum(np.concatenate(([0], g[1:] != g[:-1])))  # the same seed and the same l words before it
    m = len(first)
    for l in range(RUN):
        if l:
            alike = np.unique(alike * (len(known) + 1) + left[:, l - 1] + 1, return_inverse=True)[1]
        rows = np.flatnonzero((nleft >= l) & (nright >= LENGTH - l))
        if not len(rows):
            continue
        group = (np.cumsum(common < LENGTH - l) * m + alike)[rows]
        by = np.argsort(group * n + place[first[rows]])
        rows, group = rows[by], group[by]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        later = np.ones(len(rows), bool)
        later[head] = False
        removable[first[rows[later]]] |= np.int32(1 << l)
        shared = doc[first[rows[head]]] != np.maximum.reduceat(top[rows], head)
        kept[first[rows[head[shared]]]] |= np.int32(1 << l)
    return kept, removable


def _compared(batches):
    """Sorted suffixes to their masks, some seeds at a time."""

    def done(rows):
        columns = [np.concatenate([r[i] for r in rows]) for i in (0, 3, 4, 5)]
        texts = [[t for r in rows for t in r[i]] for i in (1, 2)]
        h, doc, th, at = columns
        # a repeated row has each suffix again: once will do
        once = np.ones(len(h), bool)
        order = np.lexsort((th, at, doc))
        once[order[1:]] = (doc[order[1:]] != doc[order[:-1]]) | (at[order[1:]] != at[order[:-1]]) | (th[order[1:]] != th[order[:-1]])
        keep = np.flatnonzero(once)
        h, doc, th, at = (c[keep] for c in (h, doc, th, at))
        kept, removable = compare(h, [texts[0][i] for i in keep], [texts[1][i] for i in keep], doc, th, at)
        some = (kept != 0) | (removable != 0) | (at < 0)
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (doc, th, at, kept, removable)], ["doc_id", "th", "at", "kept", "removable"])

    rows, size = [], 0
    for batch in batches:
        h = batch["h"].to_numpy()
        part = [h, batch["suffix"].to_pylist(), batch["before"].to_pylist(), batch["doc_id"].to_numpy(), batch["th"].to_numpy(), batch["at"].to_numpy()]
        cuts = np.flatnonzero(np.diff(h)) + 1
        if rows and len(h) and rows[-1][0][-1] != h[0]:
            cuts = np.concatenate(([0], cuts))
        start = 0
        for c in cuts.tolist():
            if size + c - start >= CHUNK:
                if c > start:
                    rows.append([x[start:c] for x in part])
                yield done(rows)
                rows, size, start = [], 0, c
        if start < len(h):
            rows.append([x[start:] for x in part])
            size += len(h) - start
    if rows:
        yield done(rows)


def _windows(batches, name):
    """The windows of anchors whose seed has too many suffixes, under two digests; `name` holds the text."""
    powers = Powers()
    for batch in slices(batches):
        out = [[], [], [], [], []]
        for doc, th, text, frequent in zip(batch["_doc"].to_pylist(), batch["_th"].to_pylist(), batch[name].to_pylist(), batch["_frequent"]):
            h = words_of(text.encode().lower(), powers)[2]
            at, _, first, last = anchors(h, powers)
            mine = np.isin(at, frequent.values.to_numpy(zero_copy_only=False))
            first, size = first[mine], (last - first + 1)[mine]
            starts = np.repeat(first + size - np.cumsum(size), size) + np.arange(size.sum())
            digests = [window_hashes(prefix(x, powers), starts, LENGTH, powers).view(np.int64) for x in (h, mix(h ^ np.uint64(0x5851F42D4C957F2D)))]
            for c, v in zip(out, (*digests, np.full(len(starts), doc), np.full(len(starts), th), starts.astype(np.int32))):
                c.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["w", "v", "doc_id", "th", "at"])


def _spans(batches):
    for batch in slices(batches):
        out = [[], [], [], [], []]
        for doc, th, found in zip(batch["doc_id"].to_pylist(), batch["th"].to_pylist(), batch["found"]):
            at, kept, removable = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in found.values.flatten())
            whole = at[at < 0]
            for flag, masks in ((True, kept), (False, removable)):
                starts = [at[(masks >> l & 1 == 1) & (at >= 0)] - l for l in range(RUN)]
                if len(whole) and not flag:
                    starts.append(np.arange(~whole[0] - LENGTH + 1))
                p = np.unique(np.concatenate(starts))
                if not len(p):
                    continue
                breaks = np.flatnonzero(np.diff(p) > LENGTH) + 1
                first, final = p[np.concatenate(([0], breaks))], p[np.concatenate((breaks - 1, [len(p) - 1]))]
                for c, v in zip(out, (np.full(len(first), doc), np.full(len(first), th), first, final - first + LENGTH, np.full(len(first), flag))):
                    c.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["doc_id", "th", "start_word", "n_words", "kept"])


def _spans_of(rows: DataFrame, name: str, most: int, whole: bool) -> DataFrame:
    """Spans of rows that hold `_doc`, `_th` and, under `name`, a text, none of them null. All columns travel, so that a later join on
    (_doc, _th) finds the same exchange. `whole`: copies of a row count as repeats of all its words."""
    texts = rows.select(F.col("_doc").alias("doc_id"), F.col("_th").alias("th"), F.col(name).alias("text"))
    suffixes = texts.mapInArrow(_suffixes, "h long, doc_id long, th long, at int")
    if not whole:
        suffixes = suffixes.where("at >= 0")
    # joining on the complement gives the counts an exchange of their own, so that a hot key's rows can be split
    shared = suffixes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.bitwise_not("h").alias("g"), (F.col("n") > most).alias("much"))
    hit = suffixes.join(shared, F.bitwise_not("h") == F.col("g")).withColumn("much", F.col("much") & (F.col("at") >= 0))
    seeds = hit.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_h")).agg(
        F.collect_set(F.when(~F.col("much"), F.col("at"))).alias("_seeds"), F.collect_set(F.when(F.col("much"), F.col("at"))).alias("_frequent"))
    carried = rows.join(seeds, (F.col("_doc") == F.col("_d")) & (F.col("_th") == F.col("_h")))
    pieces = carried.where(F.size("_seeds") > 0).mapInArrow(lambda b: _suffix_texts(b, name), "h long, suffix binary, before binary, doc_id long, th long, at int")
    windows = carried.where(F.size("_frequent") > 0).mapInArrow(lambda b: _windows(b, name), "w long, v long, doc_id long, th long, at int")
    n = partitions(texts.sparkSession)
    marks = pieces.repartition(n, "h").sortWithinPartitions("h", "suffix").mapInArrow(_compared, "doc_id long, th long, at int, kept int, removable int")
    one = F.struct("doc_id", "at", "th")
    found = windows.groupBy("w", "v").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low < high")
    found = found.select(F.bitwise_not("w").alias("_w"), F.bitwise_not("v").alias("_v"), "low", F.col("high.doc_id").alias("last"))
    first = F.col("low") == one
    counted = windows.join(found, (F.bitwise_not("w") == F.col("_w")) & (F.bitwise_not("v") == F.col("_v"))).select(
        "doc_id", "th", "at", (first & (F.col("low.doc_id") < F.col("last"))).cast("int").alias("kept"), (~first).cast("int").alias("removable"))
    every = marks.union(counted).groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "kept", "removable")).alias("found"))
    return every.mapInArrow(_spans, "doc_id long, th long, start_word long, n_words long, kept boolean")


def repeated_spans(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, start_word, n_words, kept): maximal runs of repeated windows, in words of the text."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_th"), "text")
    return _spans_of(rows, "text", most, True).drop("th")


def cut_words(text: str, spans) -> str:
    """The text without the words of the spans (start, count) and the white space after them."""
    raw = text.encode()
    starts, ends, _ = words_of(raw.lower(), Powers())
    if not len(starts):
        return text
    keep = np.ones(len(raw), bool)
    for first, n in spans:
        last = min(first + n, len(starts))
        if first < last:
            keep[starts[first] : starts[last] if last < len(starts) else len(raw)] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode()


def remove_repeats(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs without their removable spans; a text of which nothing is left goes.

    Rows that repeat a doc_id and its text are cut alike and stay (near-duplicate removal drops such copies).
    n_chars, where present, follows the text. Texts are shuffled once: both joins have the same exchange.
    """
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    doc, text = plain[names.index("doc_id")], plain[at]
    every = docs.toDF(*plain)
    rows = every.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).withColumns({"_doc": F.col(doc).cast("long"), "_th": F.xxhash64(text)})
    spans = _spans_of(rows, text, most, False).where("not kept").groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_h")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("_spans"))
    joined = rows.join(spans, (F.col("_doc") == F.col("_d")) & (F.col("_th") == F.col("_h")), "left").select(*plain, "_spans")

    def run(batches):
        for batch in slices(batches):
            spans, columns = batch.column(len(names)).to_pylist(), list(batch.columns[: len(names)])
            texts = columns[at].to_pylist()
            new = [cut_words(t, [(s["start_word"], s["n_words"]) for s in x]) if x and t else t for t, x in zip(texts, spans)]
            columns[at] = pa.array(new, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([len(t) if x and t is not None else c for t, x, c in zip(new, spans, columns[chars].to_pylist())], columns[chars].type)
            keep = pa.array([not x or bool(t and t.strip()) for t, x in zip(new, spans)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, plain).filter(keep)

    others = every.where(F.col(doc).isNull() | F.col(text).isNull())
    return joined.mapInArrow(run, every.schema).union(others).toDF(*names)


def op2_suffixdedup(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op2_suffixdedup": op2_suffixdedup}
SQL = {"op2_suffixdedup": r"""with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') w from documents where text is not null and doc_id is not null),
x as (select doc_id, i - 1 as pos, hash(array_to_string(w[i:i+49], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)),
y as (select doc_id, pos, min(doc_id) over (partition by h) low, max(doc_id) over (partition by h) high, row_number() over (partition by h, doc_id order by pos) > 1 again from x),
z as (select doc_id, pos, not again and doc_id = low as kept from y where again or low < high),
s as (select *, case when pos - lag(pos) over (partition by doc_id, kept order by pos) <= 50 then 0 else 1 end b from z),
g as (select *, sum(b) over (partition by doc_id, kept order by pos) k from s)
select doc_id, min(pos)::bigint as start_word, (max(pos) - min(pos) + 50)::bigint as n_words, kept from g group by doc_id, kept, k"""}
