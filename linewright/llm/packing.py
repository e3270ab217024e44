"""Packing along a space-filling curve.

Each document's words are hashed to a few projected dimensions, the coordinates give
a Hilbert key, rows are range-sorted by it and the token stream of each
range is cut into sequences of `length` tokens. The rest of a range is cut into
sequences whose lengths are powers of two, which need no padding.

Null text: empty, its one token is the end mark. Null doc_id and repeated rows are
packed like any other row. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import partitions, slices, table, tokenizer_path
from ._words import Powers, mix, words_of

DIMS, BITS = 4, 10
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims), by the transpose method over all points at once."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


SPREAD = 20  # bits that tell apart rows of one place on the curve


def curve_keys(powers: Powers, texts: list, rows: np.ndarray) -> np.ndarray:
    """Places of texts on the curve; rows of one place are spread out by the hash of their number, so that repeated rows don't meet in one task."""
    points = np.zeros((len(texts), DIMS))
    for i, text in enumerate(texts):
        h = words_of(text.encode().lower(), powers)[2] if text else np.zeros(0, np.uint64)
        if len(h):
            for d in range(DIMS):  # one random sign per word and dimension
                points[i, d] = 2.0 * np.count_nonzero((h >> np.uint64(7 + d)) & np.uint64(1)) / len(h) - 1
    side = 1 << BITS
    cells = np.clip((np.tanh(points * 4) + 1) / 2 * side, 0, side - 1)
    return hilbert(cells, BITS) << SPREAD | (mix(rows.astype(np.uint64)) >> np.uint64(64 - SPREAD)).astype(np.int64)


def _sampled(batches):
    powers = Powers()
    for batch in batches:
        texts = batch["text"].to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(curve_keys(powers, texts, batch["row"].to_numpy())), pa.array([len(t or "") + 1 for t in texts], pa.int64())], ["place", "size"])


def _placed(bounds: np.ndarray):
    def run(batches):
        powers = Powers()
        for batch in slices(batches):
            places = curve_keys(powers, batch["text"].to_pylist(), batch["row"].to_numpy())
            part = np.searchsorted(bounds, places, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(places), pa.array(part)], ["doc_id", "text", "place", "part"])

    return run


def boundaries(rows: DataFrame, n: int, per_range: int = 100, most: int = 1_000_000) -> np.ndarray:
    """n - 1 places that cut the curve into ranges of about equal text, from a sample of some `per_range` rows a range, `most` in all.

    The sample only places the cuts; every row is packed. Its keys alone are computed twice.
    """
    total = rows.count()
    if n < 2 or not total:
        return np.zeros(0, np.int64)
    wanted = min(per_range * n, most)
    sample = rows if total <= wanted else rows.where(F.rand(11) < wanted / total)
    found = sample.mapInArrow(_sampled, "place long, size long").toArrow()
    if not len(found):
        return np.zeros(0, np.int64)
    place, size = (found[c].to_numpy() for c in ("place", "size"))
    order = np.argsort(place, kind="stable")
    ends = np.cumsum(size[order])
    return place[order][np.searchsorted(ends, ends[-1] * np.arange(1, n) / n)]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    Plain Latin text is cut at white space, then by the vocabulary's own word pattern, and
    each distinct piece goes to the tokenizer's model once; all other text goes through
    the tokenizer whole. Both caches are emptied when full.
    """

    def __init__(self, path: str, limit: int = 200_000):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall
        self.plain = re.compile(r"[\t\n\r -~À-ɏ]*").fullmatch
        self.chunks, self.pieces, self.limit = {}, {}, limit

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, word: str) -> bytes:
        found = self.pieces.get(word)
        if found is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(mapped)]
            found = self.pieces[word] = b"".join(i.to_bytes(4, "little") for i in ids)
        return found

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not self.plain(text):
            return self.whole(text)
        words, known = text.lower().split(), self.chunks
        if len(known) > self.limit:
            known.clear()
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        for w in set(words).difference(known):
            known[w] = b"".join(map(self.piece, self.split(w)))
        return b"".join(map(known.__getitem__, words))


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One vocabulary and one cache for all tasks of a worker."""
    return Encoder(path)


def packer(path: str, length: int, end_id: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 36
        done, rows, tail, filled = 0, [], [], 0  # tail: pieces of the open sequence

        def close(pieces, sequence):
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, base + sequence, at))
                at += len(ids) // 4

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], SCHEMA.replace(" long", "").split(", "))
            rows.clear()
            return out

        for batch in slices(batches):
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = (encode(text) if text else b"") + end
                total = at = len(ids) // 4
                at = 0
                while at < total:
                    take = min(length - filled, total - at)
                    tail.append((doc, at, ids[4 * at : 4 * (at + take)], total))
                    at, filled = at + take, filled + take
                    if filled == length:
                        close(tail, done)
                        done, tail, filled = done + 1, [], 0
            yield flush()
        while filled:  # powers of two
            want = room = 1 << (filled.bit_length() - 1)
            first = []
            while room:
                doc, start, ids, total = tail.pop(0)
                take = min(room, len(ids) // 4)
                first.append((doc, start, ids[: 4 * take], total))
                if take < len(ids) // 4:
                    tail.insert(0, (doc, start + take, ids[4 * take :], total))
                room -= take
            close(first, done)
            done, filled = done + 1, filled - want
        yield flush()

    return run


def ranges(docs: DataFrame, most_bytes: int) -> int:
    """Number of ranges: the session's, or as many as keep a range within `most_bytes` of input, 100,000 at most (a range of any size sorts on disk)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # Spark's guess where it knows no size
    return max(partitions(docs.sparkSession), min(100_000, -(-size // most_bytes)) if known else 1)


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, vocabulary: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """Pieces of all rows, in the columns of SCHEMA."""
    rows = docs.select("doc_id", "text")
    n = ranges(rows, most_bytes)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    placed = rows.mapInArrow(_placed(boundaries(rows, n)), "doc_id long, text string, place long, part int")
    order = placed.repartitionById(n, "part").sortWithinPartitions("place", "doc_id")
    return order.select("doc_id", "text").mapInArrow(packer(vocabulary or tokenizer_path("word_bpe_49k.json"), length, end_id), SCHEMA)


def op1_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op1_packing": op1_packing}, {}
