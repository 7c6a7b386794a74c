"""Exact substring dedup: bytes under any 200-byte string that occurs elsewhere.

Every window of `width` bytes has an anchor: its gram of GRAM bytes with the smallest hash,
leftmost if equal.  Equal windows have equal anchors at equal offsets, so it is enough
to compare windows that share an anchor gram.  The windows of one anchor lie side by
side and form a segment; segments travel as hashes.  An anchor gram that occurs once is
unique, and the windows of a segment that occurs twice all repeat.  Only what remains, the
segments at the edges of a repeat, travel as bytes, once each, to the others of their gram,
where their single windows are hashed and compared.

The method named for this operator, merging shard Burrows-Wheeler transforms by interleave
refinement, is in bwt_merge.py, with figures in the README on why it isn't the query's path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import slices
from .common import discard, narrow, save, small

GRAM = 64
#: Segments of a gram that one task compares; those of a gram with more meet by their windows.
SEGMENTS = 10_000
#: Windows hashed at once; longer texts are taken piece by piece.
PIECE = 1 << 22
_MASK = np.uint64((1 << 24) - 1)
_LETTERS = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(a: np.ndarray, b: np.ndarray, i: int = 0) -> np.ndarray:
    h = a * _M[i]
    h += b
    h ^= h >> np.uint64(31)
    h *= _M[i + 1]
    h ^= h >> np.uint64(29)
    return h


def _grams(raw: np.ndarray) -> np.ndarray:
    h = _LETTERS[raw]
    for s in (1, 2, 4, 8, 16, 32):
        h = _mixed(h[:-s], h[s:])
    return h


def _windows(g: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window, from those of the grams that cover it."""
    n = len(g) + GRAM - width
    h = g[:n]
    for at in [*range(GRAM, width - GRAM, GRAM), width - GRAM]:
        h = _mixed(h, g[at : at + n], 1)
    return h


def segments(raw: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor gram's hash, segment's hash) of one text."""
    out = []
    for base in range(0, max(0, len(raw) - width + 1), PIECE):
        g = _grams(raw[base : base + PIECE + width - 1])
        w = _windows(g, width)
        key = g & ~_MASK | np.arange(len(g), dtype=np.uint64)
        span, reach = width - GRAM + 1, 1
        while 2 * reach <= span:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if span > reach:
            key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
        at = (key & _MASK).astype(np.int64)
        new = np.flatnonzero(at[1:] != at[:-1])
        s, e = np.concatenate(([0], new + 1)), np.concatenate((new, [len(at) - 1]))
        a = at[s]
        seg = _mixed(_mixed(w[s], w[e], 1), ((a - s) * 4096 + (e - s)).astype(np.uint64), 2)
        out.append((s + base, e + base, g[a], seg))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _records(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        parts = [segments(_raw(text), width) for text in batch.column(1).to_pylist()]
        take = pa.array(np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts]))
        s, e, g, seg = (np.concatenate(x) for x in zip(*parts))
        yield pa.record_batch([batch.column(0).take(take), pa.array(s.astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(seg.view(np.int64))], names=["own", "s", "more", "gram", "segment"])


def _bytes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed segments."""
    for batch in slices(batches, 64):
        out: list[tuple] = []
        for own, text, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = _raw(text)
            out += [(r["gram"], own, r["s"], r["many"], raw[r["s"] : r["s"] + r["more"] + width].tobytes()) for r in rows]
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()
        yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["gram", "own", "s", "many", "blob"])


def _hashed(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which blob, position in it, hash) of every window of the blobs."""
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs])
    starts = np.cumsum(sizes) - sizes
    n = sizes - width + 1
    of = np.repeat(np.arange(len(blobs)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return of, at, _windows(_grams(raw), width)[starts[of] + at]


def _shared(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Spans (own, start, end) of windows that another segment of the same gram has, for
    segments that aren't whole repeats; rows (gram, own, s, many, blob) come sorted by gram."""

    def compared(rows: list[tuple]) -> list[tuple[int, int, int]]:
        if len(rows) < 2 or all(r[3] for r in rows):
            return []
        of, at, h = _hashed([r[4] for r in rows], width)
        _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        many = np.array([r[3] for r in rows])
        hit = np.flatnonzero((n[inverse] > 1) & ~many[of])
        if not len(hit):
            return []
        edge = np.flatnonzero((np.diff(of[hit]) != 0) | (np.diff(at[hit]) > 1))
        first, last = hit[np.concatenate(([0], edge + 1))], hit[np.concatenate((edge, [len(hit) - 1]))]
        return [(rows[of[a]][1], rows[of[a]][2] + int(at[a]), rows[of[a]][2] + int(at[b]) + width) for a, b in zip(first.tolist(), last.tolist())]

    def spans(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["own", "start", "end"])

    held: list[tuple] = []
    for batch in slices(batches, 2048):
        found = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if held and held[0][0] != row[0]:
                found += compared(held)
                held = []
            held.append(row)
        yield spans(found)
    yield spans(compared(held))


def _single(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row for each window of the segments."""
    for batch in slices(batches):
        own, s, many = (np.array(batch.column(i).to_pylist()) for i in (1, 2, 3))
        of, at, h = _hashed(batch.column(4).to_pylist(), width)
        yield pa.record_batch([pa.array(own[of], pa.int64()), pa.array(s[of] + at, pa.int32()), pa.array(many[of], pa.bool_()), pa.array(h.view(np.int64))], names=["own", "start", "many", "window"])


def _finished(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: list[list] = [[], [], [], []]
        kept_all = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = _raw(text)
            gone = np.zeros(len(raw) + 1, np.int32)
            if spans:
                np.add.at(gone, [x["start"] for x in spans], 1)
                np.add.at(gone, [x["end"] for x in spans], -1)
            gone = np.cumsum(gone)[:-1] > 0
            kept = raw[~gone].tobytes()
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
            for col, x in zip(out, (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())):
                col.append(x)
            kept_all.append(kept)
        columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string())))]
        yield pa.record_batch([*columns, pa.array(kept_all, pa.binary())][: 5 + with_text], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and,
    if asked for, kept (the remaining bytes).

    Removes each byte under a `width`-byte string (at least GRAM) that also starts anywhere
    else, in the same text or another; overlapping occurrences count, strings are judged on
    the input and do not cross texts.  Null and shorter texts keep all.  Equal rows are
    occurrences of their own and both lose all they share; null ids stay; an empty table
    gives no rows; other columns are ignored.  Strings are compared by 64-bit hashes under a
    64-bit anchor hash.  No group is capped.
    """
    docs = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("own"), "text")
    rec = save(docs.select("own", "text").mapInArrow(lambda b: _records(b, width), "own long, s int, more int, gram long, segment long"), "segments")
    grams = save(rec.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    again = save(rec.join(grams, "gram", "left_semi"), "again")
    rec = grams = discard(rec)

    classes = save(again.groupBy("gram", "segment").agg(F.min(F.struct("own", "s", "more")).alias("one"), (F.count("*") > 1).alias("many")), "classes")
    edges = classes.groupBy("gram").agg(F.count("*").alias("n"), F.bool_and("many").alias("all")).where("n > 1 and not all")
    ones = classes.join(edges, "gram").select(F.col("one.own").alias("own"), F.struct("one.s", "one.more", "gram", "many").alias("r"))
    ones = ones.groupBy("own").agg(F.collect_set("r").alias("rows"))
    held = docs.join(ones, "own").select("own", "text", "rows")
    blobs = save(held.mapInArrow(lambda b: _bytes(b, width), "gram long, own long, s int, many boolean, blob binary"), "blobs")
    hot = small(save(edges.where(F.col("n") > SEGMENTS).select("gram"), "hot"))  # one a SEGMENTS segments at most
    cold = blobs.join(hot, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram")
    part = cold.mapInArrow(lambda b: _shared(b, width), "own long, start int, end int")
    if not hot.isEmpty():
        single = save(blobs.join(hot, "gram", "left_semi").select("gram", "own", "s", "many", "blob").mapInArrow(lambda b: _single(b, width), "own long, start int, many boolean, window long"), "windows")
        found = single.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
        part = part.union(single.where("not many").join(found, "window", "left_semi").select("own", "start", F.col("start") + width))

    whole = again.join(classes.where("many").select("gram", "segment"), ["gram", "segment"], "left_semi")
    whole = whole.select("own", F.col("s").alias("start"), (F.col("s") + F.col("more") + width).alias("end"))
    spans = save(whole.union(part).groupBy("own").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    again = classes = blobs = discard(again, classes, blobs)
    rows = docs.join(spans, "own", "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.mapInArrow(lambda b: _finished(b, with_text), schema)
