"""Substring dedup by sliding sentence spans.

Every run of `width` consecutive sentences is hashed to 128 bits, and so is, wherever sentences
begin and end, every window of a number of words.  What lies under any but the first occurrence
of a repeated run or window is removed.

Windows aren't hashed one by one.  Each has an anchor, its gram of GRAM words with the smallest
hash, leftmost if equal; the windows of one anchor form a segment.  Equal windows have equal
anchors at equal offsets, so a segment whose anchor gram occurs once repeats nowhere, and the
windows of a segment that repeats as a whole go as a whole.  Only where one gram has different
segments, at the edges of repeats, is each of these taken apart, once, and its windows compared.

One aggregate over the first 64 bits finds the few runs and grams that may repeat; only these
carry their places on.  A run's hash is a difference of prefix sums, so that all runs of many
texts are hashed at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, save

GRAM = 16
#: Bytes of text taken at once, unless a single text has more.
PIECE = 1 << 20
#: Words hashed at once.
BLOCK = 1 << 16
#: Odd factors of the two halves of a run's hash.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
_LETTERS = np.random.default_rng(10).integers(0, 1 << 63, 256, dtype=np.uint64)
_SPACE, _STOP = np.isin(np.arange(256), list(b" \t\r\n")), np.isin(np.arange(256), list(b".!?"))


class Words(NamedTuple):
    """The words of some texts, which spaces, tabs, carriage returns and line feeds separate."""

    raw: bytes
    start: np.ndarray  # first byte
    stop: np.ndarray  # the byte behind the last
    row: np.ndarray  # which text
    hashes: np.ndarray  # shape (words, 2)
    first: np.ndarray  # by text: its first word
    sentence: np.ndarray  # by sentence: its first word, and behind the last the number of words


def _mixed(h: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(factor)
    return h ^ h >> np.uint64(29)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By half: the first n powers of its factor and of the factor's inverse mod 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(4096, 2 * n)
        power = lambda f: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, f, np.uint64))))
        _POWERS[:] = [(power(f), power(pow(f, -1, 1 << 64))) for f in _FACTORS]
    return _POWERS


def split(texts: list[str | None]) -> Words:
    """A sentence ends with a word that ends with one of .!? or is followed by a line feed."""
    parts = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    joined = b"\n".join(parts)
    raw = np.frombuffer(joined, np.uint8)
    space = np.ones(len(raw) + 2, np.int8)
    space[1:-1] = _SPACE[raw]
    edge = np.diff(space)
    start, stop = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    begin = np.cumsum([0] + [len(x) + 1 for x in parts[:-1]])
    row = np.searchsorted(begin, start, "right") - 1
    n = len(start)
    if not n:
        return Words(joined, start, stop, row, np.empty((0, 2), np.uint64), np.zeros(len(texts), np.int64), np.zeros(1, np.int64))
    letters, size = raw[space[1:-1] == 0], stop - start
    at = np.concatenate(([0], np.cumsum(size)))
    up, sums = _powers(int(size.max()))[0][0], np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        own = _LETTERS[letters[at[a] : at[b]]] * up[np.arange(at[a], at[b]) - np.repeat(at[a:b], size[a:b])]
        sums[a:b] = np.add.reduceat(own, at[a:b] - at[a]) + size[a:b].astype(np.uint64)
    hashes = np.stack([_mixed(sums, f) for f in _FACTORS], 1)
    lines = np.flatnonzero(raw == 10)
    ends = _STOP[raw[stop[:-1] - 1]] | (np.searchsorted(lines, stop[:-1]) < np.searchsorted(lines, start[1:]))
    return Words(joined, start, stop, row, hashes, np.searchsorted(row, np.arange(len(texts))), np.concatenate(([0], np.flatnonzero(ends) + 1, [n])))


def _ranges(keys: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.empty((len(start), 2), np.uint64)
    for half, (up, down) in enumerate(_powers(len(keys) + 1)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(keys[:, half] * up[: len(keys)])))
        out[:, half] = _mixed((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64), _FACTORS[1 - half])
    return out


def run_hashes(parts: list[str], run: np.ndarray) -> np.ndarray:
    """Both halves of the hashes of runs (start << 32 | size) of words, shape (runs, 2)."""
    return _ranges(split(parts).hashes, run >> 32, run & 0xFFFFFFFF)


def sentence_runs(w: Words, width: int, min_words: int) -> tuple[np.ndarray, ...]:
    """(first word, words, hashes) of the runs of `width` sentences, or of a whole text if it has
    fewer; those of min_words (if not 0) or more words are left to the windows."""
    first, n = w.sentence[:-1], len(w.sentence) - 1
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.uint64)
    row, own = w.row[first], np.arange(n)
    left = np.searchsorted(row, row, "right") - own  # sentences from here to the text's end
    whole = (left < width) & (np.concatenate(([-1], row[:-1])) != row)
    at = np.flatnonzero((left >= width) | whole)
    size = np.minimum(left[at], width)
    words = w.sentence[at + size] - first[at]
    if min_words:
        few = words < min_words
        at, size, words = at[few], size[few], words[few]
    return first[at], words, _ranges(_ranges(w.hashes, first, np.diff(w.sentence)), at, size)


def segments(w: Words, min_words: int) -> tuple[np.ndarray, ...]:
    """(first word, words, hashes) of the segments of windows of min_words words, the first half
    of the hashes being the anchor gram's, the other the segment's."""
    gram = min(GRAM, min_words)
    windows = np.arange(max(0, len(w.row) - min_words + 1)) if min_words else np.empty(0, np.int64)
    fits = windows[w.row[windows] == w.row[windows + min_words - 1]]
    if not len(fits):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.uint64)
    grams = np.arange(len(w.row) - gram + 1)
    g = _ranges(w.hashes, grams, np.full(len(grams), gram))[:, 0]
    best, reach, span = grams, 1, min_words - gram + 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[a] <= g[b], a, b)

    while 2 * reach <= span:
        best = least(best[:-reach], best[reach:])
        reach *= 2
    if span > reach:
        best = least(best[: len(best) - (span - reach)], best[span - reach :])
    anchor = best[fits]
    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(fits) != 1))
    opens, closes = np.concatenate(([0], new + 1)), np.concatenate((new, [len(fits) - 1]))
    start, size = fits[opens], fits[closes] - fits[opens] + min_words
    keys = _ranges(w.hashes, start, size)
    keys[:, 0] = g[anchor[opens]]
    return start, size, keys


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches of few bytes of text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _spans(batches: Iterator[pa.RecordBatch], width: int, min_words: int, places: bool) -> Iterator[pa.RecordBatch]:
    """Runs and segments by doc_id, own, run, h0, h1, or by h0 alone; h0 is odd for segments."""
    for batch in _pieces(batches, 2):
        w = split(batch.column(2).to_pylist())
        found = sentence_runs(w, width, min_words), segments(w, min_words)
        start, size, keys = (np.concatenate(x) for x in zip(*found))
        keys[:, 0] = keys[:, 0] & ~np.uint64(1) | (np.arange(len(keys)) >= len(found[0][0])).astype(np.uint64)
        yield _placed(batch, w, start, size, keys) if places else pa.record_batch([_halves(keys)[0]], names=["h0"])


def _halves(keys: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64)) for i in range(2)]


def _placed(batch: pa.RecordBatch, w: Words, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    row = w.row[start]
    at = pa.array(row)
    return pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(start - w.first[row] << 32 | size), *_halves(keys)], names=["doc_id", "own", "run", "h0", "h1"])


def _windows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The windows of the listed segments, by doc_id, own, run, h0, h1."""
    for batch in _pieces(batches, 2):
        w, runs = split(batch.column(2).to_pylist()), batch.column(3).to_pylist()
        run = np.array([x for r in runs for x in r], np.int64)
        many = (run & 0xFFFFFFFF) - min_words + 1
        start = np.repeat((run >> 32) + np.repeat(w.first, [len(r) for r in runs]) - np.cumsum(many) + many, many) + np.arange(many.sum())
        size = np.full(len(start), min_words)
        yield _placed(batch, w, start, size, _ranges(w.hashes, start, size))


def _cut(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches, 1):
        texts, hits = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        w = split(texts)
        first, size = w.sentence[:-1], np.diff(w.sentence)
        edge = np.zeros(len(w.row) + 1, np.int64)
        for at, hit in zip(w.first.tolist(), hits):
            if hit:
                run = np.array(hit, np.int64)
                np.add.at(edge, at + (run >> 32), 1)
                np.add.at(edge, at + (run >> 32) + (run & 0xFFFFFFFF), -1)
        gone = np.cumsum(edge[:-1]) > 0
        cut = np.concatenate(([0], np.cumsum(gone)))[w.sentence]
        apart = (np.diff(cut) > 0) & (np.diff(cut) < size)
        if min_words:
            apart |= size > min_words
        begins = np.repeat(apart, size)
        begins[first] = True
        unit = np.flatnonzero(begins)  # the first word of every unit
        n = np.bincount(w.row[unit], minlength=len(texts))
        behind = np.cumsum(n)
        removed, kept = [], []
        for i, (text, hit) in enumerate(zip(texts, hits)):
            if not hit:
                removed.append([])
                kept.append(text)
                continue
            removed.append(np.flatnonzero(gone[unit[behind[i] - n[i] : behind[i]]]).tolist())
            a, b = w.first[i], w.first[i + 1] if i + 1 < len(texts) else len(w.row)
            own = a + np.flatnonzero(~gone[a:b])
            kept.append(b" ".join([w.raw[s:e] for s, e in zip(w.start[own].tolist(), w.stop[own].tolist())]).decode("utf-8", "surrogatepass"))
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array([len(g) for g in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.string())]
        yield pa.record_batch(columns, names=["doc_id", "n_sentences", "n_removed", "removed", "kept_text"])


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, min_words: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, n_sentences, n_removed, removed (positions
    of the removed sentences, ascending), kept_text (the other sentences, joined by a
    space where any was removed, else the text itself).

    A run is `width` consecutive sentences of one document; a document with fewer, but
    at least one, is one run as a whole.  With min_words, so many consecutive words are a
    run too, wherever sentences or lines begin and end in or around them.  A sentence of more
    than min_words words, and one of which only a part goes, counts as so many sentences of one
    word.  Words are what spaces, tabs, carriage returns and line feeds separate.
    Of equal runs the first is that of the smallest doc_id, then text hash, then position;
    runs within one document count too, also those that overlap.  Null, empty and blank
    texts have no sentences and are returned as they are.  Equal rows (same doc_id and
    text) are one document and get the same result; a null doc_id comes before all others.
    An empty table gives no rows; other columns are ignored.  No group is capped: hot runs
    only meet partial aggregates and joins that can split them.
    """
    docs = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), "text")
    rows = "doc_id long, own long, run long, h0 long, h1 long"
    firsts = docs.mapInArrow(lambda b: _spans(b, width, min_words, False), "h0 long")
    maybe = save(firsts.groupBy("h0").count().where("count > 1").select("h0"), "maybe")
    spans = docs.mapInArrow(lambda b: _spans(b, width, min_words, True), rows)
    spans = save(spans.join(maybe, "h0", "left_semi"), "spans")
    place = F.struct("doc_id", "own", "run")
    seen = spans.groupBy("h0", "h1").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    seen = save(seen.select("h0", "h1", "first", (F.col("first") != F.col("last")).alias("again")), "repeated")  # a table, so that the joins can split a hot run

    def again(of: DataFrame, firsts: DataFrame) -> DataFrame:
        return of.join(firsts, ["h0", "h1"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "own", "run")

    gone = again(spans, seen.where("again").drop("again"))
    if min_words:
        odd = seen.where("h0 & 1 = 1")
        mixed = save(odd.groupBy("h0").count().where("count > 1").select("h0"), "mixed")
        edges = odd.join(mixed, "h0", "left_semi").groupBy(F.col("first.doc_id").alias("of"), F.col("first.own").alias("of_own")).agg(F.collect_set("first.run").alias("runs"))
        edges = docs.join(edges, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("of_own"))).select("doc_id", "own", "text", "runs")
        windows = save(edges.mapInArrow(lambda b: _windows(b, min_words), rows), "windows")
        met = windows.groupBy("h0", "h1").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
        gone = gone.unionByName(again(windows, save(met.select("h0", "h1", "first"), "met")))
    hit = gone.groupBy(F.col("doc_id").alias("of"), F.col("own").alias("of_own")).agg(F.collect_set("run").alias("hit"))
    found = docs.join(hit, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("of_own")), "left").select("doc_id", "text", "hit")
    return found.mapInArrow(lambda b: _cut(b, min_words), "doc_id long, n_sentences long, n_removed long, removed array<int>, kept_text string")
