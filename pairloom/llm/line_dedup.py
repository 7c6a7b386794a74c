"""Line dedup by a segment-partition edit join.

Equal lines are linked by their hashes.  Distinct longer lines are split into edits + 1 even segments.  If two lines are within `edits`
edits, one segment of the shorter line is a substring of the longer one, at one of few
positions that depend on both lengths.  Segments of the lines are index keys, substrings
at these positions the probes; lines under one key are a bucket, in which edit distance
is computed by a banded bit-parallel scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import grouped, slices
from .common import narrow, save, scratch, small

EDITS, MIN_CHARS = 2, 20
#: Lines of a task whose keys aren't given twice; only saves work.
_SEEN = 200_000
_MASK = (1 << 64) - 1
_BLANK = " \t\r\v\f"
_hash = xxhash.xxh3_64_intdigest


def _id(line: str) -> int:
    return _hash(line.encode("utf-8", "surrogatepass"))


def parts(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the even segments of a line; the last ones are the longer."""
    n, size = edits + 1, length // (edits + 1)
    long = length - size * n
    out, at = [], 0
    for i in range(n):
        own = size + (i >= n - long)
        out.append((at, own))
        at += own
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(other length, segment, start, size) to look up for a line of this length among
    lines of at most its length: multi-match-aware positions."""
    out = []
    for other in range(max(length - edits, edits + 1), length + 1):
        more = length - other
        for i, (at, size) in enumerate(parts(other, edits)):
            low = max(at - i, at + more - (edits - i), 0)
            high = min(at + i, at + more + (edits - i), length - size)
            out += [(other, i, start, size) for start in range(low, high + 1)]
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: equal ends are cut off and a band
    of at most 64 diagonals is scanned with one machine word a column."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    if a == b:
        return True
    low, high = 0, len(b)
    while low < high:  # the longest common prefix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(b)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not b:
        return len(a) <= edits
    if len(b) <= edits or edits > 31:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1] <= edits
    # bit 63 of the word is the lowest diagonal of the band: row column + edits
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    vp, vn, distance, mark = _MASK << (63 - edits) & _MASK, 0, edits, 1 << 62
    for j, y in enumerate(b):
        shift, equal = j + edits - 63, places.get(y, 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & _MASK
        d0 = (((equal & vp) + vp & _MASK) ^ vp) | equal | vn
        hp, hn = vn | ~(d0 | vp) & _MASK, d0 & vp
        if j < len(a) - edits:
            distance += not d0 >> 63
        else:
            distance += bool(hp & mark) - bool(hn & mark)
            mark >>= 1
        vp, vn = hn | ~(d0 >> 1 | hp) & _MASK, d0 >> 1 & hp
    return distance <= edits


def _lines_of(text: str | None, least: int) -> list[tuple[int, str]]:
    """Lines of at least `least` characters, not blank, with their numbers."""
    return [(i, x) for i, x in enumerate(text.split("\n")) if len(x) >= least and x.strip(_BLANK)] if text else []


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        at, no, ids = [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            for i, x in _lines_of(text, 1):
                at.append(row)
                no.append(i)
                ids.append(_id(x))
        at = pa.array(at, pa.int64())
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(no, pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64))], names=["doc_id", "own", "no", "line"])


def _keys(batches: Iterator[pa.RecordBatch], least: int, edits: int, index: bool) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    plans: dict[int, list[tuple[int, int, int]]] = {}
    for batch in slices(batches):
        keys, ids = [], []
        for text in batch.column(0).to_pylist():
            for _, x in _lines_of(text, least):
                own = _id(x)
                if own in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(own)
                n = len(x)
                if (plan := plans.get(n)) is None:
                    plan = [(n, i, at, size) for i, (at, size) in enumerate(parts(n, edits))] if index else probes(n, edits)
                    plan = plans[n] = [(other << 8 | i, at, size) for other, i, at, size in plan]
                keys += [_hash(x[at : at + size].encode("utf-8", "surrogatepass"), seed) for seed, at, size in plan]
                ids += [own] * len(plan)
        yield pa.record_batch([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, ids)], names=["key", "rep"])


def _texts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = {_id(x): x for text in batch.column(0).to_pylist() for _, x in _lines_of(text, least)}
        blobs = [x.encode("utf-8", "surrogatepass") for x in found.values()]
        yield pa.record_batch([pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(blobs, pa.binary())], names=["id", "blob"])


def _counts(line: str) -> np.ndarray:
    """How often each of 32 classes of characters occurs; an edit moves two counts at most."""
    return np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) & 31, minlength=32).astype(np.int32)


def _near(targets: list[bytes], edits: int) -> Callable[[bytes], list[int]]:
    lines = [t.decode("utf-8", "surrogatepass") for t in targets]
    counts = np.stack([_counts(x) for x in lines]) if len(lines) > 1 else None

    def of(query: bytes) -> list[int]:
        x = query.decode("utf-8", "surrogatepass")
        if counts is None:
            return [0] if within(x, lines[0], edits) else []
        close = np.flatnonzero(np.abs(counts - _counts(x)).sum(axis=1) <= 2 * edits)
        return [i for i in close.tolist() if within(x, lines[i], edits)]

    return of


def _cut(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, removed, kept, whole = [], [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lines = text.split("\n") if text is not None else []
            drop = set(gone or ())
            size = sum(len(lines[i]) for i in drop)
            copy = bool(drop) and size > most * sum(map(len, lines))
            whole.append(copy)
            n.append(len(lines))
            removed.append(0 if copy else len(drop))
            kept.append(text if copy or not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop))
        repeated = [len(g or ()) for g in batch.column(2).to_pylist()]
        columns = [pa.array(c, k) for c, k in zip((n, removed, repeated, whole, kept), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))]
        names = ["doc_id", "n_lines", "n_removed", "n_repeated", "mostly_repeated", "kept_text", "carried"]
        columns = [batch.column(0), *columns, *batch.columns[3:]]
        yield pa.record_batch(columns, names=names[: len(columns)])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, most: float = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed, n_repeated,
    mostly_repeated, kept_text and, if columns are to be carried along, their struct carried.

    Lines are what \\n separates.  Equal lines are linked, and so are those of at least
    min_chars characters (at least edits + 1) within `edits` edits; links are transitive.
    Blank lines (of white space) always stay.  Of each component's lines all but the first, by
    doc_id, text hash and position, are repeated, and are removed from their texts.  With most
    below 1, a document whose repeated lines hold more than that share of its characters is
    left whole, for document-level deduplication, and marked in mostly_repeated.  A null text
    stays null; equal rows share one result; a null doc_id comes first; an empty table gives no
    rows; other columns are ignored.  Distinct lines are told apart by 64-bit hashes.  No
    bucket is capped.
    """
    more = ["carried"] * bool(carry)
    docs = narrow(docs, carry, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), "text", *more)
    texts, least = docs.select("text"), max(min_chars, edits + 1)
    with scratch(docs.sparkSession) as kept:
        lines = save(docs.mapInArrow(_lines, "doc_id long, own long, no int, line long"), "lines")

        index = save(texts.mapInArrow(lambda b: _keys(b, least, edits, True), "key long, rep long").distinct(), "index")
        keys = save(index.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")), "keys")  # a table, so that the join can split a hot key
        probe = texts.mapInArrow(lambda b: _keys(b, least, edits, False), "key long, rep long")
        hits = save(probe.join(keys, "key").where("x <> y or x <> rep").select("key", "rep").distinct(), "hits")
        met = save(hits.union(index.join(save(hits.select("key").distinct(), "shared"), "key", "left_semi")).distinct(), "met")

        needed = small(save(met.select(F.col("rep").alias("id")).distinct(), "needed"))
        blobs = texts.mapInArrow(lambda b: _texts(b, least), "id long, blob binary").join(needed, "id", "left_semi")
        blobs = save(blobs.groupBy("id").agg(F.first("blob").alias("blob")), "blobs")
        groups = grouped(met, blobs, lambda targets: _near(targets, edits)).select(F.col("id").alias("line"), "component")

        place = F.struct("doc_id", "own", "no")
        named = lines.join(groups, "line", "left").select("doc_id", "own", "no", F.coalesce("component", "line").alias("part"))
        firsts = named.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("part", "first")
        gone = named.join(save(firsts, "firsts"), "part").where(~place.eqNullSafe(F.col("first")))
        gone = gone.groupBy(F.col("doc_id").alias("of"), F.col("own").alias("of_own")).agg(F.collect_set("no").alias("gone"))
        gone = save(gone, "gone")
        kept.append(gone)
    found = docs.join(small(gone), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("of_own")), "left").select("doc_id", "text", "gone", *more)
    schema = "doc_id long, n_lines long, n_removed long, n_repeated long, mostly_repeated boolean, kept_text string"
    if carry:
        schema += f", carried {docs.schema['carried'].dataType.simpleString()}"
    return found.mapInArrow(lambda b: _cut(b, most), schema)
