"""Suffix-array dedup by merging Burrows-Wheeler transforms of shards.

Each shard's transform is built alone.  Two are merged by refining their interleave:
starting from all of the first before all of the second, each round is one stable counting
sort by the preceding symbol, after which the interleave is right for one symbol more.  The
round in which two neighbours first part is their common prefix, so no suffix is sorted
again; runs of neighbours with common prefixes of `width` are the repeated intervals.

A merge needs `width` rounds over all its bytes, and the last one holds both halves in one
task, so this is for collections that fit one executor; substring_dedup.py gives the same
bytes for any size.  See the README for figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, save

_TABLE = "shard int, symbols binary, doc binary, at binary"


class Transform(NamedTuple):
    """In the order of the sorted rotations: the symbol before each (0 for a text's end, else
    the byte + 1), the text it belongs to and where in it it starts."""

    symbols: np.ndarray
    doc: np.ndarray
    at: np.ndarray


def build(texts: list[bytes], ids: list[int]) -> Transform:
    """The transform of a shard, by prefix doubling over each text's rotations; equal ones
    stay in the order of the texts."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    word = np.zeros(n, np.int64)
    for t, s in zip(texts, starts.tolist()):
        word[s : s + len(t)] = np.frombuffer(t, np.uint8).astype(np.int64) + 1
    own, size, start = np.repeat(np.arange(len(texts)), sizes), np.repeat(sizes, sizes), np.repeat(starts, sizes)
    at, rank, step = np.arange(n) - start, word, 1
    order = np.argsort(rank, kind="stable")
    while n and step < int(sizes.max()):
        after = rank[start + (at + step) % size]
        order = np.lexsort((after, rank))
        new = np.concatenate(([0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1:
            break
    before = word[start + (at - 1) % size]
    return Transform(before[order].astype(np.uint16), np.array(ids, np.int64)[own[order]], at[order].astype(np.int64))


def merge(a: Transform, b: Transform, width: int) -> tuple[Transform, np.ndarray]:
    """The transform of both and, for every place, the common prefix with the place before
    it, at most `width`.  A text's end is unlike any other."""
    z = np.concatenate([np.zeros(len(a.symbols), np.bool_), np.ones(len(b.symbols), np.bool_)])
    n = len(z)
    common = np.full(n, width, np.int64)
    if n:
        common[0] = 0
    block, full = np.zeros(n, np.int64), False
    for depth in range(max(width, 1)):
        symbols = np.empty(n, np.uint16)
        symbols[~z], symbols[z] = a.symbols, b.symbols
        order = np.argsort(symbols, kind="stable")  # a counting sort, for two bytes
        moved, sorted_symbols = z[order], symbols[order]
        parted = np.ones(n, np.bool_)
        parted[1:] = (np.diff(sorted_symbols) != 0) | (np.diff(block[order]) != 0) | (sorted_symbols[1:] == 0)
        fresh = parted & (common == width)
        fresh[:1] = False
        common[fresh] = depth
        full = not fresh.any() and np.array_equal(moved, z)
        z, block = moved, np.cumsum(parted)
        if full:
            break
    out = []
    for x, y in zip(a, b):
        column = np.empty(n, x.dtype)
        column[~z], column[z] = x, y
        out.append(column)
    return Transform(*out), common


def intervals(common: np.ndarray, width: int) -> list[tuple[int, int]]:
    """[first, end) of the places whose strings of `width` symbols are equal, two at least."""
    joined = np.concatenate(([False], common[1:] >= width, [False])) if len(common) else np.zeros(1, np.bool_)
    edges = np.flatnonzero(np.diff(joined.astype(np.int8)))
    return [(int(s), int(e) + 1) for s, e in zip(edges[::2], edges[1::2])]


def _row(shard: int, t: Transform) -> dict:
    return {"shard": shard, "symbols": t.symbols.tobytes(), "doc": t.doc.tobytes(), "at": t.at.tobytes()}


def _of(row) -> Transform:
    return Transform(np.frombuffer(row.symbols, np.uint16), np.frombuffer(row.doc, np.int64), np.frombuffer(row.at, np.int64))


_EMPTY = Transform(np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int64))


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, shards: int = 8) -> DataFrame:
    """doc_id, start of every `width`-byte string that also starts elsewhere, by merging the
    transforms of `shards` shards in pairs.  doc_id must tell rows apart and not be null;
    null and empty texts have no strings.  The result is whole, but the last merge is one task."""
    docs = narrow(docs, doc_id=id_col, text=text_col).where("doc_id is not null")
    placed = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "text")

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows.text]
        return pd.DataFrame([_row(int(rows["shard"].iloc[0]), build(texts, rows.doc_id.tolist()))])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_of(r) for r in rows.sort_values("shard").itertuples()]
        both = merge(parts[0], parts[1] if len(parts) > 1 else _EMPTY, width)[0]
        return pd.DataFrame([_row(int(rows["shard"].min()) // 2, both)])

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                t = _of(r)
                found, common = merge(t, _EMPTY, width)
                hit = np.concatenate([np.arange(s, e) for s, e in intervals(common, width)] or [np.empty(0, np.int64)]).astype(np.int64)
                yield pd.DataFrame({"doc_id": found.doc[hit], "start": found.at[hit]})

    table = save(placed.groupBy("shard").applyInPandas(built, _TABLE), "transforms")
    while shards > 1:
        table = save(table.groupBy(F.floor(F.col("shard") / 2)).applyInPandas(merged, _TABLE), "merged")
        shards = (shards + 1) // 2
    return table.mapInPandas(last, "doc_id long, start long")
