"""Packing documents into sequences by cutting-stock column generation.

Every document gives full sequences and a rest.  The rests' length histogram (at most
capacity - 1 numbers, the only thing the driver holds) is the demand of the cutting-stock
program of cutting_stock.py.  All its patterns are used: rounded down, then once more in
the order of their fractions while pieces last.  The few rests that this leaves go by the
same knapsack, and those that no pattern takes are cut into powers of two, which fill
sequences without padding.  Patterns apply to ranks: rank r among all rests of a length
gives sequence and offset in closed form, so the assignment is distributed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, save, small
from .cutting_stock import column_generation, knapsack
from .tokenize import encoder


class Range(NamedTuple):
    """Ranks from `first` on of one length: `each` of them in a sequence, from `offset` on."""

    first: int
    each: int
    sequence: int
    offset: int


class Plan(NamedTuple):
    ranges: dict[int, list[Range]]
    #: By length: first rank that is cut into powers of two.
    cut: dict[int, int]
    #: By (bit, length): index of the first such piece among the pieces of 2^bit.
    base: dict[tuple[int, int], int]
    #: By bit: ranges over these indices.
    powers: dict[int, list[Range]]
    sequences: int


def chosen(lengths: list[int], demand: np.ndarray, capacity: int, lack: int) -> tuple[list[tuple[np.ndarray, int]], list[tuple[np.ndarray, int]]]:
    """Patterns and how often each is used: those of the linear program, rounded, and then
    those of the knapsack for what is left."""
    size, left = np.array(lengths), demand.copy()
    rounded: list[tuple[np.ndarray, int]] = []
    columns, _ = column_generation(lengths, demand, capacity, lack)
    for column, x in columns:
        if times := min([int(x + 1e-3), *(left[column > 0] // column[column > 0]).tolist()]):
            rounded.append((column, times))
            left -= times * column
    for column, x in sorted(columns, key=lambda e: -(e[1] % 1)):
        if x % 1 > 1e-3 and (column <= left).all():
            rounded.append((column, 1))
            left -= column
    rest: list[tuple[np.ndarray, int]] = []
    while (column := knapsack(size, size.astype(float), left, capacity, lack)) is not None:
        times = int((left[column > 0] // column[column > 0]).min())
        rest.append((column, times))
        left -= times * column
    return rounded, rest


def make_plan(histogram: dict[int, int], capacity: int = 1024, lack: int = 8) -> Plan:
    """The assignment by ranks for rests of 1 to capacity - 1 tokens."""
    lengths = sorted((n for n in histogram if histogram[n] > 0), reverse=True)
    left = np.array([histogram[n] for n in lengths], np.int64)
    used = [x for part in chosen(lengths, left, capacity, lack) for x in part] if lengths else []
    for column, times in used:
        left -= times * column
    ranges: dict[int, list[Range]] = {n: [] for n in lengths}
    at, sequence = dict.fromkeys(lengths, 0), 0
    for column, times in used:
        offset = 0
        for i in np.flatnonzero(column):
            n, each = lengths[i], int(column[i])
            ranges[n].append(Range(at[n], each, sequence, offset))
            at[n] += each * times
            offset += each * n
        sequence += times
    base, powers = {}, {}
    for bit in range(capacity.bit_length() - 1):
        total = 0
        for i, n in enumerate(lengths):
            if n >> bit & 1 and left[i]:
                base[bit, n] = total
                total += int(left[i])
        each, powers[bit], first = capacity >> bit, [], 0
        while first < total:  # full sequences, then one for each binary digit of what is left
            if full := (total - first) // each:
                powers[bit].append(Range(first, each, sequence, 0))
                first += full * each
                sequence += full
            each //= 2
    return Plan(ranges, at, base, powers, sequence)


def _place(ranges: list[Range], rank: int, length: int) -> tuple[int, int]:
    r = ranges[bisect_right(ranges, rank, key=lambda r: r.first) - 1]
    k = rank - r.first
    return r.sequence + k // r.each, r.offset + k % r.each * length


def _pieces(rest: int) -> list[int]:
    """Descending powers of two that sum to rest."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    own, end, part = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
    ranks, fulls = [0] * capacity, 0
    for batch in batches:
        rows = []
        for doc, ids in zip(batch.column(0).to_pylist(), own.encode_all(batch.column(1).to_pylist())):
            ids += end
            n = len(ids) // 4
            full, rest = divmod(n, capacity)
            view, at = memoryview(ids), full * capacity
            crcs = [zlib.crc32(view[4 * i * capacity : 4 * (i + 1) * capacity]) for i in range(full)]
            small = []
            for p in _pieces(rest):
                small.append(zlib.crc32(view[4 * at : 4 * (at + p)]))
                at += p
            rows.append((part, doc, n, fulls, crcs, rest, ranks[rest], zlib.crc32(view[4 * full * capacity :]), small))
            ranks[rest] += 1
            fulls += full
        kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())
        columns = zip(*rows) if rows else [()] * 9
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["part", "doc_id", "doc_tokens", "fulls", "full_crcs", "rest", "rank", "rest_crc", "small_crcs"])


def _assigned(batches: Iterator[pa.RecordBatch], plan: Plan, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, n, sequence, crcs, rest, rank, rest_crc, small in zip(*(batch.column(i).to_pylist() for i in range(8))):
            for i, crc in enumerate(crcs):
                out.append((doc, i * capacity, capacity, crc, n, plan.sequences + sequence + i, 0))
            at = n - rest
            if rest and rank < plan.cut[rest]:
                out.append((doc, at, rest, rest_crc, n, *_place(plan.ranges[rest], rank, rest)))
            elif rest:
                for p, crc in zip(_pieces(rest), small):
                    bit = p.bit_length() - 1
                    out.append((doc, at, p, crc, n, *_place(plan.powers[bit], plan.base[bit, rest] + rank - plan.cut[rest], p)))
                    at += p
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        yield pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [()] * 7)], names=names)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, lack: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs is a document: its ids and end_id; a null or empty text is the end
    id alone.  capacity is a power of two.  Each id lies in one piece, no sequence passes
    the capacity, and each is full or of a power of two, so nothing is padded.  Rows that
    repeat a doc_id are documents of their own; null ids stay null; an empty table gives
    no rows; other columns are ignored.  A document is tokenized once.
    """
    docs = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "part int, doc_id long, doc_tokens long, fulls long, full_crcs array<long>, rest int, rank long, rest_crc long, small_crcs array<long>"
    cut = save(docs.mapInArrow(lambda b: _cut(b, tokenizer, end_id, capacity), schema), "cut")
    counts = save(cut.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.size("full_crcs")).alias("full")), "counts")
    histogram = {r.rest: r.n for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(histogram, capacity, lack)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "rest", F.coalesce(F.sum("n").over(before.partitionBy("rest")), F.lit(0)).alias("ranked"))
    # one row for each part, that is for each task that cut documents
    full = counts.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("placed"))
    placed = cut.join(small(save(ranks, "ranks")), ["part", "rest"]).join(small(save(full, "fulls")), "part")
    placed = placed.select("doc_id", "doc_tokens", F.col("placed") + F.col("fulls"), "full_crcs", "rest", F.col("ranked") + F.col("rank"), "rest_crc", "small_crcs")
    return placed.mapInArrow(lambda b: _assigned(b, plan, capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
