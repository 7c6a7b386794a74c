"""Token-id files: documents as Simple-8b blocks in ascending doc_id order.

A file is a Parquet file; its rows are runs of documents with the coded words, the
first word of each block, the documents' ids and lengths, and the ids before the run
in its part.  Parts are ranges of doc_id, so only one number for each part is needed
to give every document its place among all ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import folder, narrow, save, small
from .tokenize import encoder

RUN_IDS = 1 << 18
FILE = "part int, run int, before long, doc_ids array<long>, lengths array<int>, first_words array<int>, words binary"


def _runs(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    own, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
    part, run, before = TaskContext.get().partitionId(), 0, 0
    docs: list[int | None] = []
    blobs: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        words, first = simple8b.encode(np.frombuffer(b"".join(blobs), "<u4"))
        row = [part], [run], [before], [docs], [[len(b) // 4 for b in blobs]], [first], [words.tobytes()]
        kinds = pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()
        return pa.record_batch([pa.array(x, k) for x, k in zip(row, kinds)], names=["part", "run", "before", "doc_ids", "lengths", "first_words", "words"])

    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), own.encode_all(batch.column(1).to_pylist())):
            docs.append(doc)
            blobs.append(ids + end)
            held += len(blobs[-1]) // 4
            if held >= RUN_IDS:
                yield flush()
                run, before, held = run + 1, before + held, 0
                docs, blobs = [], []
    if docs:
        yield flush()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row of docs to token files under path, in ascending doc_id order,
    each document's ids followed by end_id.

    Null and empty texts are the end id alone; a null doc_id comes first; rows that
    repeat a doc_id stay apart, in an order by their texts' hashes.  An empty table
    writes no runs.  Other columns are ignored.  A run ends after RUN_IDS ids, or with the
    document that passes them, so memory follows the longest document.
    """
    docs = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    order = ["doc_id", F.xxhash64("text")]
    runs = docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _runs(b, tokenizer, end_id), FILE)
    runs.write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch], with_ids: bool, wanted: frozenset[int] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, before, docs, lengths, first, words in zip(*(batch.column(i).to_pylist() for i in range(6))):
            lengths = np.array(lengths, np.int64)
            ends = np.cumsum(lengths)
            starts, words, first = ends - lengths, np.frombuffer(words, "<u8"), np.array(first, np.int64)
            if wanted is None:
                at = np.arange(len(docs))
                ids = simple8b.decode(words).astype("<u4")
                parts = np.split(ids, ends[:-1]) if len(docs) else []
            else:  # only the blocks of the wanted documents
                at = np.flatnonzero([d in wanted for d in docs])
                parts = [simple8b.decode_range(words, first, int(starts[i]), int(lengths[i])).astype("<u4") for i in at]
            columns = [pa.array([docs[i] for i in at], pa.int64()), pa.array(base + before + starts[at]), pa.array(lengths[at])]
            columns.append(pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()))
            if with_ids:
                columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
            yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True, doc_ids: list[int] | None = None) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian 32-bit integers) and, if asked for, ids.  With
    doc_ids only these documents, of which only the runs and blocks that hold them are read."""
    runs = spark.read.schema(FILE).parquet(path)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = runs.select("part", total.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each part, that is for each file
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = small(save(sums.select("part", base.alias("base")), "parts"))
    wanted = None if doc_ids is None else frozenset(doc_ids)
    if wanted is not None:
        runs = runs.where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, sorted(wanted))).cast("array<long>")))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    placed = runs.join(sums, "part").select("base", "before", "doc_ids", "lengths", "first_words", "words")
    return placed.mapInArrow(lambda b: _documents(b, with_ids, wanted), schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """What read_tokens gives, without ids, of files written to the shared folder."""
    spark = docs.sparkSession
    path = f"{folder(spark)}/tokens"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path, with_ids=False)
