"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles (powers of two).  An item keeps
a bottom-k MinHash sketch, k being one more than the largest number of shingles
that an item of its partition may miss at the threshold: a document that contains
enough of the item then holds at least one sketch shingle, whatever the document's
own size, so candidates lose nothing.  Candidates are verified by counting all of
the item's shingles in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, save, small
from .shingles import ngram_hashes, shingle_set, word_hashes, words

#: Bits of the prefilter's tables; a benchmark of any size fills the same tables.
TABLE_BITS = 22


def sketch_size(n: int, percent: int) -> int:
    """Minima that an item of n shingles keeps: enough for its whole partition."""
    if n <= 0:
        return 0
    upper = (1 << n.bit_length()) - 1
    return min(n, upper * (100 - percent) // 100 + 1)


def _item_shingles(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"item_id": [], "k": [], "n_item": [], "hash": [], "sketched": []}
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = shingle_set(text, k)
            low = sketch_size(len(s), percent)
            for name, value in zip(out, ([item] * len(s), [min(k, len(words(text)))] * len(s), [len(s)] * len(s), s.view(np.int64).tolist(), [i < low for i in range(len(s))])):
                out[name] += value
        yield pa.record_batch([pa.array(out["item_id"], pa.int64()), pa.array(out["k"], pa.int32()), pa.array(out["n_item"], pa.int64()), pa.array(out["hash"], pa.int64()), pa.array(out["sketched"], pa.bool_())], names=list(out))


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _table(shingles: DataFrame) -> np.ndarray:
    """A table of 2^TABLE_BITS flags; it reaches the driver as one bitmap a 32,768 of them."""
    slot = F.shiftrightunsigned("hash", 64 - TABLE_BITS) + 1  # bitmaps count from 1
    maps = shingles.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    table = np.zeros(1 << TABLE_BITS, np.bool_)
    for r in maps.collect():
        bits = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little").view(np.bool_)
        table[(r.bucket - 1) * len(bits) : r.bucket * len(bits)] = bits
    return table


def _hits(batches: Iterator[pa.RecordBatch], lengths: list[int], sketch: bytes, full: bytes) -> Iterator[pa.RecordBatch]:
    sketched, known = (np.unpackbits(np.frombuffer(x, np.uint8)).view(np.bool_) for x in (sketch, full))
    for batch in batches:
        docs, found = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = word_hashes(words(text))
            h = np.concatenate([ngram_hashes(own, k) for k in lengths])
            at = _slots(h)
            if sketched[at].any():
                h = np.unique(h[known[at]]).view(np.int64)
                docs += [doc] * len(h)
                found.append(h)
        yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], names=["doc_id", "hash"])


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document and item with at least percent of the item's
    distinct k-word shingles in the document: doc_id, item_id, n_item, n_shared.

    Words are runs other than space and 0x09-0x0D, A-Z lower-cased.  An item of
    fewer than k words has one shingle, its whole sequence, looked up in documents
    as a run of so many words; an item without words is in no document.  Null and
    empty texts hold nothing.  Rows that repeat a doc_id are one document, and rows
    that repeat an item_id one item with the texts' shingles together; null ids
    behave as ids.  Empty tables give no rows; other columns are ignored.
    """
    items = narrow(items, item_id=item_col, text=text_col)
    shingles = save(items.select(F.col("item_id").cast("long"), "text").mapInArrow(lambda b: _item_shingles(b, k, percent), "item_id long, k int, n_item long, hash long, sketched boolean"), "items")
    lengths = sorted(r.k for r in shingles.select("k").distinct().collect())
    own = shingles.groupBy("item_id", "hash").agg(F.max("sketched").alias("sketched"))
    sizes = own.groupBy(F.col("item_id").alias("of")).agg(F.count("*").alias("n_item"))
    docs = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    if not lengths:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared")).limit(0)
    sketch, full = (np.packbits(_table(x)).tobytes() for x in (shingles.where("sketched"), shingles))
    hits = docs.mapInArrow(lambda b: _hits(b, lengths, sketch, full), "doc_id long, hash long").distinct()
    known = small(save(own.join(sizes, F.col("item_id").eqNullSafe(F.col("of"))).select("item_id", "hash", "n_item"), "known"))
    shared = hits.join(known, "hash").groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
