"""MinHash near-dedup with min-max hashing.

Every permutation gives two signature values, the minimum and the maximum, so
128 values cost 64 hash evaluations a shingle.  Each band joins both values of two
permutations.  Documents of one shingle set are one class; classes that share a
band are compared on their full sets, as buckets.py describes.  Texts are read twice: for
the signatures, and for the sets of classes that share a band.
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
from .shingles import shingle_set

PERMUTATIONS, BANDS = 64, 32


def _constants(n: int, seed: int = 20_011) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def minmax(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The minima and maxima of a set under each permutation, shape (permutations, 2)."""
    a, b = _constants(permutations)
    out = np.empty((permutations, 2), np.uint64)
    out[:, 0] = np.iinfo(np.uint64).max
    out[:, 1] = 0
    for at in range(0, len(shingles), 4096):
        h = np.multiply.outer(a, shingles[at : at + 4096])
        h += b[:, None]
        np.minimum(out[:, 0], h.min(axis=1), out=out[:, 0])
        np.maximum(out[:, 1], h.max(axis=1), out=out[:, 1])
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows.shape[1]):
        key = (key ^ rows[:, i]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, lo, hi, bands = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, k)
            n.append(len(s))
            if len(s):
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                lo.append(int(digest[0]))
                hi.append(int(digest[1]))
                bands.append(band_keys(minmax(s)))
            else:
                lo.append(None)
                hi.append(None)
                bands.append(None)
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "lo", "hi", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.record_batch([batch.column(0), pa.array([shingle_set(x, k).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "blob"])


def _alike(targets: list[bytes], percent: int) -> Callable[[bytes], list[int]]:
    """Positions of the target sets that are alike enough, by one index over all of them."""
    sizes = np.array([len(t) // 8 for t in targets])
    values = np.frombuffer(b"".join(targets), np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(targets)), sizes)[order]

    def of(query: bytes) -> list[int]:
        mine = np.frombuffer(query, np.uint64)
        lo, hi = np.searchsorted(values, mine), np.searchsorted(values, mine, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(targets))
        return np.flatnonzero(100 * both >= percent * (len(mine) + sizes - both)).tolist()

    return of


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Links documents whose sets of k-word shingles have a Jaccard similarity of at
    least percent / 100; component_id is the smallest doc_id reachable, kept marks
    that document.  Words are runs other than space and 0x09-0x0D, A-Z lower-cased.
    A text with fewer than k words has its whole sequence as one shingle; a null,
    empty or blank text has none, is linked with nothing and kept.  Rows that repeat
    a doc_id are one node, linked if any of their texts is, and all get the same
    component.  A null doc_id has a null component and is kept.  An empty table
    gives no rows.  Other columns are ignored.

    A pair of similarity 0.8 is in no common band with a chance of about 5e-8;
    beyond that nothing is lost, and no bucket or group is capped.
    """
    docs = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    with scratch(docs.sparkSession) as kept:
        sig = save(docs.mapInArrow(lambda b: _signed(b, k), "doc_id long, n_shingles long, lo long, hi long, bands array<long>"), "signatures")
        usable = sig.where("doc_id is not null and lo is not null")
        reps = save(usable.groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
        members = usable.select("doc_id", "lo", "hi").join(reps.where("n > 1").select("lo", "hi", "rep"), ["lo", "hi"])
        copies = save(members.where("doc_id <> rep").distinct(), "copies")
        same = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

        # a doc_id can be a copy by one of its texts and stand for a class by another
        own = usable.join(small(copies.select("doc_id", "lo", "hi")), ["doc_id", "lo", "hi"], "left_anti")
        banded = own.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
        buckets = banded.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("key")
        met = save(banded.join(save(buckets, "buckets"), "key"), "met")
        ids = small(save(met.select(F.col("rep").alias("id")).distinct(), "ids"))
        sets = save(docs.join(ids, docs.doc_id == ids.id, "left_semi").select("doc_id", "text").mapInArrow(lambda b: _sets(b, k), "id long, blob binary"), "sets")
        found = grouped(met, sets, lambda targets: _alike(targets, percent), known=same)
        kept += [sig, found]
    out = sig.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))
