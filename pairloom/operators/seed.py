"""Seeding: where short sequences may lie in long ones, by distinct k-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small

#: Letters of a text that are hashed at once.
_STEP = 1 << 16
_BASE = 0x9E3779B97F4A7C15


def _hashes(text: str, k: int) -> np.ndarray:
    """A hash of every k letters in a row: a polynomial of their code points, widened from one
    letter by doubling."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h, width = letters, 1
    for bit in bin(k)[3:]:
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
        if bit == "1":
            h = h[:-1] * np.uint64(_BASE) + letters[width:]
            width += 1
    return (h ^ (h >> np.uint64(32))) * np.uint64(_BASE)


def grams(text: Column, k: int, wanted: list[str] | None = None) -> Column:
    """The distinct k-character grams of a text; given wanted ones, those alone and any of equal
    hashes, so that the others need not leave their text."""
    known = None if wanted is None else np.unique(_hashes("".join(wanted), k)[::k]) if wanted else np.zeros(0, np.uint64)

    @F.arrow_udf("array<string>")
    def of(texts: pa.Array) -> pa.Array:
        if known is not None:
            bits = np.uint64(64 - min(24, max(16, len(known).bit_length() + 6)))
            marks = np.zeros(1 << (64 - int(bits)), bool)
            marks[known >> bits] = True
        out: list[list[str] | None] = []
        for raw in texts.cast(pa.large_binary()):
            raw = raw.as_py()
            t = None if raw is None else raw.decode("utf-8", "replace")
            if t is None or known is None:
                out.append(None if t is None else list(dict.fromkeys(t[i : i + k] for i in range(len(t) - k + 1))))
                continue
            found: dict[str, None] = {}
            for a in range(0, len(t) - k + 1, _STEP):
                h = _hashes(t[a : a + _STEP + k - 1], k)
                at = np.flatnonzero(marks[h >> bits])
                at = at[known[np.searchsorted(known, h[at]).clip(max=len(known) - 1)] == h[at]] if len(at) else at
                found.update((t[a + i : a + i + k], None) for i in at.tolist())
            out.append(list(found))
        return pa.array(out, pa.list_(pa.string()))

    return of(text)


def candidates(reads: DataFrame, references: DataFrame, read_id: str, ref_id: str, text: str = "text", k: int = 15, percent: int = 50) -> DataFrame:
    """Pairs that share at least `percent` of the read's distinct grams: read_id, ref_id,
    n_grams, n_shared.  Where the reads' grams are few, their hashes pick the references'
    grams within their texts, and these meet the reads' by a broadcast, before anything is
    shuffled; only matches are aggregated."""
    own = reads.select(read_id, F.explode(grams(F.col(text), k)).alias("gram"))
    sizes = own.groupBy(read_id).agg(F.count("*").alias("n_grams"))
    seeds = broadcast_if_small(own.join(sizes, read_id))
    few = [r.gram for r in own.select("gram").distinct().limit(BROADCAST_ROWS + 1).collect()]
    wanted = few if len(few) <= BROADCAST_ROWS else None
    met = references.select(ref_id, F.explode(grams(F.col(text), k, wanted)).alias("gram")).join(seeds, "gram")
    shared = met.groupBy(read_id, ref_id, "n_grams").agg(F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") * 100 >= F.col("n_grams") * percent)


def placed(reads: DataFrame, found: DataFrame, read_id: str, ref_id: str) -> DataFrame:
    """Every read with its best reference, both best scores, its number of candidates and
    its class: U unique, M multiple, X unmapped."""
    w = Window.partitionBy(read_id).orderBy(F.col("n_shared").desc(), ref_id)
    ranked = found.withColumn("place", F.row_number().over(w)).withColumn("next_shared", F.lead("n_shared").over(w)).withColumn("n", F.count("*").over(Window.partitionBy(read_id)))
    best = ranked.where("place = 1").select(read_id, F.col(ref_id).alias("best_ref"), F.col("n_shared").alias("best_shared"), F.coalesce("next_shared", F.lit(0)).cast("long").alias("next_shared"), "n")
    n = F.coalesce("n", F.lit(0)).cast("long")
    out = reads.select(read_id).join(best, read_id, "left")
    return out.select(read_id, "best_ref", "best_shared", "next_shared", n.alias("n_candidates"), F.when(n == 1, "U").when(n > 1, "M").otherwise("X").alias("class"))
