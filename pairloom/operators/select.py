"""Choosing the best and the second-best placement of a read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import fragment_length, proper_orientation
from .archive import TIES


def top_two(aln: DataFrame) -> DataFrame:
    """The highest score of each read and mate and the next one, 0 if there is none."""
    s = F.sort_array(F.collect_list("sw"), asc=False)
    rows = aln.groupBy("name", "mate").agg(F.slice(s, 1, 2).alias("s"))
    return rows.select("name", "mate", F.get("s", F.lit(0)).alias("top_sw"), F.coalesce(F.get("s", F.lit(1)), F.lit(0)).cast("long").alias("next_sw"))


def patched_next(chosen: Column, own_next: Column, top: Column, next_: Column) -> Column:
    """The runner-up's score of a chosen alignment: where it has the top score, the larger
    of its own and the global runner-up, else the top score."""
    return F.when(chosen == top, F.greatest(own_next, next_)).otherwise(top)


def best_by_quality(aln: DataFrame) -> DataFrame:
    """The alignment of highest quality of each read and mate, with the quality of the next."""
    w = Window.partitionBy("name", "mate").orderBy(F.col("quality").desc(), *[F.col(t) for t in TIES if t not in ("mate", "quality")])
    rows = aln.withColumn("place", F.row_number().over(w)).withColumn("next_quality", F.coalesce(F.lead("quality").over(w), F.lit(0)).cast("long"))
    return rows.where("place = 1").select("name", "mate", "ref_index", "ref_begin", "quality", "next_quality")


_FIELDS = ("ref_index", "ref_begin", "ref_end", "is_rev", "map_len", "sw", "mismatches", "quality")


def best_pairs(aln: DataFrame, expected: int, technology: str = "illumina") -> DataFrame:
    """One row a read with alignments of both mates: how the best pair was found (by pair or
    by quality), its places and fragment length, both next qualities and counts.

    The choice is an ordered fold over pairs on one reference within twice the expected
    length: proper pairs beat others; of pairs whose lengths are about as good the higher
    or later score wins; else the nearer length.  The fold isn't associative, so it runs
    over one array a read, in the JVM; reads are the unit of partitioning.  Every pair
    in range is a candidate, those that a pruned scan would skip too.
    """
    one = lambda m: F.sort_array(F.filter("alns", lambda a: a["mate"] == m))
    rows = aln.groupBy("name").agg(F.collect_list(F.struct("mate", *_FIELDS)).alias("alns")).select("name", one(1).alias("m1"), one(2).alias("m2")).where((F.size("m1") > 0) & (F.size("m2") > 0))
    proper = lambda a, b: proper_orientation(technology, a["is_rev"], a["ref_begin"], b["is_rev"], b["ref_begin"])

    def pair(a: Column, b: Column) -> Column:
        length = fragment_length(technology, a["is_rev"], a["ref_begin"], a["ref_end"], b["ref_begin"], b["ref_end"])
        return F.struct(a.alias("a"), b.alias("b"), length.alias("length"), proper(a, b).alias("proper"), F.abs(length - expected).alias("off"), (a["sw"] + b["sw"]).alias("sw"))

    pairs = F.flatten(F.transform("m1", lambda a: F.transform(F.filter("m2", lambda b: b["ref_index"] == a["ref_index"]), lambda b: pair(a, b))))
    pairs = F.filter(pairs, lambda p: p["length"].between(0, 2 * expected))
    rows = rows.select("name", "m1", "m2", pairs.alias("pairs"), proper(F.get("m1", F.lit(0)), F.get("m2", F.lit(0))).alias("seed_proper"))

    def better(new: Column, old: Column) -> Column:
        close = F.abs(new["off"] - old["off"]) < expected // 2
        return F.when(new["proper"] != old["proper"], new["proper"]).otherwise(F.when(close, new["sw"] >= old["sw"]).otherwise(new["off"] < old["off"]))

    kind = rows.schema["pairs"].dataType.elementType
    zero = F.struct(F.lit(None).cast(kind).alias("best"), F.lit(None).cast(kind).alias("second"))

    def step(s: Column, p: Column) -> Column:
        wins = F.when(s["best"].isNull(), p["proper"] | ~F.col("seed_proper")).otherwise(better(p, s["best"]))
        follows = s["best"].isNotNull() & (s["second"].isNull() | better(p, s["second"]))
        best = F.when(wins, p).otherwise(s["best"])
        second = F.when(wins, F.coalesce(s["best"], s["second"])).when(follows, p).otherwise(s["second"])
        return F.struct(best.alias("best"), second.alias("second"))

    rows = rows.withColumn("s", F.aggregate("pairs", zero, step))
    ranked = lambda m: F.reverse(F.array_sort(F.transform(m, lambda a: F.struct(a["quality"].alias("q"), a.alias("a")))))
    rows = rows.select("name", F.size("m1").cast("long").alias("n1"), F.size("m2").cast("long").alias("n2"), ranked("m1").alias("q1"), ranked("m2").alias("q2"), F.col("s.best").alias("best"), F.col("s.second").alias("second"))
    out = [F.col("name"), F.when(F.col("best").isNull(), "quality").otherwise("pair").alias("found_by")]
    for m, side in ((1, "a"), (2, "b")):
        chosen = F.coalesce(F.col("best")[side], F.get(f"q{m}", F.lit(0))["a"])
        runner = F.coalesce(F.get(f"q{m}", F.lit(1))["q"], F.lit(0))
        after = F.when(F.col("second").isNotNull(), F.when(F.col("second")[side] == F.col("best")[side], 0).otherwise(F.col("second")[side]["quality"])).otherwise(runner)
        out += [chosen["ref_index"].alias(f"ref{m}"), chosen["ref_begin"].alias(f"begin{m}"), chosen["quality"].alias(f"quality{m}"), after.cast("long").alias(f"next_quality{m}"), F.col(f"n{m}")]
    return rows.select(*out, F.col("best")["length"].alias("fragment"))
