"""Sorting, filtering, merging and joining of alignment archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small

#: All columns of an alignment, so that ranks don't depend on the order of ties.
TIES = ("mate", "ref_index", "ref_begin", "map_len", "is_rev", "sw", "mismatches", "quality", "is_filtered")


def sort_by_name(aln: DataFrame) -> DataFrame:
    """A global sort by name, rows without one last."""
    return aln.orderBy(F.col("name").asc_nulls_last(), *TIES)


def sort_by_position(aln: DataFrame) -> DataFrame:
    """A global sort by position, unmapped rows last."""
    return aln.orderBy(F.col("ref_index").asc_nulls_last(), F.col("ref_begin").asc_nulls_last(), "name", *TIES)


def rank_within(aln: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The place of each row within its group, ties broken by all columns."""
    return aln.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order, *[t for t in TIES if t not in order])).cast("long"))


def keep_at_least(aln: DataFrame, marked: Column) -> DataFrame:
    """All marked alignments of each read and mate, but at least two, or all if fewer:
    unmarked ones are added back in order of position."""
    w = Window.partitionBy("name", "mate")
    order = w.orderBy(F.col("marked").desc(), "ref_index", "ref_begin", *[t for t in TIES if t not in ("ref_index", "ref_begin")])
    rows = aln.withColumn("marked", F.coalesce(marked, F.lit(False)))
    rows = rows.withColumn("least", F.greatest(F.count_if("marked").over(w), F.least(F.lit(2), F.count("*").over(w)))).withColumn("at", F.row_number().over(order))
    return rows.where("at <= least").drop("least", "at")


def offsets(dictionaries: DataFrame) -> DataFrame:
    """owner, n (its sequences), offset (those of all owners before).  The window runs over
    one row an input."""
    sizes = dictionaries.groupBy("owner").agg(F.count("*").alias("n"))
    return sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def rebase(aln: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """ref_index moved into the concatenation of all owners' dictionaries."""
    moved = aln.join(F.broadcast(offsets(dictionaries).select("owner", "offset")), "owner")  # a row an input
    return moved.withColumn("ref_index", F.col("ref_index") + F.col("offset")).drop("offset")


def concatenated(dictionaries: DataFrame, order: str) -> DataFrame:
    """All dictionaries as one, with global indices."""
    own = Window.partitionBy("owner").orderBy(order)
    placed = dictionaries.withColumn("local", F.row_number().over(own) - 1)
    return placed.join(F.broadcast(offsets(dictionaries).select("owner", "offset")), "owner").withColumn("global_index", (F.col("offset") + F.col("local")).cast("long")).drop("offset", "local")


def zip_merge(aln: DataFrame, n_mapped: Column | None = None, n_hashes: Column | None = None) -> DataFrame:
    """One row a read and mate over all inputs (column owner): input 0 gives all its
    alignments, others their best-placed one; sums of what the alignments themselves count as
    mapped places (1 each by default) and hashes, or of the filters, the two highest scores."""
    first = F.row_number().over(Window.partitionBy("name", "mate", "owner").orderBy("ref_index", "ref_begin", *[t for t in TIES if t not in ("ref_index", "ref_begin")]))
    taken = aln.withColumn("no", first).where("owner = 0 or no = 1")
    total = lambda c, default: F.sum(F.lit(default) if c is None else c).cast("long")
    scores = F.slice(F.sort_array(F.collect_list("sw"), asc=False), 1, 2)
    merged = taken.groupBy("name", "mate").agg(total(n_mapped, 1).alias("n_mapped"), total(n_hashes, 0).alias("n_hashes"), F.count_distinct("owner").alias("n_inputs"), F.bool_or("is_filtered").alias("is_filtered"), scores.alias("s"))
    return merged.select("name", "mate", "n_mapped", "n_hashes", "n_inputs", "is_filtered", F.get("s", F.lit(0)).alias("top_sw"), F.coalesce(F.get("s", F.lit(1)), F.lit(0)).cast("long").alias("next_sw"))


def unequal_inputs(aln: DataFrame, inputs: int) -> DataFrame:
    """Reads that not every input has; a merge demands that there are none."""
    return aln.groupBy("name").agg(F.count_distinct("owner").alias("n_inputs")).where(F.col("n_inputs") < inputs)


def decorate(merged: DataFrame, special: DataFrame) -> DataFrame:
    """special_code from a special archive (name, mate, code) for mates with more than one
    alignment; others and unknown ones have null."""
    codes = special.groupBy("name", "mate").agg(F.min("code").alias("special_code"))
    out = merged.join(codes, ["name", "mate"], "left")
    return out.withColumn("special_code", F.when(F.col("n_mapped") > 1, F.col("special_code")))


def with_group(records: DataFrame, groups: DataFrame, code: str = "code", label: str = "label") -> DataFrame:
    """records with the label of their group by its code; a code that no group has is an error."""
    known = groups.select(F.col(code), F.col(label).alias("found"))
    rows = records.join(broadcast_if_small(known), code, "left")
    missing = F.raise_error(F.concat(F.lit("no such group: "), F.coalesce(F.col(code).cast("string"), F.lit("null"))))
    return rows.withColumn(label, F.when(F.col("found").isNull(), missing).otherwise(F.col("found"))).drop("found")


def proper_pairs(aln: DataFrame, length: int, same_reference: bool = False) -> DataFrame:
    """Alignments of a read with a mate's within `length` on the other strand: the rows
    with `marked`.  A range join by bins of `length`: each mate-2 row goes to its bin and
    both neighbours, so each pair meets once, by an equi-join."""
    numbered = aln.withColumn("no", F.row_number().over(Window.partitionBy("name", "mate").orderBy(*TIES[1:])))
    bin_of = F.floor(F.col("ref_begin") / length).cast("long")
    one = numbered.where("mate = 1").select("name", "no", "ref_index", "ref_begin", "is_rev", bin_of.alias("bin"))
    two = numbered.where("mate = 2").select("name", F.col("no").alias("no2"), F.col("ref_index").alias("ref2"), F.col("ref_begin").alias("begin2"), F.col("is_rev").alias("rev2"), F.explode(F.sequence(bin_of - 1, bin_of + 1)).alias("bin"))
    near = (F.abs(F.col("ref_begin") - F.col("begin2")) <= length) & (F.col("is_rev") != F.col("rev2"))
    if same_reference:
        near &= F.col("ref_index") == F.col("ref2")
    met = one.join(two, ["name", "bin"]).where(near)
    hits = met.select("name", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("mate"), "no"), F.struct(F.lit(2).cast("long").alias("mate"), F.col("no2").alias("no")))).alias("x")).select("name", "x.mate", "x.no").distinct()
    return numbered.join(hits.withColumn("marked", F.lit(True)), ["name", "mate", "no"], "left").withColumn("marked", F.coalesce("marked", F.lit(False))).drop("no")


def first_greatest(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """By group the row of greatest value, of equal ones the first by order."""
    return df.groupBy(by).agg(F.max(F.struct(F.col(value).alias("value"), (-F.col(order)).alias("after"))).alias("m")).select(by, (-F.col("m.after")).alias(order), F.col("m.value").alias(value))


def buffered(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """The first rows by order that a buffer of a size takes."""
    return df.orderBy(*order).limit(size)


def rows_between(df: DataFrame, key: str, start: int, length: int) -> DataFrame:
    """`length` rows from `start` on by a dense row number; beyond the rows is an error."""
    n = df.count()
    if start < 0 or length < 0 or start + length > n:
        raise IndexError(f"rows {start} to {start + length} of {n}")
    return df.where(F.col(key).between(start, start + length - 1))


def merged_rows(a: DataFrame, b: DataFrame, features: str = "features") -> DataFrame:
    """All rows of both training sets, whose feature vectors must be of one width."""
    widths = a.select(F.size(features).alias("w")).union(b.select(F.size(features).alias("w"))).distinct().limit(2).collect()
    if len(widths) > 1:
        raise ValueError("the training sets differ in width")
    return a.unionByName(b)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The rows in a random order that a seed fixes."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)
