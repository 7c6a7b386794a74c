"""Gold records against test records: the occurrence-wise merge join and its tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_flag, position_correct


def attach(gold: DataFrame, test: DataFrame, key: str, gold_order: list[str], test_order: list[str]) -> DataFrame:
    """The n-th gold record of a name with its n-th test record, never all with all.  Both
    sides are partitioned by the key once, for the numbering and the join."""
    numbered = lambda df, order: df.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    return numbered(gold, gold_order).join(numbered(test, test_order), [key, "occurrence"])


def _paired(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Records of a name two by two, as pair and mate: the first of a pair says by its flag
    which mate it is, and the other is the other mate."""
    spot = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    rows = df.withColumn("spot", spot).withColumn("pair", F.floor(F.col("spot") / 2))
    lead = F.first("flag").over(Window.partitionBy(key, "pair").orderBy("spot"))
    return rows.withColumn("mate", F.when((F.col("spot") % 2 == 0) == has_flag(lead, "first"), 1).otherwise(2).cast("long")).drop("spot")


def attach_pairs(gold: DataFrame, test: DataFrame, key: str, gold_order: list[str], test_order: list[str], tolerance: int = 20) -> DataFrame:
    """The n-th pair of gold records of a name with the n-th pair of test records, mate by
    mate, from (key, flag, chr, pos) and (key, flag, chr, pos, quality).  correct: the
    position is near the gold one; counted: in the tallies, where mate 2 is only if mate 1 is
    mapped; reported: both mates are mapped.  Pairs that lack a record are left out."""
    truth = _paired(gold, key, gold_order).select(key, "pair", "mate", F.col("chr").alias("true_chr"), F.col("pos").alias("true_pos"))
    rows = truth.join(_paired(test, key, test_order), [key, "pair", "mate"])
    both = Window.partitionBy(key, "pair")
    mapped = ~has_flag(F.col("flag"), "unmapped")
    rows = rows.withColumns({"mapped": mapped, "n": F.count("*").over(both), "first_mapped": F.bool_or(mapped & (F.col("mate") == 1)).over(both), "reported": F.bool_and(mapped).over(both)}).where("n = 2")
    correct = position_correct(F.col("chr"), F.col("pos"), F.col("true_chr"), F.col("true_pos"), tolerance)
    return rows.select(key, "pair", "mate", "true_chr", "true_pos", "quality", correct.alias("correct"), (F.col("mapped") & F.col("first_mapped")).alias("counted"), "reported")


def unmatched(gold: DataFrame, test: DataFrame, key: str) -> DataFrame:
    return gold.join(test, key, "left_anti")


def calibration(scored: DataFrame, quality: str, correct: str) -> DataFrame:
    """By quality: records, wrong ones, and the quality that their share of errors makes."""
    by = scored.groupBy(F.col(quality).alias("quality")).agg(F.count("*").alias("n"), F.count_if(~F.col(correct)).alias("n_wrong"))
    return by.withColumn("empirical", F.when(F.col("n_wrong") > 0, F.round(-10 * F.log10(F.col("n_wrong") / F.col("n")), 6)))
