"""Scans: Parquet tables, tagged multi-input scans, and the alignment view of lineitem."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an alignment in long form.
ALIGNMENT = "name long, mate long, ref_index long, ref_begin long, ref_end long, map_len long, is_rev boolean, sw long, mismatches long, quality long, is_filtered boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(inputs: list[DataFrame]) -> DataFrame:
    """The rows of all inputs with the input's number as `owner`."""
    return reduce(DataFrame.unionByName, [df.withColumn("owner", F.lit(i)) for i, df in enumerate(inputs)])


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as alignments: a deterministic stand-in, one row an alignment."""
    big = lambda c: c.cast("long")
    begin, length = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")), F.floor("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        big(F.col("l_orderkey")).alias("name"),
        big(1 + F.col("l_linenumber") % 2).alias("mate"),
        big(F.col("l_suppkey") % 8).alias("ref_index"),
        big(begin).alias("ref_begin"),
        big(begin + length - 1).alias("ref_end"),
        big(length).alias("map_len"),
        (F.col("l_returnflag") == "R").alias("is_rev"),
        big(F.floor(F.col("l_extendedprice") / 100)).alias("sw"),
        big(F.floor(F.col("l_discount") * 100 + 0.5)).alias("mismatches"),
        big(F.floor(F.col("l_tax") * 100 + 0.5)).alias("quality"),
        (F.col("l_linestatus") == "F").alias("is_filtered"),
    )


def write_archive(df: DataFrame, path: str, records_per_file: int = 1_000_000) -> None:
    """An archive sink: Parquet in files of bounded size."""
    df.write.option("maxRecordsPerFile", records_per_file).option("compression", "zstd").parquet(path)


def write_split(df: DataFrame, path: str, special: str = "is_special") -> None:
    """The main and the special output in one pass, as partitions special=true/false."""
    df.withColumn("special", F.coalesce(F.col(special), F.lit(False))).write.partitionBy("special").parquet(path)
