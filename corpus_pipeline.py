"""From raw documents to packed sequences: quality rules, line dedup, near-duplicate
dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last
return the columns of documents.  Columns that docs has besides these are dropped,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import discard, documents, folder, save, scratch, small
from pairloom.llm.decontaminate import contained_items
from pairloom.llm.line_dedup import deduplicated
from pairloom.llm.minmax_dedup import near_groups
from pairloom.llm.packing import pack
from pairloom.llm.quality import judged
from pairloom.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_NOT = "of"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak supervision of quality rules keeps; rejected ones go.
    Every row is judged on its own text; null, empty and blank texts go; rows that repeat a
    doc_id or text are judged alike and all stay or go; null ids stay."""
    return judged(docs, carry=COLUMNS[1:]).where("kept").select("doc_id", "carried.*")


def _without_lines(docs: DataFrame, most: float) -> DataFrame:
    out = deduplicated(docs, most=most, carry=COLUMNS[2:])
    length = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("carried.n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", length.cast("long").alias("n_chars"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat before them: equal ones, and for lines of 20
    characters or more those within two edits.  n_chars follows a changed text.  A text whose
    repeated lines hold over half of its characters is left to the next stage, which drops
    it as a near duplicate or removes its lines.  Null and empty texts stay; rows that repeat a
    doc_id and text are one document; a null id comes first."""
    return _without_lines(docs, 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates: five
    words a shingle, similarity 0.8.  Of rows that repeat a doc_id and text one stays;
    documents without words or doc_id stay.  From the documents that stay, lines that
    repeat among them go whatever their share, as line_dedup leaves texts of mostly
    repeated lines whole."""
    docs = docs.select(*COLUMNS)
    with scratch(spark) as kept:
        gone = save(near_groups(docs, k=5, percent=80).where("not kept").select(F.col("doc_id").alias(_NOT)).distinct(), "gone")
        left = docs.join(small(gone), F.col("doc_id") == F.col(_NOT), "left_anti")
        again = save(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias(_NOT)), "again")
        if not again.isEmpty():
            single = left.join(small(again), F.col("doc_id") == F.col(_NOT), "left_anti")
            left = single.union(left.join(small(again), F.col("doc_id") == F.col(_NOT), "left_semi").dropDuplicates(["doc_id", "text"]))
        left = save(left, "left")
        kept.append(left)
    return _without_lines(left, 1)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item's five-word shingles; all
    rows of a doc_id go together, those without one as well.  Null and empty texts and, with an
    empty benchmark, all documents stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = docs.select(*COLUMNS)
    found = save(contained_items(docs, items, k=5, percent=80).select(F.col("doc_id").alias(_NOT)).distinct(), "leaks")
    return docs.join(small(found), F.col("doc_id").eqNullSafe(F.col(_NOT)), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, as pack returns them; every row
    is a document, a null or empty text the end id alone."""
    return pack(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]
#: Expectation-maximisation, edit joins, components and packing are beyond SQL; the tests
#: hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read back; what
    a stage leaves is deleted when the next one is written, the last when the application ends."""
    docs, before = documents(spark, sf_dir), None
    for at, (name, stage) in enumerate(STAGES):
        path = f"{folder(spark)}/{at}_{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before is not None:
            discard(before)
        docs = before = spark.read.parquet(path)
    return docs
