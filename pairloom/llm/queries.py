"""The thin queries that the driver runs, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .decontaminate import contained_items
from .line_dedup import deduplicated
from .minmax_dedup import near_groups
from .packing import pack
from .quality import judged
from .secret_scan import digest, scan
from .sentence_dedup import repeated_sentences
from .substring_dedup import repeated_bytes
from .token_files import round_trip
from .url_filter import judge

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; every executor has it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=1)


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir), width=200)


def op3_line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of deduplicated: the kept text as its hash."""
    found = deduplicated(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", "n_repeated", "mostly_repeated", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir))


def op5_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op6_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(documents(spark, sf_dir)))


def op8_contained_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, percent=80)


OP8_SQL = r"""
WITH words AS (
    SELECT doc_id, NULL AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    UNION ALL
    SELECT NULL, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), shingles AS (
    SELECT DISTINCT doc_id, item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) >= 5
), items AS (
    SELECT item_id, s, count(*) OVER (PARTITION BY item_id) AS n_item FROM shingles WHERE item_id IS NOT NULL
)
SELECT d.doc_id, i.item_id, i.n_item, count(*) AS n_shared
FROM shingles d JOIN items i ON d.s = i.s AND d.doc_id IS NOT NULL
GROUP BY d.doc_id, i.item_id, i.n_item HAVING count(*) * 100 >= i.n_item * 80
"""


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), k=4, percent=80)


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of repeated_sentences: the kept text as its hash."""
    found = repeated_sentences(documents(spark, sf_dir), width=3, min_words=50)
    return found.select("doc_id", "n_sentences", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_simple8b_tokens, op2_repeated_strings, op3_line_edits, op4_weak_supervision, op5_cutting_stock_packing, op6_url_language_models, op7_random_secrets, op8_contained_benchmarks, op9_minmax_near_dedup, op10_sentence_spans)}
ORACLES: dict[str, str] = {"op8_contained_benchmarks": OP8_SQL}
