"""The queries over the test tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pairs as P
from ..functions import scores as S
from ..functions import text as T
from ..operators import align, archive, network, select, stats, truth
from ..operators import seed as seeding
from ..operators.common import broadcast_if_small
from ..operators.entropy import byte_entropy
from ..sources.tables import alignments, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TIES = ", ".join(archive.TIES)
ALN = """aln AS (
    SELECT CAST(l_orderkey AS BIGINT) AS name, CAST(1 + l_linenumber % 2 AS BIGINT) AS mate, CAST(l_suppkey % 8 AS BIGINT) AS ref_index,
        CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS ref_begin,
        CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + floor(l_quantity) - 1 AS BIGINT) AS ref_end,
        CAST(floor(l_quantity) AS BIGINT) AS map_len, l_returnflag = 'R' AS is_rev, CAST(floor(l_extendedprice / 100) AS BIGINT) AS sw,
        CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS mismatches, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS quality, l_linestatus = 'F' AS is_filtered
    FROM lineitem)"""
MATES = (
    ALN
    + """, names AS (SELECT CAST(o_orderkey AS BIGINT) AS name FROM orders),
mates AS (
    SELECT names.name, count(*) FILTER (mate = 1 AND NOT is_filtered) AS n1, count(*) FILTER (mate = 2 AND NOT is_filtered) AS n2,
        coalesce(bool_or(mate = 1 AND is_filtered), false) AS f1, coalesce(bool_or(mate = 2 AND is_filtered), false) AS f2,
        min(CASE WHEN mate = 1 AND NOT is_filtered THEN row(ref_index, ref_begin, ref_end, is_rev, map_len, sw, quality) END) AS x1,
        min(CASE WHEN mate = 2 AND NOT is_filtered THEN row(ref_index, ref_begin, ref_end, is_rev, map_len, sw, quality) END) AS x2
    FROM names LEFT JOIN aln ON names.name = aln.name GROUP BY names.name),
split AS (
    SELECT *, CASE WHEN n1 = 1 THEN 'U' WHEN n1 > 1 THEN 'M' WHEN f1 THEN 'F' ELSE 'X' END AS c1, CASE WHEN n2 = 1 THEN 'U' WHEN n2 > 1 THEN 'M' WHEN f2 THEN 'F' ELSE 'X' END AS c2,
        x1[1] = x2[1] AS together, x1[2] AS b1, x2[2] AS b2, x1[3] AS e1, x2[3] AS e2, x1[4] AS r1, x2[4] AS r2
    FROM mates),
reads AS (
    SELECT *, CASE WHEN strpos('UMFX', c1) <= strpos('UMFX', c2) THEN c1 || c2 ELSE c2 || c1 END AS pair_class,
        coalesce(together AND r1 <> r2 AND CASE WHEN r1 THEN b1 > b2 ELSE b1 < b2 END, false) AS proper,
        CASE WHEN together THEN CASE WHEN b1 <= b2 THEN (CASE WHEN r1 THEN 'r1' ELSE 'f1' END) || '-' || (CASE WHEN r2 THEN 'r2' ELSE 'f2' END)
            ELSE (CASE WHEN r2 THEN 'r2' ELSE 'f2' END) || '-' || (CASE WHEN r1 THEN 'r1' ELSE 'f1' END) END END AS model,
        CASE WHEN together THEN CASE WHEN r1 THEN e1 - b2 + 1 ELSE e2 - b1 + 1 END END AS fragment
    FROM split)"""
)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def add(name: str, f: Query, sql: str | None = None) -> None:
    f.__name__ = name
    query(sql)(f)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("name"))
    return stats.classified(stats.mates(alignments(spark, sf_dir), names))


# seeding


@query(
    """WITH g AS (SELECT item_id, NULL AS doc_id, unnest(list_distinct(list_transform(range(1, length(text) - 13), lambda i: substring(text, i, 15)))) AS gram FROM benchmark
    UNION ALL SELECT NULL, doc_id, unnest(list_distinct(list_transform(range(1, length(text) - 13), lambda i: substring(text, i, 15)))) FROM documents),
items AS (SELECT item_id, gram, count(*) OVER (PARTITION BY item_id) AS n FROM g WHERE item_id IS NOT NULL),
hits AS (SELECT i.item_id, g.doc_id, i.n, count(*) AS k FROM g JOIN items i USING (gram) WHERE g.doc_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) * 100 >= i.n * 50),
ranked AS (SELECT *, row_number() OVER w AS place, lead(k) OVER w AS nk, count(*) OVER (PARTITION BY item_id) AS c FROM hits WINDOW w AS (PARTITION BY item_id ORDER BY k DESC, doc_id))
SELECT b.item_id, r.doc_id AS best_ref, r.k AS best_shared, CASE WHEN r.c > 0 THEN coalesce(r.nk, 0) END AS next_shared, coalesce(r.c, 0) AS n_candidates, CASE WHEN r.c = 1 THEN 'U' WHEN r.c > 1 THEN 'M' ELSE 'X' END AS class
FROM benchmark b LEFT JOIN ranked r ON b.item_id = r.item_id AND r.place = 1"""
)
def flagship_passage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return seeding.placed(items, seeding.candidates(items, docs, "item_id", "doc_id"), "item_id", "doc_id")


# projections and predicates


@query(f"WITH {ALN} SELECT name, mate, ref_index, ref_begin, quality FROM aln WHERE NOT is_filtered AND quality >= 4")
def mapped_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).where("not is_filtered and quality >= 4").select("name", "mate", "ref_index", "ref_begin", "quality")


@query("SELECT p_partkey, replace(p_brand || '-' || p_type, '-', '') AS bases FROM part")
def gap_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.without_gaps(F.concat_ws("-", "p_brand", "p_type")).alias("bases"))


@query("SELECT CAST(l_orderkey % 2048 AS BIGINT) AS flag, CAST(l_orderkey % 2048 AS BIGINT) & 64 <> 0 AS is_first, CAST(l_orderkey % 2048 AS BIGINT) & 4 <> 0 AS is_unmapped, CAST(l_orderkey % 2048 AS BIGINT) & 1024 <> 0 AS is_duplicate, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4")
def flag_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = (F.col("l_orderkey") % 2048).cast("long")
    n = table(spark, sf_dir, "lineitem").groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))
    f = F.col("flag")
    return n.select("flag", T.has_flag(f, "first").alias("is_first"), T.has_flag(f, "unmapped").alias("is_unmapped"), T.has_flag(f, "duplicate").alias("is_duplicate"), "n")


def _oriented(technology: str) -> Query:
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = F.col("a1"), F.col("a2")
        rows = reads(spark, sf_dir).where(a["ref_index"] == b["ref_index"])
        proper = P.proper_orientation(technology, a["is_rev"], a["ref_begin"], b["is_rev"], b["ref_begin"])
        length = P.fragment_length(technology, a["is_rev"], a["ref_begin"], a["ref_end"], b["ref_begin"], b["ref_end"])
        return rows.select("name", proper.alias("proper"), length.alias("fragment"), P.in_window(length, 300, 200).alias("in_window"))

    return of


_PROPER = {
    "454": "r1 = r2 AND CASE WHEN r1 THEN b1 < b2 ELSE b1 > b2 END",
    "solid": "r1 = r2 AND CASE WHEN r1 THEN b1 > b2 ELSE b1 < b2 END",
    "illumina_long": "r1 <> r2 AND CASE WHEN r1 THEN b1 < b2 ELSE b1 > b2 END",
    "illumina": "r1 <> r2 AND CASE WHEN r1 THEN b1 > b2 ELSE b1 < b2 END",
}
for _t, _rule in _PROPER.items():
    _length = f"CASE WHEN r1 {'=' if _t in ('454', 'illumina_long') else '<>'} true THEN e2 - b1 + 1 ELSE e1 - b2 + 1 END"
    add(f"proper_orientation_{_t}", _oriented(_t), f"WITH {MATES} SELECT name, {_rule} AS proper, {_length} AS fragment, abs({_length}) BETWEEN 100 AND 500 AS in_window FROM reads WHERE together")


@query(
    f"""WITH {ALN}, x AS (SELECT name, mate, ref_begin, ref_end, sw % 50 - 2 AS qb, sw % 50 - 2 + map_len - 1 AS qe, is_rev FROM aln)
SELECT name, mate, ref_begin, ref_end, CASE WHEN is_rev THEN 100 - qe - 1 ELSE qb END AS query_begin, CASE WHEN is_rev THEN 100 - qb - 1 ELSE qe END AS query_end, qe - qb + 1 AS query_span FROM x WHERE ref_begin >= 0 AND ref_end >= 0 AND qb >= 0 AND qe >= 0"""
)
def strand_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 100 letters; their positions in the query are made up from the score."""
    begin = F.col("sw") % 50 - 2
    rows = alignments(spark, sf_dir).select("name", "mate", P.placed(F.col("ref_begin"), F.col("ref_end"), begin, begin + F.col("map_len") - 1, 100, F.col("is_rev")).alias("p"))
    return rows.where("p is not null").select("name", "mate", "p.*")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 3 = 0 AS is_text FROM events")
def variant_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third value is made a text, which isn't a number."""
    value = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r"(\d+)", '"n$1"')).otherwise(F.col("props"))
    kind = F.schema_of_variant(F.try_variant_get(F.parse_json(value), "$.k", "variant"))
    return table(spark, sf_dir, "events").select("event_id", T.typed(value, "$.k", "long").alias("k"), (kind == "STRING").alias("is_text"))


@query("SELECT user_id, min(event_id) AS event_id, value FROM events JOIN (SELECT user_id, max(value) AS value FROM events GROUP BY user_id) USING (user_id, value) GROUP BY user_id, value")
def first_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.first_greatest(table(spark, sf_dir, "events"), "user_id", "value", "event_id")


@query(f"WITH {ALN} SELECT name, mate, ref_index, ref_begin FROM aln ORDER BY name, {_TIES} LIMIT 500")
def bounded_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.buffered(alignments(spark, sf_dir), ["name", *archive.TIES], 500).select("name", "mate", "ref_index", "ref_begin")


@query("SELECT l_orderkey AS name, l_linenumber AS line, s_name AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def required_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("label"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("code"))
    return archive.with_group(rows, groups).select("name", "line", "label")


# counters and histograms

_DOMAINS = {"MC": P.MATE_CLASSES, "RC": P.PAIR_CLASSES, "LS": stats.SEARCH, "OC": P.MODELS}
_LABELS = {
    "MC": "SELECT c1 AS label FROM reads UNION ALL SELECT c2 FROM reads",
    "RC": "SELECT pair_class AS label FROM reads",
    "LS": "SELECT pair_class || '-' || CASE WHEN f1 OR f2 THEN 'LocalRescue' WHEN proper THEN 'localConsistance' END AS label FROM reads WHERE pair_class IN ('UU', 'UM', 'MM')",
    "OC": "SELECT model AS label FROM reads WHERE pair_class = 'UU'",
}


def _rescued(rows: DataFrame) -> DataFrame:
    """As the tables have no rescues, a pair with a filtered alignment stands for one."""
    return rows.withColumn("rescued", F.col("f1") | F.col("f2"))


def _class_sql(kind: str) -> str:
    values = ", ".join(f"({i}, '{x}')" for i, x in enumerate(_DOMAINS[kind], 1))
    return f"SELECT d.bin, d.label, count(l.label) AS n, CAST(sum(count(l.label)) OVER (ORDER BY d.bin) AS BIGINT) AS cum FROM (SELECT CAST(bin AS BIGINT) AS bin, label FROM (VALUES {values}) v(bin, label)) d LEFT JOIN ({_LABELS[kind]}) l ON d.label = l.label GROUP BY d.bin, d.label"


def _classes(kind: str) -> Query:
    return lambda spark, sf_dir: stats.class_counts(_rescued(reads(spark, sf_dir)), kind)


for _name, _kind in (("mate_class_counts", "MC"), ("pair_class_counts", "RC"), ("rescue_consistency_counts", "LS"), ("orientation_counts", "OC")):
    add(_name, _classes(_kind), f"WITH {MATES} {_class_sql(_kind)}")

_FREE = "SELECT * FROM aln WHERE NOT is_filtered"
_SOURCES = {
    "LF": "SELECT fragment AS x FROM reads WHERE pair_class = 'UU' AND fragment IS NOT NULL",
    "LR": f"SELECT map_len AS x FROM ({_FREE})",
    "NA": "SELECT n1 AS x FROM reads WHERE n1 > 0 UNION ALL SELECT n2 FROM reads WHERE n2 > 0",
    "MQ": f"SELECT quality AS x FROM ({_FREE})",
    "MM": f"SELECT mismatches AS x FROM ({_FREE})",
}


def _histogram_sql(kind: str, low: int, bins: int) -> str:
    return f"SELECT x - ({low}) AS bin, x, n, CAST(sum(n) OVER (ORDER BY x) + (SELECT count(*) FROM ({_SOURCES[kind]}) WHERE x < {low}) AS BIGINT) AS cum FROM (SELECT x, count(*) AS n FROM ({_SOURCES[kind]}) WHERE x BETWEEN {low} AND {low + bins - 1} GROUP BY x)"


def _values(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, object]:
    if kind == "LF":
        return reads(spark, sf_dir).where("pair_class = 'UU'"), F.col("fragment")
    if kind == "NA":
        return reads(spark, sf_dir).select(F.explode(F.array("n1", "n2")).alias("n")).where("n > 0"), F.col("n")
    return alignments(spark, sf_dir).where("not is_filtered"), F.col({"LR": "map_len", "MQ": "quality", "MM": "mismatches"}[kind])


def _histogram(kind: str, low: int, bins: int) -> Query:
    return lambda spark, sf_dir: stats.histogram(*_values(spark, sf_dir, kind), low, bins)


for _name, _kind, _low, _bins in (("hist_fragment", "LF", -99, 10_000), ("hist_read_length", "LR", 0, 1000), ("hist_multiplicity", "NA", 0, 5000), ("hist_mapq", "MQ", 0, 256), ("hist_mismatch", "MM", 0, 100), ("hist_bounded", "LR", 10, 20)):
    add(_name, _histogram(_kind, _low, _bins), f"WITH {MATES} {_histogram_sql(_kind, _low, _bins)}")


@query(
    "WITH "
    + MATES
    + " UNION ALL ".join(
        f" SELECT '{k}' AS section, count(*) AS tot, round(avg(x) FILTER (x BETWEEN {a} AND {a + n - 1}), 6) AS mean, round(stddev_pop(x) FILTER (x BETWEEN {a} AND {a + n - 1}), 6) AS std, count(*) FILTER (x BETWEEN {a} AND {a + n - 1}) AS in_range, count(*) FILTER (x >= {a + n}) AS over, count(*) FILTER (x < {a}) AS under FROM ({_SOURCES[k]})"
        for k, (a, n) in (stats.SECTIONS | {"LR": (10, 20)}).items()
    )
)
def hist_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.all_moments(alignments(spark, sf_dir), reads(spark, sf_dir), stats.SECTIONS | {"LR": (10, 20)})


@query(
    "WITH "
    + MATES
    + " UNION ALL ".join(
        [f" SELECT '{k}' AS section, bin, x, n, cum, CAST(x AS VARCHAR) AS label FROM ({_histogram_sql(k, *b)})" for k, b in stats.SECTIONS.items()] + [f" SELECT '{k}' AS section, bin, bin AS x, n, cum, label FROM ({_class_sql(k)})" for k in _DOMAINS]
    )
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.report(alignments(spark, sf_dir), _rescued(reads(spark, sf_dir)))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, '@RG' || chr(9) || 'ID:' || s_suppkey || chr(9) || 'SM:' || CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE s_name END || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE chr(9) || 'LB:' || n_name END
|| chr(9) || 'PI:' || CAST(floor(abs(s_acctbal)) AS BIGINT) || chr(9) || 'PL:' || CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE 'ILLUMINA' END AS line FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def rg_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").join(broadcast_if_small(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    text = lambda keep, c: F.when(keep, c).otherwise("")
    empty = F.lit("")
    return stats.header_lines(
        rows.select(key.cast("string").alias("id"), text(key % 3 != 0, F.col("s_name")).alias("sample"), text(key % 2 != 0, F.col("n_name")).alias("library"), empty.alias("description"), empty.alias("platform_unit"), F.floor(F.abs("s_acctbal")).cast("long").alias("median_fragment"), empty.alias("center"), text(key % 5 != 0, F.lit("ILLUMINA")).alias("technology"))
    )


# sorting, merging and joining

@query(f"WITH {ALN} SELECT *, row_number() OVER (PARTITION BY name ORDER BY {_TIES}) AS place FROM aln")
def sort_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = archive.rank_within(alignments(spark, sf_dir), ["name"], list(archive.TIES))
    return archive.sort_by_name(ranked)


@query(f"WITH {ALN} SELECT *, row_number() OVER (PARTITION BY ref_index ORDER BY ref_begin, name, {_TIES}) AS place FROM aln")
def sort_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a reference sequence holds a share of all rows that doesn't shrink, so the place comes from
    # the counts of the positions before and a rank among the rows of one position
    aln = alignments(spark, sf_dir)
    before = Window.partitionBy("ref_index").orderBy("ref_begin").rowsBetween(Window.unboundedPreceding, -1)
    starts = aln.groupBy("ref_index", "ref_begin").agg(F.count("*").alias("n")).select("ref_index", "ref_begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = archive.rank_within(aln, ["ref_index", "ref_begin"], ["name", *archive.TIES])
    return archive.sort_by_position(own.join(starts, ["ref_index", "ref_begin"]).withColumn("place", (F.col("base") + F.col("place")).cast("long")).drop("base"))


@query(
    f"""WITH {ALN}, m AS (SELECT *, quality >= 7 AS marked, count(*) FILTER (quality >= 7) OVER (PARTITION BY name, mate) AS k, count(*) OVER (PARTITION BY name, mate) AS n,
    row_number() OVER (PARTITION BY name, mate ORDER BY quality >= 7 DESC, ref_index, ref_begin, mate, map_len, is_rev, sw, mismatches, quality, is_filtered) AS spot FROM aln)
SELECT * EXCLUDE (k, n, spot) FROM m WHERE spot <= greatest(k, least(2, n))"""
)
def keep_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.keep_at_least(alignments(spark, sf_dir), F.col("quality") >= 7)


def _dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import tagged

    named = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name")]
    return tagged([table(spark, sf_dir, t).select(F.col(k).cast("long").alias("key"), F.col(n).alias("ref_name")) for t, k, n in named])


_DICT = "dict AS (SELECT 0 AS owner, CAST(r_regionkey AS BIGINT) AS key, r_name AS ref_name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation UNION ALL SELECT 2, s_suppkey, s_name FROM supplier)"


@query(f"WITH {_DICT} SELECT owner, key, ref_name, row_number() OVER (ORDER BY owner, key) - 1 AS global_index FROM dict")
def dictionary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.concatenated(_dictionaries(spark, sf_dir), "key")


@query(f"WITH {_DICT}, {ALN}, o AS (SELECT owner, (SELECT count(*) FROM dict d WHERE d.owner < x.owner) AS base FROM (SELECT DISTINCT owner FROM dict) x) SELECT name, mate, name % 3 AS owner, ref_index + base AS ref_index, count(*) AS n FROM aln JOIN o ON o.owner = name % 3 GROUP BY 1, 2, 3, 4")
def key_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln = alignments(spark, sf_dir).withColumn("owner", F.col("name") % 3)
    return archive.rebase(aln, _dictionaries(spark, sf_dir)).groupBy("name", "mate", "owner", "ref_index").agg(F.count("*").alias("n"))


_ZIP = f"""{ALN}, owned AS (SELECT *, sw % 2 AS owner FROM aln),
placed AS (SELECT *, row_number() OVER (PARTITION BY name, mate, owner ORDER BY ref_index, ref_begin, mate, map_len, is_rev, sw, mismatches, quality, is_filtered) AS no FROM owned),
taken AS (SELECT *, row_number() OVER (PARTITION BY name, mate ORDER BY sw DESC) AS k FROM placed WHERE owner = 0 OR no = 1),
merged AS (SELECT name, mate, CAST(sum(1 + quality % 3) AS BIGINT) AS n_mapped, CAST(sum(mismatches) AS BIGINT) AS n_hashes, count(DISTINCT owner) AS n_inputs, bool_or(is_filtered) AS is_filtered, max(sw) AS top_sw, coalesce(max(sw) FILTER (k = 2), 0) AS next_sw FROM taken GROUP BY name, mate)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that alignments bring along are made up from other columns."""
    return archive.zip_merge(alignments(spark, sf_dir).withColumn("owner", F.col("sw") % 2), 1 + F.col("quality") % 3, F.col("mismatches"))


@query(f"WITH {_ZIP} SELECT * FROM merged")
def zip_merge_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query(f"WITH {ALN} SELECT name, count(DISTINCT sw % 2) AS n_inputs FROM aln GROUP BY name HAVING count(DISTINCT sw % 2) < 2")
def zip_merge_unequal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.unequal_inputs(alignments(spark, sf_dir).withColumn("owner", F.col("sw") % 2), 2)


@query(f"WITH {_ZIP}, special AS (SELECT CAST(p_partkey AS BIGINT) AS name, CAST(1 + p_size % 2 AS BIGINT) AS mate, min(p_brand) AS code FROM part GROUP BY 1, 2) SELECT name, mate, n_mapped, CASE WHEN n_mapped > 1 THEN code END AS special_code FROM merged LEFT JOIN special USING (name, mate)")
def special_decorate(spark: SparkSession, sf_dir: str) -> DataFrame:
    special = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("name"), (1 + F.col("p_size") % 2).cast("long").alias("mate"), F.col("p_brand").alias("code"))
    return archive.decorate(_merged(spark, sf_dir), special).select("name", "mate", "n_mapped", "special_code")


@query(f"WITH {ALN}, x AS (SELECT a.name, a.mate, a.ref_index, a.ref_begin, a.map_len, a.is_rev, a.sw, EXISTS (SELECT 1 FROM aln b WHERE b.name = a.name AND b.mate <> a.mate AND abs(b.ref_begin - a.ref_begin) <= 30 AND b.is_rev <> a.is_rev) AS marked FROM aln a) SELECT * FROM x")
def proper_pair_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.proper_pairs(alignments(spark, sf_dir), 30).select("name", "mate", "ref_index", "ref_begin", "map_len", "is_rev", "sw", "marked")


# truth

_TRUTH = f"""{ALN}, gold AS (SELECT CAST(o_orderkey AS BIGINT) AS name, CAST(o_custkey % 8 AS BIGINT) AS chr, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS pos, CAST(1 AS BIGINT) AS occurrence FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ref_begin, {_TIES}) AS occurrence FROM aln), joined AS (SELECT name, occurrence, ref_begin, quality, pos, abs(ref_begin - pos) < 20 AS correct, abs(ref_begin - pos) < 10 AS correct_single FROM gold JOIN t USING (name, occurrence))"""


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    gold = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("name"), pos.alias("pos"))
    joined = truth.attach(gold, alignments(spark, sf_dir), "name", ["pos"], ["ref_begin", *[t for t in archive.TIES if t != "ref_begin"]])
    one = F.lit("")
    return joined.select("name", "occurrence", "ref_begin", "quality", "pos", T.position_correct(one, F.col("ref_begin"), one, F.col("pos"), 20).alias("correct"), T.position_correct(one, F.col("ref_begin"), one, F.col("pos"), 10).alias("correct_single"))


@query(f"WITH {_TRUTH} SELECT * EXCLUDE (correct_single) FROM joined")
def truth_join_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir).drop("correct_single")


@query(f"WITH {_TRUTH} SELECT * EXCLUDE (correct) FROM joined")
def truth_join_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir).drop("correct")


_PAIRED = f"""{ALN}, g AS (SELECT CAST(o_orderkey AS BIGINT) AS name, CAST(o_custkey % 8 AS VARCHAR) AS chr, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS pos FROM orders),
gold AS (SELECT name, CASE WHEN name % 2 = 0 THEN 1 ELSE 2 END AS mate, chr, pos FROM g UNION ALL SELECT name, CASE WHEN name % 2 = 0 THEN 2 ELSE 1 END, chr, pos + 100 FROM g),
t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ref_begin, {_TIES}) - 1 AS spot FROM aln),
test AS (SELECT *, CASE WHEN (spot % 2 = 0) = (first_value(sw % 2 = 0) OVER (PARTITION BY name, spot // 2 ORDER BY spot)) THEN 1 ELSE 2 END AS own FROM t WHERE spot < 2),
joined AS (SELECT name, CAST(own AS BIGINT) AS mate, gold.chr AS true_chr, gold.pos AS true_pos, quality, CAST(ref_index AS VARCHAR) = gold.chr AND abs(ref_begin - gold.pos) < 20 AS correct, NOT is_filtered AS mapped, count(*) OVER (PARTITION BY name) AS n FROM gold JOIN test USING (name) WHERE gold.mate = own)"""


@query(f"WITH {_PAIRED} SELECT name, mate, true_chr, true_pos, quality, correct, mapped AND bool_or(mapped AND mate = 1) OVER (PARTITION BY name) AS counted, bool_and(mapped) OVER (PARTITION BY name) AS reported FROM joined WHERE n = 2")
def truth_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two gold and two test records a name, re-paired by the flag of the first."""
    pos = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("name"), (F.col("o_custkey") % 8).cast("string").alias("chr"), pos.alias("pos"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("no"), F.when(F.col("name") % 2 == 0, 64).otherwise(128).alias("flag"), F.col("pos")), F.struct(F.lit(1).alias("no"), F.lit(128).alias("flag"), (F.col("pos") + 100).alias("pos"))))
    gold = orders.select("name", "chr", both.alias("r")).select("name", "chr", "r.*")
    aln = alignments(spark, sf_dir)
    bits = T.flags(first=F.col("sw") % 2 == 0, second=F.col("sw") % 2 != 0, unmapped=F.col("is_filtered"))
    test = aln.withColumns({"flag": bits, "chr": F.col("ref_index").cast("string"), "pos": F.col("ref_begin"), "side": F.col("mate")})
    ties = ["pos", *["side" if t == "mate" else t for t in archive.TIES]]
    return truth.attach_pairs(gold, test, "name", ["no"], ties).select("name", "mate", "true_chr", "true_pos", "quality", "correct", "counted", "reported")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def truth_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return truth.unmatched(table(spark, sf_dir, "orders"), lines, "o_orderkey").select("o_orderkey")


@query(f"WITH {_TRUTH} SELECT quality, count(*) AS n, count(*) FILTER (NOT correct) AS n_wrong, CASE WHEN count(*) FILTER (NOT correct) > 0 THEN round(-10 * log10(count(*) FILTER (NOT correct) / count(*)), 6) END AS empirical FROM joined GROUP BY quality")
def calibration_by_mapq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.calibration(_truth(spark, sf_dir), "quality", "correct")


# selection


@query(f"WITH {ALN}, r AS (SELECT *, row_number() OVER (PARTITION BY name, mate ORDER BY sw DESC) AS k FROM aln) SELECT name, mate, max(sw) AS top_sw, coalesce(max(sw) FILTER (k = 2), 0) AS next_sw FROM r GROUP BY name, mate")
def top2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_two(alignments(spark, sf_dir))


@query(
    f"""WITH {ALN}, r AS (SELECT *, row_number() OVER (PARTITION BY name, mate ORDER BY sw DESC) AS k FROM aln), t AS (SELECT name, mate, max(sw) AS top_sw, coalesce(max(sw) FILTER (k = 2), 0) AS next_sw FROM r GROUP BY name, mate)
SELECT name, mate, sw, top_sw, CASE WHEN sw = top_sw THEN greatest(quality, next_sw) ELSE top_sw END AS patched FROM aln JOIN t USING (name, mate)"""
)
def next_score_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln = alignments(spark, sf_dir)
    rows = aln.join(select.top_two(aln), ["name", "mate"])
    return rows.select("name", "mate", "sw", "top_sw", select.patched_next(F.col("sw"), F.col("quality"), F.col("top_sw"), F.col("next_sw")).alias("patched"))


@query(f"WITH {ALN}, r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(quality) OVER w, 0) AS next_quality FROM aln WINDOW w AS (PARTITION BY name, mate ORDER BY quality DESC, ref_index, ref_begin, map_len, is_rev, sw, mismatches, is_filtered)) SELECT name, mate, ref_index, ref_begin, quality, next_quality FROM r WHERE k = 1")
def best_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.best_by_quality(alignments(spark, sf_dir))


@query()
def best_pair_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.best_pairs(alignments(spark, sf_dir), 400)


# text functions


@query(
    """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents), c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY 1, 2),
e AS (SELECT doc_id, abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS h, count(*) AS k FROM c GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(h, 0), 6) + 0.0 AS entropy, coalesce(k, 0) AS n_tokens, round(coalesce(log2(k), 0), 6) + 0.0 AS max_entropy, CASE WHEN k > 1 THEN round(h / log2(k), 6) + 0.0 END AS ratio FROM documents d LEFT JOIN e USING (doc_id)"""
)
def byte_entropy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_entropy(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def doc_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT item_id, translate(regexp_replace(text, '[^ACGTUacgtu]', 'N', 'gs'), 'ACGTUacgtuN', '01230012304') AS codes FROM benchmark")
def base_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.base_codes(F.col("text")).alias("codes"))


@query("SELECT item_id, array_to_string(list_reverse(string_split(text, '')), '') AS reversed FROM benchmark")
def reverse_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.reverse("text").alias("reversed"))


@query(
    f"""WITH {ALN} SELECT name, mate, CAST(sw AS DOUBLE) AS best, CAST(map_len AS DOUBLE) AS next, CAST(ref_index AS DOUBLE) AS longest, CAST(quality AS DOUBLE) / 2 AS entropy, mismatches AS n_mappings, ref_begin AS n_hashes,
'chr' || ref_index AS chr, ref_end AS pos FROM aln"""
)
def tag_parse_zn_xc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alignments(spark, sf_dir)
    zn = F.concat(F.lit("ZN:Z:"), F.concat_ws(";", "sw", "map_len", "ref_index", F.col("quality") / 2, "mismatches", "ref_begin"))
    xc = F.concat(F.lit("XC:Z:chr"), F.col("ref_index"), F.lit(";"), F.col("ref_end"))
    rows = a.select("name", "mate", T.zn_fields(zn).alias("zn"), T.xc_fields(xc).alias("xc"))
    return rows.select("name", "mate", "zn.*", "xc.*")


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts against themselves with letters changed, taken out and put in at
    regular places, as gapped pairs, as _PAIRS has them."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("t"))
    letters = F.split("t", r"(?!^)(?!\z)")
    ref = F.array_join(F.transform(letters, lambda c, i: F.when(i % 13 == 6, "-").otherwise(c)), "")
    own = F.array_join(F.transform(letters, lambda c, i: F.when((i % 17 == 9) & (i % 13 != 6), "-").when(i % 11 == 4, "#").otherwise(c)), "")
    return rows.select("item_id", ref.alias("reference"), own.alias("query")).where(F.length("reference") > 0)


_PAIRS = """letters AS (SELECT item_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS t FROM benchmark),
steps AS (SELECT item_id, i, CASE WHEN i % 13 = 6 THEN '-' ELSE substring(t, i + 1, 1) END AS r, CASE WHEN i % 17 = 9 AND i % 13 <> 6 THEN '-' WHEN i % 11 = 4 THEN '#' ELSE substring(t, i + 1, 1) END AS q FROM (SELECT item_id, t, CAST(unnest(range(length(t))) AS BIGINT) AS i FROM letters)),
kinds AS (SELECT *, CASE WHEN r = '-' THEN 'I' WHEN q = '-' THEN 'D' ELSE 'M' END AS op, CASE WHEN r = '-' THEN 'I' WHEN q = '-' THEN 'D' WHEN r = q THEN '=' ELSE 'X' END AS x FROM steps),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY item_id, op ORDER BY i) AS g, i - row_number() OVER (PARTITION BY item_id, x ORDER BY i) AS h FROM kinds),
ops AS (SELECT item_id, op, g, min(i) AS spot, count(*) AS n FROM runs GROUP BY item_id, op, g), exact AS (SELECT item_id, x, h, min(i) AS spot, count(*) AS n FROM runs GROUP BY item_id, x, h)"""


@query(f"WITH {_PAIRS} SELECT item_id, string_agg(n || op, '' ORDER BY spot) AS cigar FROM ops GROUP BY item_id")
def cigar_from_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gapped(spark, sf_dir).select("item_id", T.cigar(T.operations(F.col("reference"), F.col("query"))).alias("cigar"))


@query(f"WITH {_PAIRS} SELECT item_id, string_agg((n << 4) | (strpos('MIDNSHP=X', op) - 1), ',' ORDER BY spot) AS packed FROM ops GROUP BY item_id")
def cigar_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = T.cigar_packed(T.operations(F.col("reference"), F.col("query")))
    return _gapped(spark, sf_dir).select("item_id", F.array_join(packed.cast("array<string>"), ",").alias("packed"))


@query(f"WITH {_PAIRS} SELECT item_id, string_agg(n || x, '' ORDER BY spot) AS cigar, CAST(sum(CASE WHEN x <> '=' THEN n ELSE 0 END) AS INTEGER) AS mismatches FROM exact GROUP BY item_id")
def cigar_eqx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gapped(spark, sf_dir).select("item_id", T.cigar_equal_different(F.col("reference"), F.col("query")).alias("x")).select("item_id", "x.*")


# what breaks a run of matched letters, with the matched ones before it
_MD = """marks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS j FROM kinds WHERE r <> '-'),
breaks AS (SELECT *, j - 1 - coalesce(lag(j) OVER w, 0) AS run, lag(x) OVER w AS was FROM marks WHERE x <> '=' WINDOW w AS (PARTITION BY item_id ORDER BY j)),
said AS (SELECT item_id, max(j) AS spot, string_agg(CASE WHEN x = 'X' THEN run || r ELSE CASE WHEN run > 0 THEN CAST(run AS VARCHAR) ELSE '' END || CASE WHEN run = 0 AND was = 'D' THEN '' ELSE '^' END || r END, '' ORDER BY j) AS body FROM breaks GROUP BY item_id),
md AS (SELECT item_id, coalesce(body, '') || CASE WHEN n > coalesce(spot, 0) THEN CAST(n - coalesce(spot, 0) AS VARCHAR) ELSE '' END AS md FROM (SELECT item_id, count(*) AS n FROM marks GROUP BY item_id) LEFT JOIN said USING (item_id))"""


@query(f"WITH {_PAIRS}, {_MD} SELECT item_id, md FROM md")
def md_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gapped(spark, sf_dir).select("item_id", T.md_tag(F.col("reference"), F.col("query")).alias("md"))


@query(
    f"WITH {_PAIRS}, {_MD}, c AS (SELECT item_id, string_agg(n || op, '' ORDER BY spot) AS cigar FROM ops GROUP BY item_id) SELECT item_id, '<@;' || item_id % 60 || ';;;2;;><&;' || item_id % 60 || ';;;2;' || cigar || ';' || md || '>' AS za FROM c JOIN md USING (item_id)"
)
def za_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, q = F.col("reference"), F.col("query")
    rows = _gapped(spark, sf_dir).select("item_id", T.cigar(T.operations(r, q)).alias("c"), T.md_tag(r, q).alias("m"))
    part = lambda own: T.za_part(F.lit(own), F.col("item_id") % 60, F.lit(None).cast("string"), F.lit(2), F.col("c"), F.col("m"), F.lit(own))
    return rows.select("item_id", F.concat(part(True), part(False)).alias("za"))


@query(f"WITH {_PAIRS} SELECT item_id, string_agg(r, '' ORDER BY i) AS reference, string_agg(q, '' ORDER BY i) AS query FROM steps GROUP BY item_id")
def gapped_from_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, q = F.col("reference"), F.col("query")
    back = T.gapped(T.without_gaps(r), T.without_gaps(q), T.operations(r, q))
    return _gapped(spark, sf_dir).select("item_id", back.alias("g")).select("item_id", "g.*")


# alignment


def _candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    # kept, as the check of its size and the join would seed all texts twice
    found = broadcast_if_small(seeding.candidates(items, docs, "item_id", "doc_id").select("item_id", "doc_id").persist())
    pairs = docs.select("doc_id", F.col("text").alias("ref")).join(found, "doc_id")
    pairs = pairs.join(broadcast_if_small(items.select("item_id", F.col("text").alias("query"))), "item_id")
    # few rows of much work: a number of partitions, or adaptive planning puts them into one
    return pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "item_id", "doc_id")


_LETTERS = align.Scoring(bases=False)


@query()
def sw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = align.aligner(_LETTERS, mask=0, least_score=None)
    return _candidate_pairs(spark, sf_dir).select("item_id", "doc_id", of("query", "ref").alias("a")).select("item_id", "doc_id", "a.score", "a.ref_end", "a.query_end")


@query()
def sw_second_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = align.aligner(_LETTERS, least_score=None)
    return _candidate_pairs(spark, sf_dir).select("item_id", "doc_id", of("query", "ref").alias("a")).select("item_id", "doc_id", "a.score", "a.score2", "a.ref_end2")


@query()
def sw_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = align.aligner(_LETTERS, least_score=50)
    return _candidate_pairs(spark, sf_dir).select("item_id", "doc_id", of("query", "ref").alias("a")).select("item_id", "doc_id", "a.*")


# quality, networks and training

@query(f"WITH {ALN} SELECT name, mate, ref_begin, round((sw - quality) / (map_len * 10), 6) AS f0, round(mismatches / map_len, 6) AS f1, CAST(quality AS DOUBLE) AS f2, round(log10(ref_index + 1), 6) AS f3, round(log10(ref_begin + 1), 6) AS f4 FROM aln WHERE map_len > 0")
def nn_features_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    parts = S.features(c("sw"), c("quality"), c("mismatches"), c("map_len"), c("quality"), c("ref_index"), c("ref_begin"))
    return alignments(spark, sf_dir).where("map_len > 0").select("name", "mate", "ref_begin", *[F.round(x, 6).alias(f"f{i}") for i, x in enumerate(parts)])


def _pair_features(rows: DataFrame) -> list:
    out = []
    for m in ("a1", "a2"):
        a = F.col(m)
        out += S.features(a["sw"], a["quality"], a["quality"], a["map_len"], a["quality"], F.col(f"n{m[1]}"), a["ref_index"], logs=False)
    return [*out, S.fragment_feature(400, F.col("fragment"))]


def _side(m: int) -> list[str]:
    sw, q, n, r = f"x{m}[6]", f"x{m}[7]", f"x{m}[5]", f"x{m}[1]"
    return [f"round(({sw} - {q}) / ({n} * 10), 6)", f"round({q} / {n}, 6)", f"CAST({q} AS DOUBLE)", f"CAST(n{m} AS DOUBLE)", f"CAST({r} AS DOUBLE)"]


_FRAGMENT = "round(log10(abs(400 - abs(fragment)) + 1), 6)"


@query(f"WITH {MATES} SELECT name, {', '.join(f'{x} AS f{i}' for i, x in enumerate([*_side(1), *_side(2), _FRAGMENT]))} FROM reads WHERE fragment IS NOT NULL")
def nn_features_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).where("fragment is not null")
    return rows.select("name", *[F.round(x, 6).alias(f"f{i}") for i, x in enumerate(_pair_features(rows))])


@query(
    f"WITH {MATES} SELECT name, 1 AS side, {', '.join(f'{x} AS f{i}' for i, x in enumerate([*_side(1), *_side(2), _FRAGMENT]))}, CASE WHEN proper THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS target FROM reads WHERE fragment IS NOT NULL UNION ALL SELECT name, 2, {', '.join(f'{x} AS f{i}' for i, x in enumerate([*_side(2), *_side(1), _FRAGMENT]))}, CASE WHEN proper THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END FROM reads WHERE fragment IS NOT NULL"
)
def train_rows_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).where("fragment is not null")
    f = [F.round(x, 6) for x in _pair_features(rows)]
    both = F.array(F.struct(F.lit(1).alias("side"), F.array(*f).alias("f")), F.struct(F.lit(2).alias("side"), F.array(*f[5:10], *f[:5], f[10]).alias("f")))
    out = rows.select("name", F.explode(both).alias("x"), F.when(F.col("proper"), 1.0).otherwise(-1.0).alias("target"))
    return out.select("name", "x.side", *[F.get("x.f", F.lit(i)).alias(f"f{i}") for i in range(11)], "target")


def fixed_network(inputs: int, hidden: int) -> network.Network:
    """Weights by formula, so that SQL can have them too."""
    w = lambda n, m, k: np.round(np.sin(np.arange(n * m).reshape(n, m) * (k + 1)), 3)
    return network.Network((network.Layer(w(hidden, inputs + 1, 1)), network.Layer(w(1, hidden + 1, 2))))


_NET, _PAIR_NET, _SINGLE_NET = fixed_network(5, 4), fixed_network(11, 100), fixed_network(5, 100)


def _forward_sql(net: network.Network = _NET, inputs: list[str] | None = None) -> str:
    inputs = inputs or [f"embedding[{i + 1}]::DOUBLE" for i in range(net.sizes[0])]
    hidden, last = net.layers[0].weights.tolist(), net.layers[1].weights.tolist()[0]
    tanh = lambda s: f"(2 / (1 + exp(-2 * greatest(-300, least(300, 0.5 * ({s}))))) - 1)"
    units = [tanh(" + ".join([f"({w}) * {x}" for w, x in zip(row, inputs)] + [f"({row[-1]})"])) for row in hidden]
    return tanh(" + ".join([f"({w}) * {u}" for w, u in zip(last, units)] + [f"({last[-1]})"]))


def _phred_sql(y: str) -> str:
    return f"CAST(CASE WHEN 1 - (1 + {y}) / 2 >= 1 THEN 255 WHEN 1 - (1 + {y}) / 2 <= 0 THEN 0 WHEN floor(-10 * log10(1 - (1 + {y}) / 2) + 0.5) > 255 THEN 0 ELSE floor(-10 * log10(1 - (1 + {y}) / 2) + 0.5) END AS BIGINT)"


@query(f"WITH o AS (SELECT vec_id, {_forward_sql()} AS y FROM embeddings) SELECT vec_id, round(y, 6) AS output, {_phred_sql('y')} AS phred FROM o")
def nn_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.get(_NET.forward(F.slice("embedding", 1, 5)), F.lit(0))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", y.alias("y"))
    return rows.select("vec_id", F.round("y", 6).alias("output"), S.phred(F.col("y")).alias("phred"))


@query(f"SELECT vec_id, round({_forward_sql(_PAIR_NET)}, 6) AS output FROM embeddings")
def nn_forward_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of 11, 100 and 1 neurons."""
    y = F.get(_PAIR_NET.forward(F.slice("embedding", 1, 11)), F.lit(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(y, 6).alias("output"))


_SINGLE = [[f"round((x{m}[6] - x{m}[7]) / (x{m}[5] * 10), 6)", f"round(x{m}[7] / x{m}[5], 6)", f"CAST(x{m}[7] AS DOUBLE)", f"round(log10(n{m} + 1), 6)", f"round(log10(x{m}[1] + 1), 6)"] for m in (1, 2)]
_RECORD = "SELECT name, {m} AS mate, pair_class, n{m} AS own_n, n{o} AS other_n, r{m} AS own_r, r{o} AS other_r, proper, name % 25 AS code, fragment, {features} FROM reads"


def _record_sql(m: int) -> str:
    pair, single = [*_side(m), *_side(3 - m), _FRAGMENT], _SINGLE[m - 1]
    return _RECORD.format(m=m, o=3 - m, features=", ".join([f"{x} AS p{i}" for i, x in enumerate(pair)] + [f"{x} AS s{i}" for i, x in enumerate(single)]))


@query(
    f"""WITH {MATES}, f AS ({_record_sql(1)} UNION ALL {_record_sql(2)}),
y AS (SELECT *, CASE WHEN fragment IS NOT NULL THEN {_forward_sql(_PAIR_NET, [f"p{i}" for i in range(11)])} WHEN own_n > 0 THEN {_forward_sql(_SINGLE_NET, [f"s{i}" for i in range(5)])} END AS y FROM f),
q AS (SELECT *, coalesce({_phred_sql("y")}, 0) AS mapq FROM y)
SELECT q.name, CAST(q.mate AS BIGINT) AS mate, q.pair_class, n_name AS label, q.mapq, CAST(1 + CASE WHEN q.proper THEN 2 ELSE 0 END + CASE WHEN q.own_n = 0 THEN 4 ELSE 0 END + CASE WHEN q.other_n = 0 THEN 8 ELSE 0 END + CASE WHEN q.own_r THEN 16 ELSE 0 END + CASE WHEN q.other_r THEN 32 ELSE 0 END + CASE WHEN q.mate = 1 THEN 64 ELSE 128 END AS BIGINT) AS flag,
'<@;' || q.mapq || ';;;' || q.own_n || ';;><&;' || o.mapq || ';;;' || q.other_n || ';;>' AS za FROM q JOIN q o ON q.name = o.name AND q.mate <> o.mate JOIN nation ON n_nationkey = q.code"""
)
def record_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads to records: classes, features, a network for pairs and one for single mates,
    quality, required group, flags and tag."""
    rows = reads(spark, sf_dir)
    paired = [F.round(x, 6) for x in _pair_features(rows)]

    def record(m: int):
        o, a, c = 3 - m, F.col(f"a{m}"), F.col
        single = [F.round(x, 6) for x in S.features(a["sw"], a["quality"], a["quality"], a["map_len"], a["quality"], c(f"n{m}"), a["ref_index"])]
        features = F.array(*(paired if m == 1 else [*paired[5:10], *paired[:5], paired[10]]))
        y = F.when(c("fragment").isNotNull(), F.get(_PAIR_NET.forward(features), F.lit(0))).when(c(f"n{m}") > 0, F.get(_SINGLE_NET.forward(F.array(*single)), F.lit(0)))
        flag = T.flags(paired=F.lit(True), proper=c("proper"), unmapped=c(f"n{m}") == 0, mate_unmapped=c(f"n{o}") == 0, reverse=a["is_rev"], mate_reverse=c(f"a{o}")["is_rev"], **{("first", "second")[m - 1]: F.lit(True)})
        return F.struct(F.lit(m).cast("long").alias("mate"), F.coalesce(S.phred(y), F.lit(0)).alias("mapq"), c(f"n{m}").alias("n"), flag.alias("flag"))

    rows = rows.select("name", "pair_class", (F.col("name") % 25).cast("int").alias("code"), record(1).alias("m1"), record(2).alias("m2"))
    swapped = F.array(F.struct(F.col("m1").alias("own"), F.col("m2").alias("other")), F.struct(F.col("m2").alias("own"), F.col("m1").alias("other")))
    rows = rows.select("name", "pair_class", "code", F.explode(swapped).alias("r")).select("name", "pair_class", "code", "r.*")
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    own, other, none = F.col("own"), F.col("other"), F.lit("")
    part = lambda is_own, x: T.za_part(F.lit(is_own), x["mapq"], none, x["n"], none, none, F.lit(True))
    return archive.with_group(rows, groups).select("name", own["mate"].alias("mate"), "pair_class", "label", own["mapq"].alias("mapq"), own["flag"].alias("flag"), F.concat(part(True, own), part(False, other)).alias("za"))


def _steps_sql(points: tuple, low: int, high: int) -> str:
    parts = [f"WHEN x < {b[0]!r}::DOUBLE THEN (x - ({a[0]!r}::DOUBLE)) * ({b[1] - a[1]!r}::DOUBLE) / ({b[0] - a[0]!r}::DOUBLE) + ({a[1]!r}::DOUBLE)" for a, b in zip(points, points[1:])]
    return f"CASE WHEN x < {points[0][0]!r}::DOUBLE THEN {low}::DOUBLE {' '.join(parts)} ELSE {high}::DOUBLE END"


@query(
    """WITH v AS (SELECT event_id, value / 100 - 1 AS x FROM events)
SELECT event_id, round(x, 6) AS linear, CASE WHEN x < 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS threshold, round(1 / (1 + exp(-2 * x)), 6) AS sigmoid, round(2 / (1 + exp(-2 * x)) - 1, 6) AS sigmoid_symmetric, round(exp(-x * x), 6) AS gaussian, round(2 * exp(-x * x) - 1, 6) AS gaussian_symmetric,
round(x / 2 / (1 + abs(x)) + 0.5, 6) AS elliot, round(x / (1 + abs(x)), 6) AS elliot_symmetric, round(greatest(0, least(1, x)), 6) AS linear_piece, round(greatest(-1, least(1, x)), 6) AS linear_piece_symmetric, round(sin(x), 6) AS sin_symmetric, round(cos(x), 6) AS cos_symmetric, round(sin(x) / 2 + 0.5, 6) AS sin, round(cos(x) / 2 + 0.5, 6) AS cos, CASE WHEN x < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS threshold_symmetric, 0.0::DOUBLE AS gaussian_stepwise, """
    + f"round({_steps_sql(S.STEPWISE, 0, 1)}, 6) AS sigmoid_stepwise, round({_steps_sql(S.STEPWISE_SYMMETRIC, -1, 1)}, 6) AS sigmoid_symmetric_stepwise FROM v"
)
def activation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 100 - 1
    wanted = ("linear", "threshold", "sigmoid", "sigmoid_symmetric", "gaussian", "gaussian_symmetric", "elliot", "elliot_symmetric", "linear_piece", "linear_piece_symmetric", "sin_symmetric", "cos_symmetric", "sin", "cos", "threshold_symmetric", "gaussian_stepwise", "sigmoid_stepwise", "sigmoid_symmetric_stepwise")
    values = S.activations(x)
    return table(spark, sf_dir, "events").select("event_id", *[F.round(values[n], 6).alias(n) for n in wanted])


@query(
    """WITH v AS (SELECT event_id, value / 100 - 1 AS x FROM events), y AS (SELECT *, 1 / (1 + exp(-2 * x)) AS p, exp(-x * x) AS g FROM v)
SELECT event_id, 0.5::DOUBLE AS linear, round(greatest(0.01, least(0.99, p)) * (1 - greatest(0.01, least(0.99, p))), 6) AS sigmoid, round(0.5 * (1 - greatest(-0.98, least(0.98, 2 * p - 1)) ** 2), 6) AS sigmoid_symmetric, round(-0.5 * x * g, 6) + 0.0 AS gaussian, round(-0.5 * x * 2 * g, 6) + 0.0 AS gaussian_symmetric,
round(0.25 / (1 + abs(x)) ** 2, 6) AS elliot, round(0.5 / (1 + abs(x)) ** 2, 6) AS elliot_symmetric, round(0.5 * cos(0.5 * x), 6) AS sin_symmetric, round(-0.5 * sin(0.5 * x), 6) + 0.0 AS cos_symmetric, round(0.25 * cos(0.5 * x), 6) AS sin, round(-0.25 * sin(0.5 * x), 6) + 0.0 AS cos FROM y"""
)
def derivative_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 100 - 1
    outputs = S.activations(x)
    return table(spark, sf_dir, "events").select("event_id", *[(F.round(S.derivatives(outputs[n], 0.5, x)[n], 6) + 0.0).alias(n) for n in S.derivatives(x, 0.5, x)])


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.slice("embedding", 1, 11).cast("array<double>").alias("features"), F.array(F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0)).alias("target"))


@query("WITH e AS (SELECT vec_id, CAST(embedding[1:11] AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT min(list_min(v)) AS a, max(list_max(v)) AS b FROM e) SELECT vec_id AS row_id, round((v[1] - a) / (b - a) * 2 - 1, 6) AS first, round((v[11] - a) / (b - a) * 2 - 1, 6) AS last FROM e, s")
def scale_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = network.rescaled(_vectors(spark, sf_dir), "features", -1.0, 1.0)
    return out.select("row_id", F.round(F.get("features", F.lit(0)), 6).alias("first"), F.round(F.get("features", F.lit(10)), 6).alias("last"))


@query("WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[11] AS DOUBLE) AS b FROM embeddings) SELECT vec_id AS row_id, round((a - (SELECT avg(a) FROM e)) / (SELECT stddev_pop(a) FROM e), 6) AS first, round((b - (SELECT avg(b) FROM e)) / (SELECT stddev_pop(b) FROM e), 6) AS last FROM e")
def scale_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = network.standardised(_vectors(spark, sf_dir), "features")
    return out.select("row_id", F.round(F.get("features", F.lit(0)), 6).alias("first"), F.round(F.get("features", F.lit(10)), 6).alias("last"))


@query("SELECT vec_id AS row_id, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(CAST(embedding[11] AS DOUBLE), 5) AS last FROM embeddings")
def scale_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised by kept parameters and back."""
    rows = _vectors(spark, sf_dir)
    kept = network.scaling(rows, "features")
    back = network.unscaled(network.scaled(F.col("features"), kept, 0.0, 3.0), kept, 0.0, 3.0)
    return rows.select("row_id", back.alias("v")).select("row_id", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.get("v", F.lit(10)), 5).alias("last"))


@query(f"WITH o AS (SELECT ((CASE WHEN label % 2 = 0 THEN 1 ELSE -1 END) - {_forward_sql()}) / 2 AS d FROM embeddings) SELECT round(avg(d * d), 6) AS mse, count(*) FILTER (abs(d) >= 0.35) AS bit_fail FROM o")
def mse_bitfail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.scored(_vectors(spark, sf_dir).withColumn("features", F.slice("features", 1, 5)), _NET)


@query("SELECT vec_id AS row_id, label FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS no FROM embeddings) WHERE no BETWEEN 100 AND 149")
def subset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.rows_between(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label"), "row_id", 100, 50)


@query("SELECT label % 2 = 0 AS even, count(*) AS n FROM (SELECT label FROM embeddings UNION ALL SELECT label FROM embeddings WHERE label % 2 = 0) GROUP BY 1")
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    both = archive.merged_rows(v, v.where(F.get("target", F.lit(0)) > 0))
    return both.groupBy((F.get("target", F.lit(0)) > 0).alias("even")).agg(F.count("*").alias("n"))


@query()
def rprop_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of each of 12 epochs of training on whether a label is even."""
    t = network.Training(epochs=12, error=0.0)
    network.train(network.create([11, 8, 1], seed=5), _vectors(spark, sf_dir), t)
    return spark.createDataFrame([(i, round(float(e), 6)) for i, e in enumerate(t.history)], "epoch long, mse double")
