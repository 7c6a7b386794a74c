"""Counters, bounded histograms with moments, and the class report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import MATE_CLASSES, MODELS, PAIR_CLASSES, fragment_length, mate_class, orientation_model, pair_class, proper_orientation, search_kind

#: Local-search classes in report order.
SEARCH = tuple(f"{c}-{k}" for k in ("LocalRescue", "localConsistance") for c in ("UU", "UM", "MM"))


def mates(aln: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row a read: for each mate the number of unfiltered alignments (n1, n2), whether
    any was filtered (f1, f2), and its first unfiltered alignment (a1, a2).  names adds
    reads without alignments.  One shuffle, with partial aggregates."""
    place = F.struct("ref_index", "ref_begin", "ref_end", "is_rev", "map_len", "sw", "quality")
    free = ~F.col("is_filtered")
    per = []
    for m in (1, 2):
        mine = F.col("mate") == m
        per += [F.count_if(mine & free).alias(f"n{m}"), F.coalesce(F.bool_or(mine & ~free), F.lit(False)).alias(f"f{m}"), F.min(F.when(mine & free, place)).alias(f"a{m}")]
    rows = aln.groupBy("name").agg(*per)
    if names is None:
        return rows
    both = names.select("name").join(rows, "name", "left")
    return both.select("name", *[F.coalesce(c, F.lit(0).cast("long") if c[0] == "n" else F.lit(False)).alias(c) if c[0] in "nf" else F.col(c) for c in ("n1", "f1", "a1", "n2", "f2", "a2")])


def classified(rows: DataFrame, technology: str = "illumina") -> DataFrame:
    """mates() with class1, class2, pair_class, proper, model and fragment (the last three
    where both mates have an alignment on one reference)."""
    a, b = F.col("a1"), F.col("a2")
    together = a["ref_index"] == b["ref_index"]
    out = rows.withColumn("class1", mate_class(F.col("n1"), F.col("f1"))).withColumn("class2", mate_class(F.col("n2"), F.col("f2")))
    proper = together & proper_orientation(technology, a["is_rev"], a["ref_begin"], b["is_rev"], b["ref_begin"])
    return out.withColumns(
        {
            "pair_class": pair_class(F.col("class1"), F.col("class2")),
            "proper": F.coalesce(proper, F.lit(False)),
            "model": F.when(together, orientation_model(a["is_rev"], a["ref_begin"], b["is_rev"], b["ref_begin"])),
            "fragment": F.when(together, fragment_length(technology, a["is_rev"], a["ref_begin"], a["ref_end"], b["ref_begin"], b["ref_end"])),
        }
    )


def counted(rows: DataFrame, label: Column, domain: tuple[str, ...]) -> DataFrame:
    """bin, label, n, cum for every label of the domain in order, zeros included.  The
    window runs over the domain's rows only."""
    spark = rows.sparkSession
    all_labels = spark.createDataFrame(list(enumerate(domain, 1)), "bin long, label string")
    n = rows.select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    out = all_labels.join(n, "label", "left").select("bin", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("cum", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def class_counts(rows: DataFrame, kind: str) -> DataFrame:
    """counted() of mates (MC), pairs (RC), local search (LS) or orientation (OC); the last
    counts uniquely aligned pairs only.  rescued is a column where rows have it."""
    if kind == "MC":
        return counted(rows.select(F.explode(F.array("class1", "class2")).alias("c")), F.col("c"), MATE_CLASSES)
    if kind == "RC":
        return counted(rows, F.col("pair_class"), PAIR_CLASSES)
    if kind == "LS":
        rescued = F.col("rescued") if "rescued" in rows.columns else F.lit(False)
        return counted(rows, search_kind(F.col("pair_class"), rescued, F.col("proper")), SEARCH)
    return counted(rows.where("pair_class = 'UU'"), F.col("model"), MODELS)


def histogram(rows: DataFrame, value: Column, low: int, bins: int) -> DataFrame:
    """bin, x, n, cum of the non-empty bins of [low, low + bins); cum starts with what lies
    below, and what lies above is in no bin.  Windows run over bins only."""
    values = rows.select(value.cast("long").alias("x")).where("x is not null")
    n = values.groupBy(F.greatest("x", F.lit(low - 1)).alias("x")).agg(F.count("*").alias("n")).where(F.col("x") < low + bins)
    cum = F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    out = n.select("x", "n", cum.alias("cum")).where(F.col("x") >= low)
    return out.select((F.col("x") - low).cast("long").alias("bin"), "x", "n", "cum")


def moments(rows: DataFrame, value: Column, low: int, bins: int) -> DataFrame:
    """One row: tot, mean, std (population, both of what is in range), in_range, over, under."""
    x = value.cast("long")
    inside = x.between(low, low + bins - 1)
    return rows.agg(
        F.count(x).alias("tot"),
        F.round(F.avg(F.when(inside, x)), 6).alias("mean"),
        F.round(F.stddev_pop(F.when(inside, x)), 6).alias("std"),
        F.count_if(inside).alias("in_range"),
        F.count_if(x >= low + bins).alias("over"),
        F.count_if(x < low).alias("under"),
    )


#: Fixed values of the report: section, first bin, number of bins.
SECTIONS = {"LF": (-99, 10_000), "LR": (0, 1000), "NA": (0, 5000), "MQ": (0, 256), "MM": (0, 100)}


def long_values(aln: DataFrame, rows: DataFrame) -> DataFrame:
    """section, x (a number) or label (a class) of everything that the report counts: one scan
    of the alignments and one of the reads."""
    pick = lambda section, x=None, label=None: F.struct(F.lit(section).alias("section"), (F.lit(None) if x is None else x).cast("long").alias("x"), (F.lit(None) if label is None else label).cast("string").alias("label"))
    c = F.col
    rescued = c("rescued") if "rescued" in rows.columns else F.lit(False)
    unique = c("pair_class") == "UU"
    own = [pick("LF", F.when(unique, c("fragment"))), *[pick("NA", F.when(c(n) > 0, c(n))) for n in ("n1", "n2")], *[pick("MC", label=c(n)) for n in ("class1", "class2")]]
    own += [pick("RC", label=c("pair_class")), pick("LS", label=search_kind(c("pair_class"), rescued, c("proper"))), pick("OC", label=F.when(unique, c("model")))]
    each = [pick("LR", c("map_len")), pick("MQ", c("quality")), pick("MM", c("mismatches"))]
    both = aln.where(~c("is_filtered")).select(F.explode(F.array(*each)).alias("v")).union(rows.select(F.explode(F.array(*own)).alias("v")))
    return both.select("v.*").where("x is not null or label is not null")


def _bounds(sections: dict[str, tuple[int, int]], i: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for name, b in sections.items() for v in (name, b[i])]), F.col("section"))


def report(aln: DataFrame, rows: DataFrame) -> DataFrame:
    """The statistics report in long form: section, bin, x, n, cum, label.  Windows run over
    the bins of one section."""
    domains = {"MC": MATE_CLASSES, "RC": PAIR_CLASSES, "LS": SEARCH, "OC": MODELS}
    low, bins = _bounds(SECTIONS, 0), _bounds(SECTIONS, 1)
    n = long_values(aln, rows).groupBy("section", F.when(F.col("x") < low, low - 1).otherwise(F.col("x")).cast("long").alias("x"), "label").agg(F.count("*").alias("n"))
    labels = rows.sparkSession.createDataFrame([(k, i, x) for k, d in domains.items() for i, x in enumerate(d, 1)], "section string, bin long, label string")
    classes = labels.join(n.where("label is not null").drop("x"), ["section", "label"], "left").select("section", "bin", F.col("bin").alias("x"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "label")
    numbers = n.where(F.col("x") < low + bins).select("section", (F.col("x") - low).cast("long").alias("bin"), "x", "n", F.col("x").cast("string").alias("label"))
    cum = F.sum("n").over(Window.partitionBy("section").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return numbers.union(classes).withColumn("cum", cum).where("bin >= 0").select("section", "bin", "x", "n", "cum", "label")


def all_moments(aln: DataFrame, rows: DataFrame, sections: dict[str, tuple[int, int]]) -> DataFrame:
    """moments() of every numeric section at once."""
    low, bins = _bounds(sections, 0), _bounds(sections, 1)
    x = F.col("x")
    values = long_values(aln, rows).where(F.col("section").isin(*sections)).select("section", "x", low.alias("low"), (low + bins).alias("high"))
    inside = (x >= F.col("low")) & (x < F.col("high"))
    found = values.groupBy("section").agg(
        F.count("x").alias("tot"),
        F.round(F.avg(F.when(inside, x)), 6).alias("mean"),
        F.round(F.stddev_pop(F.when(inside, x)), 6).alias("std"),
        F.count_if(inside).alias("in_range"),
        F.count_if(x >= F.col("high")).alias("over"),
        F.count_if(x < F.col("low")).alias("under"),
    )
    names = rows.sparkSession.createDataFrame([(k,) for k in sections], "section string")
    return names.join(found, "section", "left").fillna(0, ["tot", "in_range", "over", "under"])


def header_lines(groups: DataFrame) -> DataFrame:
    """@RG lines from id, sample, library, description, platform_unit, median_fragment,
    center, technology; empty fields are left out, the sample is `unknown`."""
    given = lambda tag, c: F.when(F.col(c) != "", F.concat(F.lit(f"{tag}:"), F.col(c)))
    sample = F.concat(F.lit("SM:"), F.coalesce(F.nullif("sample", F.lit("")), F.lit("unknown")))
    parts = [F.lit("@RG"), F.concat(F.lit("ID:"), F.col("id")), sample, given("LB", "library"), given("DS", "description"), given("PU", "platform_unit"), F.concat(F.lit("PI:"), F.col("median_fragment").cast("string")), given("CN", "center"), F.concat(F.lit("PL:"), F.coalesce(F.nullif("technology", F.lit("")), F.lit("unknown")))]
    return groups.select("id", F.concat_ws("\t", *parts).alias("line"))
