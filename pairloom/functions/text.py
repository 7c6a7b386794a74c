"""Sequence and tag functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operation codes of packed edit strings and record flag bits.
OPERATIONS = "MIDNSHP=X"
FLAGS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "failed": 512, "duplicate": 1024}


def has_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(FLAGS[name]) != 0


def flags(**given: Column) -> Column:
    """The flag bits of a record from booleans by name; nulls count as false."""
    return sum((F.when(c, FLAGS[name]).otherwise(0) for name, c in given.items()), F.lit(0)).cast("long")


def without_gaps(bases: Column) -> Column:
    return F.translate(bases, "-", "")


def base_codes(bases: Column) -> Column:
    """Digits 0-3 for A, C, G, T and 4 for all else, U being an A, as one string."""
    return F.translate(F.regexp_replace(bases, "[^ACGTUacgtu]", "N"), "ACGTUacgtuN", "01230012304")


def pack_operation(op: Column, length: Column) -> Column:
    """length << 4 | code."""
    code = F.position(op, F.lit(OPERATIONS)).cast("int") - 1
    return F.shiftleft(length.cast("int"), 4).bitwiseOR(code)


def unpack_operation(packed: Column) -> Column:
    return F.struct(F.substring(F.lit(OPERATIONS), packed.bitwiseAND(15) + 1, F.lit(1)).alias("op"), F.shiftrightunsigned(packed, 4).alias("len"))


def _steps(reference: Column, query: Column) -> Column:
    letters = lambda s: F.split(s, r"(?!^)(?!\z)")
    return F.zip_with(letters(reference), letters(query), lambda r, q: F.struct(r.alias("r"), q.alias("q")))


def operations(reference: Column, query: Column, lead_clip: Column | None = None, lag_clip: Column | None = None) -> Column:
    """The edit string of a gapped pair as array<struct<op,len>>: `Z` in the reference
    is clipped (S), `-` there inserted (I), `-` in the query deleted (D), else M."""
    kind = lambda x: F.when(x["r"] == "Z", "S").when(x["r"] == "-", "I").when(x["q"] == "-", "D").otherwise("M")
    empty = F.array().cast("array<struct<op:string,len:int>>")
    marks = F.array_join(F.transform(_steps(reference, query), kind), "")
    found = F.regexp_extract_all(marks, F.lit("(S+|I+|D+|M+)"), F.lit(1))
    runs = F.when(F.length(reference) == 0, empty).otherwise(F.transform(found, lambda r: F.struct(F.substring(r, 1, 1).alias("op"), F.length(r).alias("len"))))
    clip = lambda n: F.when(n > 0, F.array(F.struct(F.lit("S").alias("op"), n.cast("int").alias("len")))).otherwise(empty)
    clips = [[] if n is None else [clip(n)] for n in (lead_clip, lag_clip)]
    return F.concat(*clips[0], runs, *clips[1])


def cigar(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def cigar_packed(ops: Column) -> Column:
    return F.transform(ops, lambda x: pack_operation(x["op"], x["len"]))


def cigar_equal_different(reference: Column, query: Column) -> Column:
    """struct(cigar, mismatches): M split into = and X; inserted and deleted letters count."""
    kind = lambda x: F.when(x["r"] == "Z", "S").when(x["r"] == "-", "I").when(x["q"] == "-", "D").when(x["r"] == x["q"], "=").otherwise("X")
    marks = F.array_join(F.transform(_steps(reference, query), kind), "")
    runs = F.regexp_extract_all(marks, F.lit(r"(S+|I+|D+|=+|X+)"), F.lit(1))
    text = F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")
    return F.struct(text.alias("cigar"), F.length(F.regexp_replace(marks, "[S=]", "")).alias("mismatches"))


def md_tag(reference: Column, query: Column) -> Column:
    """Matched runs as numbers, mismatched reference letters, deletions after ^; an
    insertion neither counts nor breaks a run; a mismatch or deletion that doesn't follow
    a number gets a 0 before a mismatch; no closing 0."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("run"), F.lit("").alias("was"))

    def step(a: Column, x: Column) -> Column:
        skipped, match = (x["r"] == "Z") | (x["r"] == "-"), x["r"] == x["q"]
        number = F.when(a["run"] > 0, a["run"].cast("string")).otherwise("")
        deleted = F.concat(a["out"], number, F.when((a["was"] == "D") & (a["run"] == 0), "").otherwise("^"), x["r"])
        changed = F.concat(a["out"], F.when(a["run"] > 0, number).otherwise("0"), x["r"])
        put = lambda out, run, was: F.struct(out.alias("out"), run.alias("run"), was.alias("was"))
        return (
            F.when(skipped, put(a["out"], a["run"], a["was"]))
            .when(match, put(a["out"], a["run"] + 1, F.lit("M")))
            .when(x["q"] == "-", put(deleted, F.lit(0), F.lit("D")))
            .otherwise(put(changed, F.lit(0), F.lit("X")))
        )

    done = lambda a: F.concat(a["out"], F.when(a["run"] > 0, a["run"].cast("string")).otherwise(""))
    return F.when(F.length(reference) == 0, "").otherwise(F.aggregate(_steps(reference, query), zero, step, done))


def za_part(own: Column, quality: Column, special: Column, n_mapped: Column, cigar_text: Column, md: Column, bare: Column) -> Column:
    """One mate's part of a ZA tag; bare parts, the read's own or an unmapped mate's, have
    no edit strings."""
    head = F.concat_ws(";", F.when(own, "@").otherwise("&"), quality.cast("string"), F.lit(""), F.coalesce(special, F.lit("")), n_mapped.cast("string"))
    return F.concat(F.lit("<"), head, F.lit(";"), F.when(bare, F.lit(";")).otherwise(F.concat_ws(";", cigar_text, md)), F.lit(">"))


def gapped(reference: Column, query: Column, ops: Column) -> Column:
    """struct(reference, query) with gaps from an edit string over plain sequences: M
    copies both, I pads the reference, D the query, S is skipped."""
    zero = F.struct(F.lit("").alias("reference"), F.lit("").alias("query"), F.lit(1).alias("r"), F.lit(1).alias("q"))

    def step(a: Column, x: Column) -> Column:
        n, both = x["len"], x["op"].isin("M", "=", "X")
        ref, own, pad = F.substr(reference, a["r"], n), F.substr(query, a["q"], n), F.repeat(F.lit("-"), n)
        return F.struct(
            F.concat(a["reference"], F.when(both | (x["op"] == "D"), ref).when(x["op"] == "I", pad).otherwise("")).alias("reference"),
            F.concat(a["query"], F.when(both | (x["op"] == "I"), own).when(x["op"] == "D", pad).otherwise("")).alias("query"),
            (a["r"] + F.when(both | (x["op"] == "D"), n).otherwise(0)).alias("r"),
            (a["q"] + F.when(both | (x["op"] == "I"), n).otherwise(0)).alias("q"),
        )

    return F.aggregate(ops, zero, step, lambda a: F.struct(a["reference"].alias("reference"), a["query"].alias("query")))


def zn_fields(zn: Column) -> Column:
    """best;next;longest;entropy;num_mappings;num_hashes."""
    parts = F.split(F.regexp_replace(zn, "^ZN:Z:", ""), ";")
    names = (("best", "double"), ("next", "double"), ("longest", "double"), ("entropy", "double"), ("n_mappings", "long"), ("n_hashes", "long"))
    return F.struct(*[F.get(parts, F.lit(i)).try_cast(kind).alias(n) for i, (n, kind) in enumerate(names)])


def xc_fields(xc: Column) -> Column:
    found = lambda i: F.regexp_extract(xc, r"^XC:Z:([^;]*);(-?\d+)", i)
    return F.struct(found(1).alias("chr"), found(2).try_cast("long").alias("pos"))


def position_correct(chr1: Column, pos1: Column, chr2: Column, pos2: Column, tolerance: int = 20) -> Column:
    return (chr1 == chr2) & (F.abs(pos1 - pos2) < tolerance)


def lenient_number(s: Column) -> Column:
    """The longest numeric prefix, else null; the strict form is try_cast."""
    return F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def checked_length(s: Column, most: int = 1024) -> Column:
    """s, or an error where it is longer than the format holds."""
    return F.when(F.length(s) > most, F.raise_error(F.concat(F.lit("longer than the format holds: "), F.substring(s, 1, 40)))).otherwise(s)


def typed(value: Column, path: str, kind: str, strict: bool = False) -> Column:
    """The value of a kind at a path of a JSON text; where it is of another kind null or, if
    strict, an error."""
    return (F.variant_get if strict else F.try_variant_get)(F.parse_json(value), path, kind)
