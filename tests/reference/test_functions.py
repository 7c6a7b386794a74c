import pytest
from pyspark.sql import functions as F

from pairloom.functions import pairs as P
from pairloom.functions import scores as S
from pairloom.functions import text as T


@pytest.mark.parametrize("technology, same, first_reverse_before", [("454", True, True), ("solid", True, False), ("illumina_long", False, True), ("illumina", False, False)])
def test_orientation_table(spark, technology, same, first_reverse_before):
    cases = [(r1, r2, b, first) for r1 in (True, False) for r2 in (True, False) for b in (-1, 0, 1) for first in (True, False)]
    df = spark.createDataFrame(cases, "r1 boolean, r2 boolean, b int, first boolean")
    c = F.col
    for r in df.select("*", P.proper_orientation(technology, c("r1"), c("b"), c("r2"), F.lit(0), c("first")).alias("p")).collect():
        reverse = r.r1 if not same or r["first"] else not r.r1
        want = (r.r1 == r.r2) == same and r.b != 0 and (r.b < 0) == (reverse == first_reverse_before)
        assert r.p == want


def test_edit_strings(spark):
    rows = [("ACGT", "ACGT"), ("A-C", "GTC"), ("AC--GT", "ACTTGT"), ("ACGTA", "A--TA"), ("ZZACG", "TTACG"), ("", ""), ("ACG", "A-T"), ("AC", "TT")]
    df = spark.createDataFrame(rows, "r string, q string").coalesce(1)
    r, q = F.col("r"), F.col("q")
    ops = T.operations(r, q)
    got = df.select(T.cigar(ops).alias("c"), T.md_tag(r, q).alias("m"), T.cigar_equal_different(r, q).alias("x"), T.cigar_packed(ops).alias("p")).collect()
    assert [x.c for x in got] == ["4M", "1M1I1M", "2M2I2M", "1M2D2M", "2S3M", "", "1M1D1M", "2M"]
    assert [x.m for x in got] == ["4", "0A1", "4", "1^CG2", "3", "", "1^C0G", "0A0C"]
    assert [x.x.mismatches for x in got] == [0, 2, 2, 2, 0, 0, 2, 2]
    assert list(got[1].p) == [16, 17, 16]
    clipped = df.limit(1).select(T.cigar(T.operations(r, q, F.lit(3), F.lit(0))).alias("c")).first().c
    assert clipped == "3S4M"
    back = df.where("r not like '%Z%' and r <> ''").select("r", "q", T.gapped(T.without_gaps(r), T.without_gaps(q), ops).alias("g")).collect()
    assert all((x.r, x.q) == tuple(x.g) for x in back)


def test_phred_edges(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,), (0.8,), (0.998,), (0.0,)], "y double").coalesce(1)
    assert [r[0] for r in df.select(S.phred(F.col("y"))).collect()] == [255, 0, 10, 30, 3]
    assert [r[0] for r in df.select(S.phred(F.col("y"), strict=True)).collect()] == [0, 255, 10, 30, 3]


def test_tags_and_numbers(spark):
    row = spark.range(1).select(T.zn_fields(F.lit("ZN:Z:1.5;2;x;0.25;7")).alias("z"), T.xc_fields(F.lit("XC:Z:chr1;-5")).alias("x"), T.lenient_number(F.lit("12.5abc")).alias("n"), T.lenient_number(F.lit("abc")).alias("none"), T.base_codes(F.lit("AcgTuN-é")).alias("b")).first()
    assert tuple(row.z) == (1.5, 2.0, None, 0.25, 7, None) and tuple(row.x) == ("chr1", -5) and row.n == 12.5 and row.none is None and row.b == "01230444"
    with pytest.raises(Exception, match="longer"):
        spark.range(1).select(T.checked_length(F.lit("x" * 1025))).collect()


def test_values_of_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(T.flags(paired=F.lit(True), unmapped=F.lit(False), mate_reverse=F.lit(None).cast("boolean"), second=F.lit(True))) == 129
    assert tuple(value(P.placed(F.lit(5), F.lit(9), F.lit(2), F.lit(6), 20, F.lit(True)))) == (5, 9, 13, 17, 5)
    assert tuple(value(P.placed(F.lit(5), F.lit(9), F.lit(2), F.lit(6), 20, F.lit(False)))) == (5, 9, 2, 6, 5)
    assert value(P.placed(F.lit(5), F.lit(9), F.lit(-1), F.lit(6), 20, F.lit(False))) is None
    assert value(T.typed(F.lit('{"a": 3}'), "$.a", "long")) == 3 and value(T.typed(F.lit('{"a": "x"}'), "$.a", "long")) is None
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST"):
        value(T.typed(F.lit('{"a": "x"}'), "$.a", "long", strict=True))
    assert tuple(value(T.unpack_operation(T.pack_operation(F.lit("D"), F.lit(300))))) == ("D", 300)
    za = T.za_part(F.lit(True), F.lit(37), F.lit("sp"), F.lit(2), F.lit("4M"), F.lit("4"), F.lit(False))
    assert value(za) == "<@;37;;sp;2;4M;4>"
