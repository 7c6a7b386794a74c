"""Pair semantics as column expressions: orientation, fragment length, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The technologies with rules of their own, all others follow the last.
TECHNOLOGIES = ("454", "solid", "illumina_long", "illumina")
#: Mate and pair classes and orientation models in report order.
MATE_CLASSES = ("U", "M", "F", "X")
PAIR_CLASSES = ("UU", "UM", "MM", "UF", "MF", "UX", "MX", "FF", "FX", "XX")
MODELS = ("f1-f2", "f1-r2", "r1-f2", "r1-r2", "f2-f1", "f2-r1", "r2-f1", "r2-r1")


def proper_orientation(technology: str, query_reverse: Column, query_begin: Column, mate_reverse: Column, mate_begin: Column, is_first: Column | None = None) -> Column:
    """Whether two mates lie as the technology demands; equal begins never do."""
    before, after = query_begin < mate_begin, query_begin > mate_begin
    first = F.lit(True) if is_first is None else is_first
    if technology == "454":
        return (query_reverse == mate_reverse) & F.when(query_reverse == first, before).otherwise(after)
    if technology == "solid":
        return (query_reverse == mate_reverse) & F.when(query_reverse == first, after).otherwise(before)
    if technology == "illumina_long":
        return (query_reverse != mate_reverse) & F.when(query_reverse, before).otherwise(after)
    return (query_reverse != mate_reverse) & F.when(query_reverse, after).otherwise(before)


def fragment_length(technology: str, reverse1: Column, begin1: Column, end1: Column, begin2: Column, end2: Column) -> Column:
    """Signed outer length of a pair; negative where the mates stand the wrong way."""
    near, far = end1 - begin2 + 1, end2 - begin1 + 1
    if technology in ("454", "illumina_long"):
        return F.when(reverse1, far).otherwise(near)
    return F.when(reverse1, near).otherwise(far)


def in_window(length: Column, median: Column | int, radius: Column | int) -> Column:
    return F.abs(length).between(F.lit(median) - F.lit(radius), F.lit(median) + F.lit(radius))


def mate_class(n: Column, filtered: Column) -> Column:
    return F.when(n == 1, "U").when(n > 1, "M").when(filtered, "F").otherwise("X")


def pair_class(class1: Column, class2: Column) -> Column:
    """Two mate classes in the order U, M, F, X, whichever mate has which."""
    order = F.lit("".join(MATE_CLASSES))
    swapped = F.position(class1, order) > F.position(class2, order)
    return F.when(swapped, F.concat(class2, class1)).otherwise(F.concat(class1, class2))


def orientation_model(reverse1: Column, begin1: Column, reverse2: Column, begin2: Column) -> Column:
    one, two = F.when(reverse1, "r1").otherwise("f1"), F.when(reverse2, "r2").otherwise("f2")
    return F.when(begin1 <= begin2, F.concat_ws("-", one, two)).otherwise(F.concat_ws("-", two, one))


def search_kind(klass: Column, rescued: Column, proper: Column) -> Column:
    """Local-search class of a UU, UM or MM pair: rescued, else consistent, else null."""
    kind = F.when(rescued, "LocalRescue").when(proper, "localConsistance")
    return F.when(klass.isin("UU", "UM", "MM") & kind.isNotNull(), F.concat_ws("-", klass, kind))


def placed(begin: Column, end: Column, query_begin: Column, query_end: Column, query_length: Column | int, reverse: Column) -> Column:
    """struct(ref_begin, ref_end, query_begin, query_end, query_span) of an alignment, the
    query's positions counted from the read's own start; null where any position is negative."""
    length = F.lit(query_length) if isinstance(query_length, int) else query_length
    own = lambda near, far: F.when(reverse, length - far - 1).otherwise(near)
    out = F.struct(begin.alias("ref_begin"), end.alias("ref_end"), own(query_begin, query_end).alias("query_begin"), own(query_end, query_begin).alias("query_end"), (query_end - query_begin + 1).alias("query_span"))
    return F.when(F.least(begin, end, query_begin, query_end) >= 0, out)
