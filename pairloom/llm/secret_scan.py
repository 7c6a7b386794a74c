"""Secret scans: key patterns, and a randomness test battery for other long tokens.

A token's encoding is inferred from its characters.  Its values in that alphabet are
tested for uniformity (chi-squared), for runs above and below the middle and for serial
correlation; Fisher's method combines the three.  The combined value is uniform for
random tokens and near 0 for others, so by length class the share of random tokens is
read off the upper half, and the threshold is the lowest at which the estimated share of
false discoveries stays within bounds.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, save

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than the minimum can't hold a longer run, so the minimum is in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Tried in turn: pattern, alphabet.
ENCODINGS = ((r"^[0-9a-f]+$", _DIGITS + "abcdef"), (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"), (r"^[A-Z2-7]+=*$", _UPPER + "234567"), (r"^[a-z0-9]+$", _LOWER + _DIGITS), (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS), (r"^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"), (r"", _UPPER + _LOWER + _DIGITS + "+/"))
BINS, FALSE_SHARE = 20, 0.05
CHUNK = 256
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans (start, kind, end) in code points of the matches that `keep` holds for.  The
    matches and what stands between them give the places.  Matches are taken CHUNK by CHUNK,
    as a fold that appends to an array copies it at each step."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(_SPAN)
    chunked = lambda h, g: F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / CHUNK).cast("int")), lambda c: F.zip_with(F.slice(h, c * CHUNK + 1, CHUNK), F.slice(g, c * CHUNK + 1, F.least(F.lit(CHUNK), F.size(h) - c * CHUNK)), lambda x, y: F.struct(x.alias("h"), F.length(y).alias("gap"))))

    def step(a: Column, x: Column) -> Column:
        start, end = a["at"] + x["gap"], a["at"] + x["gap"] + F.length(x["h"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        out = F.array_append(a["out"], span)
        return F.struct(end.alias("at"), (F.when(keep(x["h"]), out).otherwise(a["out"]) if keep else out).alias("out"))

    def bases(chunks: Column) -> Column:
        """Where each chunk begins."""
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        total = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["h"]))
        return F.aggregate(chunks, zero, lambda a, c: F.struct((a["at"] + total(c)).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def spans(chunks: Column) -> Column:
        own = lambda c, base: F.aggregate(c, F.struct(base.alias("at"), empty.alias("out")), step, lambda a: a["out"])
        return F.flatten(F.zip_with(chunks, bases(chunks), own))

    both = F.struct(hits.alias("h"), gaps.alias("g"))
    return F.when(text.rlike(pattern), let(let(both, lambda b: chunked(b["h"], b["g"])), spans)).otherwise(empty)


def _tail(z: Column) -> Column:
    """The normal distribution's upper tail, by a logistic approximation."""
    return 1 / (1 + F.exp(F.least(F.lit(40.0), F.greatest(F.lit(-40.0), 1.5976 * z + 0.07056 * z * z * z))))


def randomness(token: Column) -> Column:
    """Combined value of the three tests for a string of at least 8 characters."""
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(token.rlike(pattern), letters).otherwise(alphabet)

    def tests(x: Column) -> Column:
        v, m, n, s1, s2, kinds = (x[k] for k in ("v", "m", "n", "s1", "s2", "squares"))
        chi = m / n * kinds - n
        z1 = (chi - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
        high = F.transform(v, lambda a: a * 2 > m + 1)
        up = F.size(F.filter(high, lambda a: a)).cast("double")
        runs = 1 + F.size(F.filter(high, lambda a, i: (i > 0) & (a != F.get(high, i - 1)))).cast("double")
        mean = 2 * up * (n - up) / n + 1
        z2 = F.abs(runs - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-6)))
        lagged = F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        spread = F.greatest(s2 - s1 * s1 / n, F.lit(1e-6))
        z3 = F.abs((lagged - s1 * s1 / n) / spread) * F.sqrt(n)
        p = [_tail(z1), 2 * _tail(z2), 2 * _tail(z3)]
        half = -sum((F.log(F.greatest(F.least(q, F.lit(1.0)), F.lit(1e-15))) for q in p[1:]), F.log(F.greatest(p[0], F.lit(1e-15))))
        return F.exp(-half) * (1 + half + half * half / 2)

    def moments(x: Column) -> Column:
        v = x["v"]
        total = lambda f: F.aggregate(v, F.lit(0.0), lambda a, b: a + f(b))
        squares = F.aggregate(F.transform(F.array_distinct(v), lambda d: F.size(F.filter(v, lambda a: a == d)).cast("double")), F.lit(0.0), lambda a, b: a + b * b)
        return F.struct(v.alias("v"), x["m"].alias("m"), F.size(v).cast("double").alias("n"), total(lambda b: b).alias("s1"), total(lambda b: b * b).alias("s2"), squares.alias("squares"))

    def values(alphabet: Column) -> Column:
        body = F.rtrim(token, F.lit("="))
        return F.struct(F.transform(F.split(body, "(?!^)(?!$)"), lambda c: F.position(c, alphabet).cast("double")).alias("v"), F.length(alphabet).cast("double").alias("m"))

    return let(let(let(alphabet, values), moments), tests)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, spans: array of (start, kind, end), kind a
    position in KINDS, ordered by start and kind, in code points, end exclusive.

    Base kinds are the leftmost non-overlapping matches: assign with a value of 6
    characters or more, access keys of 20 or more, lower-case hex of 24 or more.  Kind
    random: runs of 20 or more characters of the base-64 alphabets with a digit and a
    letter that touch no base span and pass the battery.  Null and empty texts have
    none; copies count once each in the estimates; null ids stay; an empty table gives
    no rows; other columns are ignored.
    """
    docs, text = narrow(docs, doc_id=id_col, text=text_col), F.col("text")
    base = F.concat(_found(text, ASSIGN, 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6), _found(text, ACCESS, 1), _found(text, HEX, 2))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.sort_array(base).alias("base"))
    tokens = _found(text, TOKEN, 3, lambda h: h.rlike("[0-9]") & h.rlike("[A-Za-z]"))
    free = F.filter(tokens, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    rows = rows.select("doc_id", "text", "base", free.alias("free"))
    value = lambda t: F.coalesce(randomness(F.substr("text", t["start"] + 1, t["end"] - t["start"])), F.lit(0.0))
    tried = F.transform("free", lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"), F.floor(F.log2((t["end"] - t["start"]).cast("double"))).cast("int").alias("size"), F.least(F.floor(value(t) * BINS), F.lit(BINS - 1)).cast("int").alias("bin")))
    rows = save(rows.select("doc_id", "base", F.when(F.size("free") > 0, tried).alias("tried")), "spans")

    counted: dict[int, list[int]] = {}  # BINS numbers for each power of two that a length has
    for r in rows.select(F.explode("tried").alias("t")).groupBy("t.size", "t.bin").agg(F.count("*").alias("n")).collect():
        counted.setdefault(r["size"], [0] * BINS)[r["bin"]] = r.n
    passed = F.lit(False)
    of = lambda t: passed
    least = {size: threshold(bins) for size, bins in sorted(counted.items())}
    if least:

        def of(t: Column) -> Column:
            limit = F.lit(BINS)
            for size, at in least.items():
                limit = F.when(t["size"] == size, at).otherwise(limit)
            return t["bin"] >= limit

    added = F.transform(F.filter("tried", of), lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    return rows.select("doc_id", F.sort_array(F.concat("base", F.coalesce(added, F.array().cast(_SPAN)))).alias("spans"))


def threshold(bins: list[int]) -> int:
    """The lowest bin from which on at most FALSE_SHARE of the tokens are not random.  Random
    tokens fill all bins alike, so twice the upper half is their number."""
    random = 2 * sum(bins[len(bins) // 2 :])
    for at in range(len(bins) // 2):
        if random * (len(bins) - at) / len(bins) >= (1 - FALSE_SHARE) * sum(bins[at:]):
            return at
    return len(bins) // 2


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as a string) of scan's rows."""
    name = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
