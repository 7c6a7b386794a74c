"""Quality rules by weak supervision.

Each rule votes for a document, against it, strongly against it, or abstains.
Expectation-maximisation over the counts of vote patterns (at most 4 ** rules of them,
whatever the corpus) estimates how each rule votes on good and on bad documents, and the
posterior probability of being good replaces the demand that all rules pass: a vote
against counts for as much as the rule's estimates say.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, save

_SPACE = r"[\x20\x09-\x0D]+"
#: Votes: strongly against, against, abstention, for.
LEVELS = (-2, -1, 0, 1)
#: Rules that decide which of the two classes is the good one.
TRUSTED = ("few_symbols", "few_repeats", "mostly_letters")
#: Presumed chances of the levels on good and on bad documents, for trusted rules and others, ...
TRUST = (0.002, 0.008, 0.14, 0.85), (0.4, 0.3, 0.15, 0.15)
BELIEF = (0.005, 0.015, 0.2, 0.78), (0.15, 0.2, 0.25, 0.4)
#: ... which weigh as much as this share of all documents.
WEIGHT = 0.002
#: Presumed share of good documents, and the score of votes from which a document starts as good.
GOOD, START = 0.9, 3
_BLANK = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs other than space and 0x09-0x0D; none for null."""
    inner = F.btrim(text, F.lit(_BLANK))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACE))


def _windows(w: Column) -> Column:
    """The hash of every 3-word window; none where no two can be equal."""
    at = F.sequence(F.lit(0), F.size(w) - 3)
    windows = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.array().cast("array<bigint>")).otherwise(windows)


def _hits(placed: Column) -> Column:
    """Ascending positions whose hash repeats, of structs (h, i) sorted by h."""
    same = lambda x, j: (F.get(placed, j - 1)["h"] == x["h"]) | (F.get(placed, j + 1)["h"] == x["h"])
    hit = F.filter(placed, lambda x, j: F.coalesce(same(x, j), F.lit(False)))
    return F.sort_array(F.transform(hit, lambda x: x["i"]))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, carried if docs has it, and the counts the rules use, for rows doc_id, text."""
    text, w = F.coalesce("text", F.lit("")), F.col("w")
    own = [c for c in docs.columns if c != "text"]
    rows = docs.select(*own, text.alias("text")).select(*own, "text", words(F.col("text")).alias("w"))
    rows = rows.withColumn("t", _windows(w))
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *own,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        # only texts with a repeated window go on
        F.when(F.size(F.array_distinct("t")) < F.size("t"), F.sort_array(F.transform("t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("placed"),
    )
    hit = _hits(F.col("placed"))
    union = F.aggregate(hit, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return rows.select(*own, "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(union, F.lit(0)).cast("long").alias("n_repeat_words"), "n_upper", "n_letters", "n_exclaim", "n_distinct")


def votes() -> dict[str, Column]:
    """By rule: 1 for, -1 against, -2 strongly against, 0 no vote."""
    n, c = F.col("n_words"), F.col

    def vote(good: Column, bad: Column, worse: Column) -> Column:
        return F.when(n == 0, 0).when(worse, -2).when(bad, -1).when(good, 1).otherwise(0)

    def share(part: str, of: str, good: int, bad: int, worse: int) -> Column:
        return vote(c(part) * 100 <= good * c(of), c(part) * 100 > bad * c(of), c(part) * 100 > worse * c(of))

    return {
        "long_enough": vote(n >= 100, n < 50, n < 10),
        "few_symbols": share("n_symbols", "n_words", 2, 10, 25),
        "few_repeats": share("n_repeat_words", "n_words", 15, 30, 50),
        "distinct_lines": vote((c("n_lines") >= 3) & (c("n_dup_lines") == 0), c("n_dup_lines") * 100 > 30 * c("n_lines"), c("n_dup_lines") * 100 > 60 * c("n_lines")),
        "word_length": vote(c("word_chars").between(4 * n, 7 * n), ~c("word_chars").between(3 * n, 10 * n), ~c("word_chars").between(2 * n, 15 * n)),
        "lower_case": share("n_upper", "word_chars", 10, 25, 50),
        "mostly_letters": vote(c("n_letters") * 100 >= 96 * c("word_chars"), c("n_letters") * 100 < 89 * c("word_chars"), c("n_letters") * 100 < 75 * c("word_chars")),
        "calm": share("n_exclaim", "n_words", 5, 25, 50),
        "rich_words": vote(c("n_distinct") * 100 >= 45 * n, (n >= 50) & (c("n_distinct") * 100 < 15 * n), (n >= 50) & (c("n_distinct") * 100 < 8 * n)),
    }


Tables = list[tuple[dict[int, float], dict[int, float]]]


def posterior(prior: float, tables: Tables, pattern: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(good[v] / bad[v]) for (good, bad), v in zip(tables, pattern))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: list[str], rounds: int = 1000) -> tuple[float, Tables]:
    """(prior of good, by rule the chances of its levels on good and on bad documents), the
    maximum a posteriori by expectation-maximisation over counted vote patterns.

    Documents start by their votes' sum, in which trusted rules count twice, so one vote
    against doesn't make a document bad.  Then every rule's chances on both classes follow
    from the documents alone but for the presumed ones, which weigh WEIGHT of all documents
    and bound all odds; no chance is held to a limit."""
    if not patterns:
        return GOOD, []
    total = sum(n for _, n in patterns)
    weight = WEIGHT * total
    trusted = [r in TRUSTED for r in rules]
    good = [1 / (1 + math.exp(START - sum(v + v * t for v, t in zip(p, trusted)))) for p, _ in patterns]
    prior, tables = GOOD, []
    for _ in range(rounds):
        mass = sum(g * n for g, (_, n) in zip(good, patterns))
        prior = (mass + GOOD * weight) / (total + weight)
        sums = [tuple({v: weight * q for v, q in zip(LEVELS, presumed)} for presumed in (TRUST if t else BELIEF)) for t in trusted]
        for g, (p, n) in zip(good, patterns):
            for (a, b), v in zip(sums, p):
                a[v] += g * n
                b[v] += (1 - g) * n
        tables = [({v: x / (mass + weight) for v, x in a.items()}, {v: x / (total - mass + weight) for v, x in b.items()}) for a, b in sums]
        new = [posterior(prior, tables, p) for p, _ in patterns]
        moved = max(abs(a - b) for a, b in zip(good, new))
        good = new
        if moved < 1e-9:
            break
    return prior, tables


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, quality (the posterior) and, if columns are to be
    carried along, their struct carried.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows.
    kept: not base_failed, and quality at least the threshold.  Null, empty and blank
    texts have no words and fail.  Every row counts once in the estimates, copies too; a
    null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    stats = save(statistics(narrow(docs, carry, doc_id=id_col, text=text_col)), "statistics")
    rules = votes()
    named = stats.select("*", *[v.alias(f"vote_{r}") for r, v in rules.items()])
    columns = [f"vote_{r}" for r in rules]
    counted = named.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(*columns).collect()  # 4 ** rules rows at most
    prior, tables = fit([(tuple(r[c] for c in columns), r.n) for r in counted], list(rules))
    odds = F.lit(math.log(prior / (1 - prior)))
    for column, (good, bad) in zip(columns, tables):
        by = F.when(F.col(column) == 1, math.log(good[1] / bad[1]))
        for v in (-1, -2):
            by = by.when(F.col(column) == v, math.log(good[v] / bad[v]))
        odds = odds + by.otherwise(math.log(good[0] / bad[0]))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    quality = 1 / (1 + F.exp(-odds))
    return named.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"), F.round(quality, 6).alias("quality"), *["carried"] * bool(carry))
