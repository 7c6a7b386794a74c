"""URL filters: prefix rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models are counted over all URLs that the rules
allow and block.  The probability of a character is interpolated over orders 0 to ORDER
with Witten-Bell weights.  A URL that no rule fits is judged by the difference of
its log-likelihoods, divided by its length.  The threshold is calibrated on the URLs with
a verdict, each scored by models that were counted without its half of all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, save

ORDER, ALPHABET = 4, 256
#: The calibration counts scores in bins of 1 / STEPS, clipped at +-WIDEST.
STEPS, WIDEST = 1000, 10.0
#: Grams with at least this share of all characters are joined apart, by broadcast: 1 / HOT_SHARE of them at most.
HOT_SHARE = 1e-3
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(raw, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does.  A rule fits its
    host and all subdomains where the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, f"{name}{prefix}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """Each character with the ORDER before it; the text is padded in front."""
    padded = F.concat(F.lit("\u0002" * ORDER), text, F.lit("\u0003"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(ORDER + 1)))


def models(grams: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """From rows (gram, and for each kind of model good_<kind> and bad_<kind>, how often the
    gram is in accepted and in rejected URLs) the log ratio of the gram's last character:
    rows (gram, llr_<kind> ...).

    For each order k the last k characters before it are the context.  A class without
    any URL gives uniform probabilities.  All orders are counted and joined at once."""
    sides = [f"{side}_{kind}" for kind in kinds for side in ("good", "bad")]
    tails_of = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.substr("gram", F.lit(ORDER + 1 - k)).alias("tail")) for k in range(ORDER + 1)])).alias("t")
    tails = grams.select(*sides, tails_of).groupBy("t.k", "t.tail").agg(*[F.sum(s).alias(s) for s in sides])
    tails = save(tails.withColumn("context", F.substr("tail", F.lit(1), F.col("k"))), "tails")
    contexts = tails.groupBy("k", "context").agg(*[f(s).alias(f"{s}_{o}") for s in sides for o, f in (("all", F.sum), ("kinds", lambda s: F.count_if(F.col(s) > 0)))])
    known = tails.join(contexts, ["k", "context"])
    known = save(known.select("k", "tail", *[F.struct(F.col(s).alias("n"), F.col(f"{s}_all").alias("all"), F.col(f"{s}_kinds").alias("kinds")).alias(s) for s in sides]), "known")
    steps = grams.select("gram", tails_of).select("gram", "t.*").join(known, ["k", "tail"])
    steps = steps.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", *sides))).alias("steps"))  # one for each order

    def chance(side: str) -> Column:
        smooth = lambda p, x: F.when(x["all"] > 0, (x["n"] + x["kinds"] * p) / (x["all"] + x["kinds"])).otherwise(p)
        return F.log(F.aggregate("steps", F.lit(1 / ALPHABET), lambda p, x: smooth(p, x[side])))

    return steps.select("gram", *[(chance(f"good_{kind}") - chance(f"bad_{kind}")).alias(f"llr_{kind}") for kind in kinds])


def threshold_of(counts: list[tuple[int, str, int]]) -> float | None:
    """From (score in STEPS of a whole, verdict, pages) the score at which the shares of
    allowed pages below and of blocked pages from there on are least together, the middle one
    if there are several; None where a class is empty."""
    totals = {v: sum(n for _, w, n in counts if w == v) for v in ("allow", "block")}
    if not all(totals.values()):
        return None
    by: dict[int, dict[str, int]] = {}
    for at, verdict, n in counts:
        by.setdefault(at, {"allow": 0, "block": 0})[verdict] += n
    below = {"allow": 0, "block": 0}
    errors = []
    for at in sorted(by):
        errors.append((below["allow"] / totals["allow"] + 1 - below["block"] / totals["block"], at))
        for v, n in by[at].items():
            below[v] += n
    errors.append((1.0, max(by) + 1))
    least = min(e for e, _ in errors)
    first = next(i for i, (e, _) in enumerate(errors) if e == least)
    low = errors[first - 1][1] + 1 if first else errors[0][1]
    return (low + errors[first][1]) / 2 / STEPS


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, score.

    host and path are empty for a null url or one without "://".  rule is the longest rule
    that fits, such as "net/", else null, and its verdict holds.  Else the method's: score is
    the mean log-likelihood ratio of the host and path's characters between the models of
    allowed and blocked URLs; `allow` from the threshold on.  The threshold is that with the
    least sum of both classes' shares of wrong verdicts over all pages with a rule, whose
    scores come from models of the other half of the names.  Where either class is empty, and
    for an empty host and path, the verdict is allow.  Equal URLs get equal rows; null ids
    stay; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    pages = narrow(pages, page_id=id_col, url=url_col)
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    keyed = parts.select("page_id", "host", "path", "rule", "ruled", F.concat("host", "path").alias("name"))
    # a name is scored once, however many pages have it
    names = save(keyed.groupBy("name", "ruled").agg(F.count("*").alias("n")), "names")
    half = F.pmod(F.xxhash64("name"), F.lit(2))
    # short rows that become long: as many partitions as a shuffle has, however small the names are
    own = names.where("name <> ''").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    spelled = own.select("name", half.alias("half"), "ruled", "n", F.explode(_grams(F.col("name"))).alias("gram"))
    uses = lambda v, on: F.sum(F.when((F.col("ruled") == v) & on, F.col("n")).otherwise(0))
    # the models of half 0 are counted over half 1, and the other way round
    kinds = {"all": F.lit(True), "0": F.col("half") == 1, "1": F.col("half") == 0}
    counted = [uses(v, on).alias(f"{side}_{kind}") for kind, on in kinds.items() for side, v in (("good", "allow"), ("bad", "block"))]
    grams = save(spelled.groupBy("gram").agg(F.count("*").alias("uses"), *counted), "grams")
    ratios = save(models(grams, tuple(kinds)).join(grams.select("gram", "uses"), "gram"), "ratios")
    total = grams.agg(F.sum("uses")).first()[0] or 0
    is_hot = F.col("uses") >= HOT_SHARE * total
    values = ["llr_all", "llr_0", "llr_1"]
    # hot grams are 1 / HOT_SHARE at most; the rest and the scores grow with the input
    hot = ratios.where(is_hot).select("gram", F.struct(*values).alias("hot"))
    cold = ratios.where(~is_hot).select("gram", *values)
    ready = spelled.select("name", "half", "gram").join(F.broadcast(hot), "gram", "left")
    value = ready.where("hot is not null").select("name", "half", "hot.*")
    value = value.unionByName(ready.where("hot is null").join(cold, "gram").select("name", "half", *values))
    held_out = F.avg(F.when(F.col("half") == 0, F.col("llr_0")).otherwise(F.col("llr_1")))
    scores = save(value.groupBy("name").agg(F.avg("llr_all").alias("score"), held_out.alias("held")), "scores")
    bins = F.floor(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("held"))) * STEPS)
    counts = names.where("ruled is not null").join(scores, "name").groupBy(bins.alias("at"), "ruled").agg(F.sum("n").alias("n"))
    threshold = threshold_of([(r["at"], r.ruled, r.n) for r in counts.collect()])  # 2 * WIDEST * STEPS bins a class at most
    method = F.when(F.col("score") < threshold, "block").otherwise("allow") if threshold is not None else F.lit("allow")
    out = keyed.join(scores.select("name", "score"), "name", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.round("score", 9).alias("score"))
