import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pairloom.llm.quality import BELIEF, TRUST, fit, judged, posterior

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = SPLIT.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if SPLIT.search(x):
            dup += x in seen
            seen.add(x)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_base_against_brute_force(spark):
    odd = [(900, None), (901, ""), (902, " \n\t"), (903, "a b c " * 60), (904, "x\u00a0y z\u2028q # <|> 😀 " * 30), (905, "a\n\na\nb\na"), (906, "word " * 200_000), (None, "a b")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    docs = docs.withColumn("n_words", F.lit(1)).withColumn("h", F.lit(2)).withColumn("t", F.lit(3))
    want = {d: base(t) for d, t in docs.select("doc_id", "text").collect()}
    got = judged(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.kept and r.base_failed)


def graded(text):
    """The votes of the nine rules, by hand."""
    text = text or ""
    n, chars, symbols, dup, repeat, _ = base(text)
    lines, w = sum(bool(SPLIT.search(x)) for x in text.split("\n")), SPLIT.findall(text)
    upper, letters, exclaim = sum(c.isupper() for c in text), sum(c.isalpha() for c in text), text.count("!")

    def over(part, whole, good, bad, worse):
        return -2 if part * 100 > worse * whole else -1 if part * 100 > bad * whole else int(part * 100 <= good * whole)

    def inside(value, *bounds):
        (a, b), (c, d), (e, f) = bounds
        return -2 if not e <= value <= f else -1 if not c <= value <= d else int(a <= value <= b)

    if not n:
        return (0,) * 9
    return (
        -2 if n < 10 else -1 if n < 50 else int(n >= 100),
        over(symbols, n, 2, 10, 25),
        over(repeat, n, 15, 30, 50),
        -2 if dup * 100 > 60 * lines else -1 if dup * 100 > 30 * lines else int(lines >= 3 and not dup),
        inside(chars, (4 * n, 7 * n), (3 * n, 10 * n), (2 * n, 15 * n)),
        over(upper, chars, 10, 25, 50),
        -2 if letters * 100 < 75 * chars else -1 if letters * 100 < 89 * chars else int(letters * 100 >= 96 * chars),
        over(exclaim, n, 5, 25, 50),
        -2 if n >= 50 and len(set(w)) * 100 < 8 * n else -1 if n >= 50 and len(set(w)) * 100 < 15 * n else int(len(set(w)) * 100 >= 45 * n),
    )


def expectation_maximisation(rows):
    """Document by document in NumPy: posteriors of being good."""
    levels, trusted = np.array([-2, -1, 0, 1]), np.array([0, 1, 1, 0, 0, 0, 1, 0, 0], bool)
    hot = np.array(rows)[:, :, None] == levels
    good = 1 / (1 + np.exp(3 - (np.array(rows) * (1 + trusted)).sum(axis=1)))
    presumed = np.where(trusted[:, None, None], TRUST, BELIEF)  # rule, class, level
    weight = 0.002 * len(rows)
    for _ in range(1000):
        prior = (good.sum() + 0.9 * weight) / (len(rows) + weight)
        chance = [(np.einsum("d,drl->rl", g, hot) + weight * presumed[:, k]) / (g.sum() + weight) for k, g in enumerate((good, 1 - good))]
        odds = np.log(prior / (1 - prior)) + np.einsum("drl,rl->d", hot, np.log(chance[0] / chance[1]))
        new = 1 / (1 + np.exp(-odds))
        if abs(new - good).max() < 1e-9:
            break
        good = new
    return new


def test_posterior_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(900, None), (901, ""), (902, "SHOUT! " * 90), (903, "a1 b2 " * 80), (903, "a1 b2 " * 80)], docs.schema))
    rows = docs.collect()
    want = {r.doc_id: q for r, q in zip(rows, expectation_maximisation([graded(r.text) for r in rows]))}
    for r in judged(docs).collect():
        assert abs(r.quality - want[r.doc_id]) < 2e-6 and r.kept == (not r.base_failed and r.quality >= 0.5)


def test_held_out_labels_favour_the_posterior(spark):
    """Against the demand that no rule votes against, where the base lets both decide."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r for r in docs.join(labels, "doc_id").collect()}
    rows = [r for r in judged(docs).collect() if r.doc_id in texts and not r.base_failed]
    passes = {r.doc_id: min(graded(texts[r.doc_id].text)) >= 0 for r in rows}
    good = {r.doc_id: bool(texts[r.doc_id].quality) for r in rows}
    own, all_pass = sum(r.kept == good[r.doc_id] for r in rows), sum(passes[r.doc_id] == good[r.doc_id] for r in rows)
    assert own > all_pass and own > 0.99 * len(rows) and any(r.kept != passes[r.doc_id] for r in rows)


def test_fit_and_empty(spark):
    rules = ["few_symbols", "few_repeats", "calm"]
    prior, tables = fit([((1, 1, 1), 800), ((1, 1, -1), 40), ((-1, -1, 0), 90), ((-2, 1, -1), 70)], rules)
    assert prior > 0.7 and tables[0][0][1] > tables[0][1][1] and tables[0][0][-1] < tables[0][1][-1]
    assert posterior(prior, tables, (1, 1, -1)) > 0.5 > posterior(prior, tables, (-2, 1, -1))
    assert fit([], rules) == (0.9, [])
    assert judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 60), (1, "w " * 60), (None, "x y z"), (None, None)], "doc_id long, text string").selectExpr("*", "1 as quality", "2 as kept", "3 as vote_calm")
    out = judged(docs).collect()
    assert len(out) == 4 and len({tuple(r) for r in out if r.doc_id == 1}) == 1 and not any(r.kept for r in out)
