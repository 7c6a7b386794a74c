import random

import pytest

from pairloom.llm.common import components
from pairloom.llm.minmax_dedup import minmax, near_groups
from pairloom.llm.shingles import shared, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def brute(rows, k, percent):
    def shingles(text):
        w = text.encode().lower().split() if text else []
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_groups(docs, k=4)) == brute(rows, 4, 80)


def test_hot_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(420):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 4, 6))):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{r.randrange(400)}" for _ in range(60))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_groups(docs, k=4)) == brute(rows, 4, 80)


@pytest.mark.parametrize("text", [None, "", " \t\n"])
def test_texts_without_words(spark, text):
    docs = spark.createDataFrame([(1, text, None, None, None), (2, text, None, None, None), (3, "a b", None, None, None), (4, "A  b", None, None, None)], SCHEMA)
    assert got(near_groups(docs, k=4)) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False)]


def test_empty_nulls_repeats_and_long(spark):
    assert near_groups(spark.createDataFrame([], SCHEMA), k=4).count() == 0
    long = " ".join(f"t{i}" for i in range(60_000))
    docs = spark.createDataFrame([(7, long), (7, long), (9, long), (None, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    rows = docs.selectExpr("doc_id", "text", "1 as component_id", "2 as rep", "3 as key")
    out = [tuple(r) for r in near_groups(rows, k=4).collect()]
    assert sorted(x for x in out if x[0] is not None) == [(3, 2, 3, True), (7, 59_997, 7, True), (7, 59_997, 7, True), (9, 59_997, 7, False)]
    assert [x for x in out if x[0] is None] == [(None, 2, None, True)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}


def test_signature_estimates_similarity():
    a = shingle_set(" ".join(f"a{i}" for i in range(2000)), 4)
    b = shingle_set(" ".join(f"a{i}" for i in range(400, 2000)), 4)
    true = shared(a, b) / (len(a) + len(b) - shared(a, b))
    assert abs((minmax(a, 1024) == minmax(b, 1024)).mean() - true) < 0.04


def test_a_copy_by_one_text_is_linked_by_its_other(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b + " c")], "doc_id long, text string")
    assert [x[2:] for x in got(near_groups(docs, k=4))] == [(1, True), (1, False), (1, False), (1, False)]
