import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm.line_dedup import deduplicated, parts, probes, within
from pairloom.llm.queries import op3_line_edits

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40), st.integers(0, 6))
def test_within(a, b, edits):
    assert within(a, b, edits) == (distance(a, b) <= edits)


@settings(max_examples=400, deadline=None)
@given(st.text("ab", min_size=8, max_size=80), st.lists(st.tuples(st.integers(0, 79), st.sampled_from("+-x"), st.sampled_from("abc")), max_size=4), st.integers(1, 4))
def test_lines_within_the_bound_share_a_key(a, changes, edits):
    b = list(a)
    for at, kind, c in changes[:edits]:
        at = min(at, len(b) - 1)
        b[at : at + (kind != "+")] = [] if kind == "-" else [c]
    b = "".join(b)
    assert within(a, b, edits) and within(b, a, edits)
    if min(len(a), len(b)) > edits:
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        index = {(len(short), i, short[s : s + n]) for i, (s, n) in enumerate(parts(len(short), edits))}
        assert any((o, i, long[s : s + n]) in index for o, i, s, n in probes(len(long), edits))


def brute(rows, edits=2, least=20, most=1):
    lines = [(d, t, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if t and x.strip()]
    kinds = sorted({x[3] for x in lines})
    up = list(range(len(kinds)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = sorted(range(len(kinds)), key=lambda i: len(kinds[i]))
    for n, i in enumerate(by):
        for j in by[n + 1 :]:
            if len(kinds[j]) - len(kinds[i]) > edits:
                break
            if min(len(kinds[i]), len(kinds[j])) >= least and within(kinds[i], kinds[j], edits):
                up[root(i)] = root(j)
    part = {x: root(i) for i, x in enumerate(kinds)}
    first, out = {}, []
    for d, _, i, x in sorted(lines, key=lambda r: (r[0], r[2])):
        first.setdefault(part[x], (d, i))
    for d, t in rows:
        own = t.split("\n") if t is not None else []
        gone = {i for i, x in enumerate(own) if x.strip() and first[part[x]] != (d, i)}
        copy = sum(len(own[i]) for i in gone) > most * sum(map(len, own))
        out.append((d, len(own), 0 if copy else len(gone), len(gone), copy, t if copy or not gone else "\n".join(x for i, x in enumerate(own) if i not in gone)))
    return sorted(out)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r[2] for r in want) and got(deduplicated(docs)) == want
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(deduplicated(docs, most=0.5)) == brute(rows, most=0.5)


def test_chains_hot_lines_and_odd_rows(spark):
    r = random.Random(2)
    line = "".join(r.choice("abcdef ") for _ in range(60))
    rows = [(i, f"{r.randrange(10**40):040d}\n" + line[: i % 50] + "#" * (i % 3) + line[i % 50 :] + "\nshort") for i in range(90)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "x" * 50_000 + "\n" + "x" * 50_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as own", "2 as key", "3 as line")
    assert got(deduplicated(docs)) == brute(rows)
    again = spark.createDataFrame([(None, line), (None, line), (5, line)], "doc_id long, text string")
    assert [x[3] for x in got(deduplicated(again))] == [0, 0, 1]
    assert deduplicated(docs.limit(0)).count() == 0


def test_query_removes_lines_whatever_their_share(spark, tmp_path):
    shared = [f"a line of boilerplate, number {i}: {c * 30}" for i, c in enumerate("abcdef")]
    texts = ["\n".join(shared), "\n".join([*shared, "a line that only this text of all has, in the end"]), "\n".join(shared), "\n".join([shared[0], *[c * 60 for c in "uvwxyz"]])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(list(enumerate(texts)), most=1)
    assert [(x[2], x[5]) for x in want][1:3] == [(6, texts[1].split("\n")[-1]), (6, "")]
    out = {r.doc_id: (r.n_removed, r.n_repeated, r.kept_sha256) for r in op3_line_edits(spark, str(tmp_path)).collect()}
    assert out == {x[0]: (x[2], x[3], hashlib.sha256(x[5].encode()).hexdigest()) for x in want}


def test_short_equal_lines_go(spark):
    rows = [(1, "own words of the first text here\nSubscribe now!\n\nzz"), (2, "Subscribe now!\n \nzz\nsome words of the second text"), (3, "Subscribe noW!")]
    out = got(deduplicated(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == brute(rows) and out[1][5] == " \nsome words of the second text" and out[2][2] == 0


def test_large_bucket_of_lines_that_are_not_alike(spark):
    """One template whose lines share a segment, mostly more than two edits apart."""
    r = random.Random(5)
    rows = [(i, f"Order number {r.randrange(10**8):08d} has been shipped to you by our partner") for i in range(700)]
    rows += [(1000 + i, rows[i][1].replace("been", "ben")) for i in range(0, 60, 7)]
    out = got(deduplicated(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == brute(rows) and sum(x[2] for x in out) >= 9
