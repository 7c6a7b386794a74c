import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import cascade as K
from pairloom.operators import network as N
from pairloom.operators import align, entropy, seed, stats
from pairloom.operators.align import Scoring, align_all, aligner, best_ends
from pairloom.operators.archive import buffered, keep_at_least, merged_rows, proper_pairs, rows_between, shuffled, sort_by_name, with_group
from pairloom.operators.select import best_pairs
from pairloom.operators.truth import attach_pairs
from pairloom.sources import records
from pairloom.sources.tables import ALIGNMENT, write_archive, write_split


def smith_waterman(a, b, s):
    """Best score by the textbook recurrence, and the first column and row that reach it."""
    score = lambda x, y: s.match if x == y else -s.mismatch
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[-(10**9)] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[-(10**9)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i - 1][j] - s.gap_open, e[i - 1][j] - s.gap_extend)
            f[i][j] = max(h[i][j - 1] - s.gap_open, f[i][j - 1] - s.gap_extend)
            h[i][j] = max(0, h[i - 1][j - 1] + score(a[i - 1], b[j - 1]), e[i][j], f[i][j])
    best = max(map(max, h))
    if not best:
        return 0, -1, -1
    j = min(j for j in range(len(b) + 1) if any(row[j] == best for row in h))
    return best, j - 1, min(i for i in range(len(a) + 1) if h[i][j] == best) - 1


def test_alignment_against_the_textbook():
    r = random.Random(1)
    for s in (Scoring(bases=False), Scoring(3, 1, 4, 2, bases=False), Scoring(10, 9, 15, 6, bases=False)):
        queries = ["".join(r.choices("acgt", k=r.randrange(1, 30))) for _ in range(60)]
        refs = ["".join(r.choices("acgt", k=r.randrange(1, 50))) if r.random() < 0.5 else q[:9] + "t" + q[9:] + "ac" for q in queries]
        for q, t, got in zip(queries, refs, align_all(queries, refs, s, None, 1, 32_767)):
            assert got[:3] == smith_waterman(q, t, s)
            if got[0]:
                ops = [(int(n), o) for n, o in __import__("re").findall(r"(\d+)(.)", got[7])]
                i, j, score = 0, got[5], 0
                for n, o in ops:
                    if o in "=X":
                        assert all((q[i + k] == t[j + k]) == (o == "=") for k in range(n))
                        score += n * (s.match if o == "=" else -s.mismatch)
                    elif o in "ID":
                        score -= s.gap_open + (n - 1) * s.gap_extend
                    i += n * (o in "=XIS")
                    j += n * (o in "=XD")
                assert (i, j - 1, score) == (len(q), got[1], got[0])


def column_scores(a, b, match=2, mismatch=2, open_=3, extend=1):
    """By letter of b the best score of an alignment that ends there, and its first row in a:
    a row at a time, gaps along b by one running value."""
    letters = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    m = len(letters)
    h, e, best, row = np.zeros(m + 1, np.int64), np.full(m + 1, -(10**9)), np.zeros(m, np.int64), np.full(m, -1)
    places = np.arange(m + 1)
    for i, c in enumerate(a):
        e = np.maximum(h - open_, e - extend)
        t = np.maximum(np.maximum(np.concatenate(([0], h[:-1] + np.where(letters == ord(c), match, -mismatch))), e), 0)
        t[0] = 0
        # the best gap that is open at j starts at any k < j: t[k] - open - (j - k - 1) * extend
        f = np.concatenate(([-(10**9)], np.maximum.accumulate(t + places * extend)[:-1] - open_ - (places[1:] - 1) * extend))
        h = np.maximum(t, f)
        h[0] = 0
        up = h[1:] > best
        row[up], best[up] = i, h[1:][up]
    return best, row


def test_second_scores_against_the_textbook():
    r = random.Random(8)
    s = Scoring(bases=False)
    queries = ["".join(r.choices("acgt", k=20)) for _ in range(40)]
    refs = ["".join(r.choices("acgt", k=30)) + q + "".join(r.choices("acgt", k=r.randrange(60))) + q[:15] for q in queries]
    for q, t, got in zip(queries, refs, align_all(queries, refs, s, None, None, 32_767)):
        best, row = column_scores(q, t)
        end = int(np.argmax(best))
        assert (int(best[end]), end, int(row[end])) == smith_waterman(q, t, s) == got[:3]
        rest = best.copy()
        rest[max(0, end - 20) : end + 20] = 0
        assert got[3:5] == (rest.max(), int(np.argmax(rest)) if rest.max() else -1)


def test_windows_round_seeds_give_the_same_ends():
    r = random.Random(9)
    s = Scoring(bases=False)
    queries = ["".join(r.choices("acgt ", k=r.randrange(5, 60))) for _ in range(80)]
    refs = ["".join(r.choices("acgt ", k=r.randrange(900))) + (q if r.random() < 0.5 else q[:20] + "x" + q[20:]) * r.randrange(3) + "".join(r.choices("acgt ", k=900)) for q in queries]
    coded = [(i, s.codes(q), s.codes(t)) for i, (q, t) in enumerate(zip(queries, refs))]
    assert len(best_ends(coded, s)) > 20
    whole = align_all(queries, refs, s, None, None, 32_767)
    assert [x[:3] for x in align_all(queries, refs, s, 0, None, 32_767)] == [x[:3] for x in whole]


def test_alignment_works_in_the_letters_a_score_can_span(monkeypatch):
    """Whole references are swept once, for the scores; rows, begins and edit strings come from
    parts.  The results are the textbook's, in long references and for scores above 16 bits."""
    r = random.Random(12)
    q = "".join(r.choices("acgt", k=60))
    text = "".join(r.choices("acgt", k=3000)) + q[:30] + "g" + q[30:] + "".join(r.choices("acgt", k=3000))
    swept = []
    kernel = align._diagonals
    monkeypatch.setattr(align, "_diagonals", lambda pairs, s: swept.extend(len(x[1]) for x in pairs) or kernel(pairs, s))
    for s in (Scoring(bases=False), Scoring(), Scoring(900, 900, 1350, 450, bases=False)):
        swept.clear()
        (got,) = align_all([q], [text], s, None, 1, 32_767)
        best, row = column_scores(q, text, s.match, s.mismatch, s.gap_open, s.gap_extend)
        end = int(np.argmax(best))
        assert got[:3] == (best[end], end, row[end]) and got[5:] == (3000, 0, "30=1D30=", 1)
        assert sum(m > 1000 for m in swept) == 1


def test_equal_letters_need_no_matrices(monkeypatch):
    monkeypatch.setattr(align, "_fill", None)
    assert align_all(["abcdé" * 9], ["zz" + "abcdé" * 9 + "y"], Scoring(bases=False), None, 1, 32_767) == [(90, 46, 44, 0, -1, 2, 0, "45=", 0)]


def test_translation_and_one_reference(spark):
    """Letters w and s as A and C, everything against one reference."""
    s = Scoring(translation=(("w", 0), ("s", 1)))
    df = spark.createDataFrame([("wwss",), ("ssww",), ("qqqq",)], "q string").coalesce(1)
    assert [x[0].score for x in df.select(aligner(s)("q", F.lit("swwssq"))).collect()] == [8, 6, 0]  # ssww: its sww
    matrix = tuple(5 if i == j and i < 4 else -4 for i in range(5) for j in range(5))
    assert [x[0].score for x in df.select(aligner(Scoring(matrix=matrix, gap_open=20))(F.lit("ACGT"), F.lit("TACGTA"))).collect()] == [20] * 3


def test_alignment_edges(spark):
    df = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", "NNNN"), ("", "ACG"), (None, "ACG"), ("AAAA", "CCCC"), ("ACGU", "acga")], "q string, r string").coalesce(1)
    got = [tuple(x[0])[:3] for x in df.select(aligner()("q", "r")).collect()]
    assert got == [(8, 3, 3), (0, -1, -1), (0, -1, -1), (0, -1, -1), (0, -1, -1), (8, 3, 3)]


def fold(m1, m2, expected):
    """The ordered fold over pairs, written as loops."""

    def proper(a, b):
        return a["is_rev"] != b["is_rev"] and (a["ref_begin"] > b["ref_begin"] if a["is_rev"] else a["ref_begin"] < b["ref_begin"])

    def length(a, b):
        return a["ref_end"] - b["ref_begin"] + 1 if a["is_rev"] else b["ref_end"] - a["ref_begin"] + 1

    def better(x, y):
        if proper(*x[:2]) != proper(*y[:2]):
            return proper(*x[:2])
        dx, dy = abs(x[2] - expected), abs(y[2] - expected)
        if abs(dx - dy) < expected // 2:
            return x[0]["sw"] + x[1]["sw"] >= y[0]["sw"] + y[1]["sw"]
        return dx < dy

    best = second = None
    for a in m1:
        for b in m2:
            n = length(a, b)
            if a["ref_index"] != b["ref_index"] or not 0 <= n <= 2 * expected:
                continue
            x = (a, b, n)
            if best is None:
                if proper(a, b) or not proper(m1[0], m2[0]):
                    best = x
            elif better(x, best):
                best, second = x, best
            elif second is None or better(x, second):
                second = x
    return best, second


def test_best_pairs_against_loops(spark):
    r = random.Random(4)
    rows = []
    for name in range(150):
        for mate in (1, 2):
            for _ in range(r.choice((0, 1, 1, 2, 5))):
                begin = r.randrange(900)
                rows.append((name, mate, r.randrange(2), begin, begin + 49, 50, r.random() < 0.5, r.randrange(300, 500), 0, r.randrange(60), False))
    fields = [x.split()[0] for x in ALIGNMENT.split(", ")]
    key = lambda a: tuple(a[k] for k in ("ref_index", "ref_begin", "ref_end", "is_rev", "map_len", "sw", "mismatches", "quality"))
    got = {x.name: x for x in best_pairs(spark.createDataFrame(rows, ALIGNMENT), 400).collect()}
    seen = 0
    for name in range(150):
        m = [sorted((dict(zip(fields, x)) for x in rows if x[0] == name and x[1] == k), key=key) for k in (1, 2)]
        assert (name in got) == (bool(m[0]) and bool(m[1]))
        if name in got:
            best, second = fold(*m, 400)
            g = got[name]
            assert g.found_by == ("pair" if best else "quality") and (g.n1, g.n2) == (len(m[0]), len(m[1]))
            if best:
                assert (g.ref1, g.begin1, g.begin2, g.fragment) == (best[0]["ref_index"], best[0]["ref_begin"], best[1]["ref_begin"], best[2])
                if second:
                    seen += 1
                    assert g.next_quality1 == (0 if second[0] == best[0] else second[0]["quality"])
    assert seen > 5


def test_archive_edges(spark):
    rows = [(n, 1, 0, 10 * k, 10 * k + 4, 5, False, 1, 0, q, False) for n, qs in ((1, (9,)), (2, (1, 1, 9)), (3, (1, 1, 1)), (4, (9, 9, 9)), (5, (1,))) for k, q in enumerate(qs)]
    aln = spark.createDataFrame(rows, ALIGNMENT)
    kept = keep_at_least(aln, F.col("quality") > 5).groupBy("name").count().collect()
    assert {r.name: r["count"] for r in kept} == {1: 1, 2: 2, 3: 2, 4: 3, 5: 1}
    assert sort_by_name(aln.limit(0)).count() == 0 and proper_pairs(aln.limit(0), 5).count() == 0
    with pytest.raises(IndexError):
        rows_between(spark.range(5).withColumnRenamed("id", "row_id"), "row_id", 3, 3)
    a, b = (spark.createDataFrame([(x,)], "features array<double>") for x in ([1.0], [1.0, 2.0]))
    with pytest.raises(ValueError):
        merged_rows(a, b)


def test_histogram_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (-1, 0, 0, 9, 10, None)], "x long")
    m = stats.moments(df, F.col("x"), 0, 10).first()
    assert (m.tot, m.in_range, m.over, m["under"]) == (5, 3, 1, 1) and m["mean"] == 3.0
    assert [(r.x, r.n, r.cum) for r in stats.histogram(df, F.col("x"), 0, 10).orderBy("x").collect()] == [(0, 2, 3), (9, 1, 4)]
    empty = stats.moments(df.limit(0), F.col("x"), 0, 10).first()
    assert empty["mean"] is None and empty.tot == 0


@pytest.mark.parametrize("net", [N.create([3, 4, 2], seed=1, low=-2, high=2), N.create([3, 5, 2], seed=2, rate=0.5, low=-2, high=2), N.create([3, 2, 2, 1], seed=3, shortcut=True, low=-1, high=1), N.create([2, 3, 1], activation="sin", steepness=1.0, low=-1, high=1)])
def test_forward_and_gradient(spark, net):
    x = np.random.default_rng(0).normal(size=(20, net.sizes[0]))
    want = net.run(x)[-1][2]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i int, features array<double>")
    got = {r.i: r.y for r in rows.select("i", net.forward(F.col("features")).alias("y")).collect()}
    assert np.allclose([got[i] for i in range(20)], want, atol=1e-12)
    target, t = np.zeros_like(want) + 0.3, N.Training(tanh_error=False)
    g, half, w = N.gradient(net, x, target, t)[0], 2 if net.layers[-1].activation in N.SYMMETRIC else 1, net.flat()
    for k in range(0, len(w), 3):
        step = np.zeros_like(w)
        step[k] = 1e-5
        up, down = (((target - net.with_flat(w + d).run(x)[-1][2]) ** 2).sum() for d in (step, -step))
        assert abs(-(up - down) / 2e-5 / 2 / half - g[k]) < 1e-4


def test_seeds_are_grams_of_code_points(spark):
    """A letter beyond 16 bits is one letter; only wanted grams leave a text, whatever its length."""
    text = "abc\U0001f600defghijklmnopqrs"
    whole = {text[i : i + 15] for i in range(len(text) - 14)}
    long = "x" * (seed._STEP - 7) + text + "y" * 20
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "abc"), (5, long), (6, text * 2)], "i int, text string").coalesce(1)
    got = {r.i: r.g for r in df.select("i", seed.grams(F.col("text"), 15).alias("g")).collect()}
    assert set(got[1]) == whole and len(got[1]) == len(whole) and got[2] is None and got[3] == got[4] == []
    picked = {r.i: r.g for r in df.select("i", seed.grams(F.col("text"), 15, sorted(whole)).alias("g")).collect()}
    assert set(picked[1]) == set(picked[5]) == set(picked[6]) == whole and len(picked[6]) == len(whole)
    assert all(r.g is None or r.g == [] for r in df.select(seed.grams(F.col("text"), 15, []).alias("g")).collect())
    found = seed.candidates(df.where("i = 1"), df.withColumnRenamed("i", "j"), "i", "j").collect()
    assert sorted(map(tuple, found)) == [(1, j, len(whole), len(whole)) for j in (1, 5, 6)]


def test_seeds_of_many_reads_are_joined_whole(spark, monkeypatch):
    df = spark.createDataFrame([(i, "".join(random.Random(i).choices("acgt", k=60))) for i in range(20)], "i int, text string")
    other = df.select(F.col("i").alias("j"), F.concat(F.lit("tt"), "text").alias("text"))
    few = sorted(map(tuple, seed.candidates(df, other, "i", "j").collect()))
    monkeypatch.setattr(seed, "BROADCAST_ROWS", 10)
    assert few == sorted(map(tuple, seed.candidates(df, other, "i", "j").collect())) == [(i, i, 46, 46) for i in range(20)]


def test_byte_counts_stay_in_arrow(spark):
    """Bytes are counted as they are: no array of letters a text is sorted."""
    rows = [(1, None), (2, ""), (3, "aaaa"), (4, "ab\u00e9" * 40_000), (5, "\x00\n\x00\n")]
    out = entropy.byte_entropy(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1))
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {1: (0.0, 0, 0.0, None), 2: (0.0, 0, 0.0, None), 3: (0.0, 1, 0.0, None), 4: (2.0, 4, 2.0, 1.0), 5: (1.0, 2, 1.0, 1.0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array_sort" not in plan and "split(" not in plan


def test_forward_of_odd_rows(spark):
    """A sum that isn't a number counts as the limit, whatever makes it so; the result is
    computed once, in Arrow batches, however often an expression names it."""
    net = N.create([2, 3, 1], seed=4, low=-2, high=2)
    rows = [None, [], [1.0], [1.0, None], [1.0, float("nan")], [1.0, 2.0, 3.0], [1.0, 2.0], [1e9, -1e9]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, features array<double>").coalesce(1)
    y = net.forward(F.col("features"))
    used = df.select("i", y.alias("y"), (F.get(y, F.lit(0)) + F.get(y, F.lit(0))).alias("twice"))
    got = {r.i: r for r in used.collect()}
    odd = np.tanh(0.5 * net.layers[1].weights.sum())
    assert all(got[i].y == pytest.approx([odd], abs=1e-12) for i in range(6))
    want = net.run(np.array([[1.0, 2.0], [1e9, -1e9]]))[-1][2]
    assert [got[6].y, got[7].y] == [pytest.approx(list(v), abs=1e-12) for v in want]
    assert all(r.twice == 2 * r.y[0] for r in got.values())
    plan = used._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan
    short = N.create([2, 2, 1], seed=3, shortcut=True)
    assert [r[0] is None for r in df.select("i", short.forward(F.col("features")).alias("y")).orderBy("i").select("y").collect()] == [True] + [False] * 7
    assert df.limit(0).select(y).collect() == []


@pytest.mark.parametrize("algorithm, epochs, rate", [("rprop", 15, 0.7), ("quickprop", 15, 0.7), ("batch", 15, 10.0), ("incremental", 5, 0.7)])
def test_training_learns(spark, algorithm, epochs, rate):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 3))
    data = spark.createDataFrame([(v.tolist(), [1.0 if v[0] + v[1] > 0 else -1.0]) for v in x], "features array<double>, target array<double>").coalesce(2)
    t = N.Training(algorithm, epochs=epochs, error=0.0, rate=rate)
    N.train(N.create([3, 4, 1], seed=1), data, t)
    assert len(t.history) == epochs and t.history[-1] < 0.6 * t.history[0]
    with pytest.raises(ValueError):
        N.Training("none")


def test_network_and_training_files(spark, tmp_path):
    for net in (N.create([3, 4, 2], seed=1), N.create([3, 4, 2], seed=1, rate=0.4), N.create([3, 2, 4, 1], seed=2, shortcut=True)):
        (tmp_path / "net").write_text(records.network_text(net))
        back = records.load_network(spark, str(tmp_path / "net"))
        assert back.shortcut == net.shortcut and back.dump() == net.dump() and len(net.dump()) == 1 + len(net.layers) + net.n_connections
        assert back.sizes == net.sizes and np.allclose(back.flat(), net.flat()) and back.n_connections == net.n_connections
        assert np.allclose(records.network_of(records.network_text(net, fixed=True)).flat(), net.flat(), atol=1e-3)
    data = spark.createDataFrame([(i, [i / 2, 1.0], [float(-i)]) for i in range(30)], "row_id long, features array<double>, target array<double>")
    records.training_lines(data).coalesce(1).write.text(str(tmp_path / "data"))
    path = next(str(p) for p in (tmp_path / "data").iterdir() if p.name.startswith("part-"))
    assert sorted(map(tuple, records.training_set(spark, path).collect())) == sorted(map(tuple, data.collect()))
    with pytest.raises(ValueError):
        records.network_of("other\n")
    old = "FANN_FLO_1.1\n3 0.7 1.0 0 5 0 0.25 1.0\n3 3 2 \n0 0 0 3 3 0 3 0 \n(0 0.5) (1 -1.5) (2 2.0) (0 0.1) (1 0.2) (2 0.3) (3 1.0) (4 -1.0) (5 0.25) "
    net = records.network_of(old)
    assert net.sizes == [2, 2, 1] and [(x.activation, x.steepness) for x in net.layers] == [("sigmoid_symmetric", 0.25), ("linear", 1.0)]
    assert net.layers[0].weights.tolist() == [[0.5, -1.5, 2.0], [0.1, 0.2, 0.3]] and net.layers[1].weights.tolist() == [[1.0, -1.0, 0.25]]
    fixed = "FANN_FIX_1.1\n4\n2 0.7 1.0 0 0 0 16 16\n2 2 \n0 0 2 0 \n(0 8) (1 -4) "
    assert records.network_of(fixed).layers[0].weights.tolist() == [[0.5, -0.25]]


def test_records(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD VN:1\nr1 99 chr1 100 60 4M = 200 104 ACGT IIII RG:Z:a\nr2 4 * 0")
    rows = records.records(spark, str(tmp_path / "x.sam")).orderBy("name").collect()
    assert [(r.name, r.flag, r.pos, r.rg, r.zn) for r in rows] == [("r1", 99, 100, "RG:Z:a", None), ("r2", 4, 0, None, None)]
    tagged = records.tagged_lines(records.records(spark, str(tmp_path / "x.sam")).withColumns({"chr": F.when(F.col("name") == "r1", "chr1"), "true_pos": F.when(F.col("name") == "r1", 7)}))
    assert sorted(r.value.rsplit(" ", 1)[1] for r in tagged.collect()) == ["XC:Z:;0", "XC:Z:chr1;7"]


def test_truth_of_pairs_in_all_four_cases(spark):
    """The first record of either side can be mate 1 or mate 2."""
    gold, test = [], []
    for case in range(4):
        g, t = (64, 128) if case & 1 else (128, 64), (64, 128) if case & 2 else (128, 64)
        gold += [(case, i, g[i], "c", 1000 if g[i] == 64 else 2000) for i in (0, 1)]
        test += [(case, i, t[i] | 1, "c", 1019 if t[i] == 64 else 2020, 30 + i) for i in (0, 1)]
    gold += [(9, 0, 64, "c", 1), (9, 1, 128, "c", 2), (10, 0, 64, "c", 1), (10, 1, 128, "c", 2), (11, 0, 64, "c", 1)]
    test += [(9, 0, 64 | 4, "c", 1, 7), (9, 1, 128, "c", 2, 8), (10, 0, 64, "c", 1, 7), (10, 1, 128 | 4, "c", 2, 8), (11, 0, 64, "c", 1, 1)]
    gold = spark.createDataFrame(gold, "name long, no int, flag int, chr string, pos long")
    test = spark.createDataFrame(test, "name long, no int, flag int, chr string, pos long, quality int")
    got = {(r.name, r.mate): (r.correct, r.counted, r.reported) for r in attach_pairs(gold, test, "name", ["no"], ["no"]).collect()}
    want = {(c, m): (m == 1, True, True) for c in range(4) for m in (1, 2)}
    assert got == want | {(9, 1): (True, False, False), (9, 2): (True, False, False), (10, 1): (True, True, False), (10, 2): (True, False, False)}


def test_groups_buffers_and_orders(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8)], "name long, code long")
    groups = spark.createDataFrame([(7, "a")], "code long, label string")
    assert with_group(rows.where("code = 7"), groups).first().label == "a"
    with pytest.raises(Exception, match="no such group: 8"):
        with_group(rows, groups).collect()
    assert [r.id for r in buffered(spark.range(9), ["id"], 4).collect()] == [0, 1, 2, 3]
    order = [r.id for r in shuffled(spark.range(50), "id", 3).collect()]
    assert sorted(order) == list(range(50)) and order != sorted(order) and order == [r.id for r in shuffled(spark.range(50), "id", 3).collect()]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3 == 0 if i else None) for i in range(10)], "id long, is_special boolean")
    write_archive(rows.coalesce(1), str(tmp_path / "a"), records_per_file=4)
    assert len([p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-")]) == 3
    write_split(rows, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b" / "special=true")).count() == 3 and spark.read.parquet(str(tmp_path / "b")).count() == 10
    rows = spark.createDataFrame([("LR", 2, 2, 5, 9, "2"), ("LR", 1, 1, 4, 4, "1")], "section string, bin long, x long, n long, cum long, label string")
    assert [r.value for r in records.report_lines(rows).collect()] == ["LR\t1\t1\t4\t4", "LR\t2\t2\t5\t9"]
    out = records.generated(spark, 3, lambda i: (F.array(i.cast("double")), F.array((i * 2).cast("double")))).collect()
    assert [(r.row_id, r.features, r.target) for r in out] == [(i, [float(i)], [2.0 * i]) for i in range(3)]


def test_initial_weights_and_scaling(spark):
    net = N.spread_weights(N.create([4, 50, 3], seed=1), -2.0, 3.0, seed=2)
    f = (0.7 * 50) ** (1 / 4) / 5
    for x in net.layers:
        plain, bias = x.weights[:, :-1], x.weights[:, -1]
        assert 0 <= plain.min() and plain.max() < f and -f <= bias.min() < 0 < bias.max() < f
    assert abs(N.randomised(net, -0.3, 0.2).flat()).max() <= 0.3
    data = spark.createDataFrame([(i, [float(i), 4.0, i * i / 2]) for i in range(20)], "i long, v array<double>")
    kept = N.scaling(data, "v")
    there = {r.i: r.s for r in data.select("i", N.scaled(F.col("v"), kept, 0.0, 1.0).alias("s")).collect()}
    assert {r.i: r.v for r in N.standardised(data, "v", 0.0, 1.0).collect()} == there and there[3][1] is None
    back = data.select("i", N.unscaled(N.scaled(F.col("v"), kept, 0.0, 1.0), kept, 0.0, 1.0).alias("b")).collect()
    assert all(np.allclose([r.b[0], r.b[2]], [r.i, r.i * r.i / 2]) for r in back)
    with pytest.raises(ValueError):
        N.train(N.create([1, 1], seed=0), spark.range(3).select(F.array(F.col("id").cast("double")).alias("features"), F.array(F.lit(1.0)).alias("target")), N.Training("incremental", epochs=1, sequential_rows=2))


def test_cascade_learns_what_no_single_layer_can(spark):
    """Exclusive or, by neurons that are added; and the slopes of candidates by differences."""
    r = np.random.default_rng(6)
    x = r.uniform(-1, 1, (120, 2))
    y = np.where(x[:, :1] * x[:, 1:] > 0, 1.0, -1.0)
    data = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "features array<double>, target array<double>").coalesce(1)
    c = K.Cascade(neurons=2, output_epochs=25, candidate_epochs=25, functions=("gaussian_symmetric", "sigmoid_symmetric"), steepnesses=(0.5, 1.0), groups=1, seed=3)
    net = K.grow(2, 1, data, c)
    assert net.shortcut and net.sizes == [2, 1, 1, 1] and len(c.history) == 3 and c.history[-1] < 0.75 * c.history[0]
    assert records.network_of(records.network_text(net)).dump() == net.dump()
    before = net.run(x)[-1][2]
    same = K.installed(net, N.Layer(r.normal(size=(1, 5))), np.zeros(1)).run(x)[-1][2]
    assert np.allclose(before, same)

    a, e = K.residuals(net, x, y)
    of = K.Candidates(r.normal(size=(2, a.shape[1])), r.normal(size=(2, 1)), [("sigmoid", 0.5), ("elliot_symmetric", 0.75)])
    sums = of.sums(a, e)
    for i in range(2):
        for j in range(a.shape[1]):
            step = np.zeros_like(of.inputs)
            step[i, j] = 1e-6
            up, down = (K.Candidates(of.inputs + d, of.outputs, of.kinds).sums(a, e)[-2 + i] for d in (step, -step))
            assert abs(-(up - down) / 4e-6 - sums[i * a.shape[1] + j]) < 1e-3 * max(1, abs(sums[i * a.shape[1] + j]))
        step = np.zeros_like(of.outputs)
        step[i] = 1e-6
        up, down = (K.Candidates(of.inputs, of.outputs + d, of.kinds).sums(a, e)[-2 + i] for d in (step, -step))
        assert abs(-(up - down) / 4e-6 - sums[2 * a.shape[1] + i]) < 1e-3
