import math
import os
import re

import duckdb
import numpy as np
import pytest

from pairloom.operators import network
from pairloom.plans.catalog import ORACLES, QUERIES
from pairloom.sources.tables import ALIGNMENT, alignments

from .test_operators import column_scores, fold

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert ordered(got.select(*columns).collect()) == ordered(want.select(*columns).fetchall())


def test_what_sql_does_not_cover():
    """These are held against loops, here and in test_operators."""
    assert {n for n in set(QUERIES) - set(ORACLES) if not n.startswith("op") and n != "pipeline"} == {"best_pair_select", "sw_score", "sw_second_best", "sw_cigar", "rprop_train"}


def test_best_pair_query_against_loops(spark):
    fields = [x.split()[0] for x in ALIGNMENT.split(", ")]
    by = {}
    for r in alignments(spark, SF).collect():
        by.setdefault(r.name, ([], []))[r.mate - 1].append(dict(zip(fields, r)))
    key = lambda a: tuple(a[k] for k in ("ref_index", "ref_begin", "ref_end", "is_rev", "map_len", "sw", "mismatches", "quality"))
    got = {r.name: r for r in QUERIES["best_pair_select"](spark, SF).collect()}
    assert set(got) == {n for n, m in by.items() if m[0] and m[1]}
    for name, g in got.items():
        one, two = (sorted(m, key=key) for m in by[name])
        best, second = fold(one, two, 400)
        ranked = [sorted(m, key=lambda a: (a["quality"], key(a)), reverse=True) for m in (one, two)]
        chosen = best[:2] if best else (ranked[0][0], ranked[1][0])
        after = [r[1]["quality"] if len(r) > 1 else 0 for r in ranked]
        if second:
            after = [0 if s == b else s["quality"] for s, b in zip(second[:2], chosen)]
        want = ("pair" if best else "quality", *(x for i in (0, 1) for x in (chosen[i]["ref_index"], chosen[i]["ref_begin"], chosen[i]["quality"], after[i], len((one, two)[i]))), best[2] if best else None)
        assert (g.found_by, g.ref1, g.begin1, g.quality1, g.next_quality1, g.n1, g.ref2, g.begin2, g.quality2, g.next_quality2, g.n2, g.fragment) == want


def test_alignment_queries_against_rows(spark):
    """Row by row over whole texts: the columns of each query letter's best scores."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    one, two, three = ({(r.item_id, r.doc_id): r for r in QUERIES[n](spark, SF).collect()} for n in ("sw_score", "sw_second_best", "sw_cigar"))
    assert one and set(one) == set(two) == set(three)
    for (i, d), r in one.items():
        best, row = column_scores(items[i], texts[d])
        end = int(np.argmax(best))
        assert (r.score, r.ref_end, r.query_end) == (best[end], end, row[end])
        n, rest = len(items[i]), best.copy()
        rest[max(0, end - n) : end + n] = 0
        second = int(np.argmax(rest))
        assert (two[i, d].score, two[i, d].score2, two[i, d].ref_end2) == (best[end], rest[second], second if rest[second] else -1)
        assert three[i, d][2:7] == (best[end], end, row[end], rest[second], second if rest[second] else -1)
        if r.score < 50:
            assert three[i, d].cigar is None
            continue
        at, spot, score = three[i, d].query_begin, three[i, d].ref_begin, 0
        for count, op in re.findall(r"(\d+)(.)", three[i, d].cigar):
            k = int(count)
            if op in "=X":
                assert all((items[i][at + x] == texts[d][spot + x]) == (op == "=") for x in range(k))
                score += 2 * k if op == "=" else -2 * k
            elif op in "ID":
                score -= 3 + k - 1
            at, spot = at + k * (op in "=XI"), spot + k * (op in "=XD")
        assert (score, at - 1, spot - 1) == (r.score, r.query_end, r.ref_end)


def test_alignment_queries_seed_once(spark):
    """The plan that aligns reads the pairs that were found, and doesn't seed again."""
    spark.catalog.clearCache()
    plan = QUERIES["sw_score"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    spark.catalog.clearCache()


def test_training_query_against_loops(spark):
    """Twelve epochs, example by example and weight by weight."""
    rows = [(np.array(r.embedding[:11], float), 1.0 if r.label % 2 == 0 else -1.0) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    net = network.create([11, 8, 1], seed=5)
    a, b = (x.weights.copy() for x in net.layers)
    w = np.concatenate([a.ravel(), b.ravel()])
    step, before, errors = np.full(len(w), 0.1), np.zeros(len(w)), []
    for _ in range(12):
        a, b, ga, gb, squared = w[:96].reshape(8, 12), w[96:].reshape(1, 9), np.zeros((8, 12)), np.zeros((1, 9)), 0.0
        for x, target in rows:
            x1 = np.append(x, 1)
            h = np.tanh(0.5 * (a @ x1))
            h1 = np.append(h, 1)
            y = math.tanh(0.5 * float(b[0] @ h1))
            d = (target - y) / 2
            squared += d * d
            e = math.log((1 + d) / (1 - d)) * 0.5 * (1 - max(-0.98, min(0.98, y)) ** 2)
            gb[0] += e * h1
            ga += np.outer(e * b[0, :8] * 0.5 * (1 - np.clip(h, -0.98, 0.98) ** 2), x1)
        errors.append(squared / len(rows))
        g = np.concatenate([ga.ravel(), gb.ravel()])
        for k in range(len(w)):
            same, was = before[k] * g[k], max(step[k], 1e-4)
            step[k] = min(was * 1.2, 50) if same >= 0 else max(was * 0.5, 0)
            before[k] = g[k] if same >= 0 else 0
            w[k] += -step[k] if before[k] < 0 else step[k]
    got = {r.epoch: r.mse for r in QUERIES["rprop_train"](spark, SF).collect()}
    assert [got[i] for i in range(12)] == pytest.approx(errors, abs=2e-5)


def test_gapped_pairs_hold_whole_texts(spark):
    items = {r.item_id: "".join(c for c in r.text if c.isascii() and c.isalpha()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert max(map(len, items.values())) > 80
    got = {r.item_id: list(r)[1:] for r in QUERIES["gapped_from_cigar"](spark, SF).collect()}
    want = {k: ["".join("-" if i % 13 == 6 else c for i, c in enumerate(t)), "".join("-" if i % 17 == 9 and i % 13 != 6 else "#" if i % 11 == 4 else c for i, c in enumerate(t))] for k, t in items.items() if t}
    assert got == want
