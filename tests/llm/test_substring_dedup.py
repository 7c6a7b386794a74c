import hashlib
import random
from collections import Counter

import pytest

from pairloom.llm import substring_dedup
from pairloom.llm.substring_dedup import _raw, repeated_bytes, segments

SF = "/root/testdata/sf0.001"


def brute(rows, width=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + width] for _, b in texts for p in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = [True] * width
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert sum(r[2] for r in want) > 0 and got(repeated_bytes(docs)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_edits_and_periods(spark, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passage, near = word(900), list(word(1500))
    rows = [(0, passage), (1, word(50) + passage[100:600] + word(300)), (2, passage[:199]), (3, passage[:200]), (4, None), (5, ""), (6, "ab" * 250), (7, word(300) * 2), (None, word(260) + passage[-230:]), (8, "x" * 201), (9, "x" * 200), (10, "y" * 201)]
    for i in range(6):
        x = list(near)
        for _ in range(6):
            x[r.randrange(len(x))] = r.choice("XYZ")
        rows.append((20 + i, "".join(x)))
    rows += [(0, passage), (11, word(400)), (11, word(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeated_bytes(docs.selectExpr("*", "1 as gram", "2 as spans"))) == brute(rows)


def test_hot_gram_by_windows(spark, monkeypatch):
    """The way of grams with more segments than one task takes gives the same bytes."""
    monkeypatch.setattr(substring_dedup, "SEGMENTS", 3)
    r = random.Random(4)
    core = "".join(r.choice("abcdefgh ") for _ in range(420))
    rows = [(i, "".join(r.choice("ijkl") for _ in range(90)) + core[: 230 + 15 * (i % 9)] + "".join(r.choice("mnop") for _ in range(90))) for i in range(30)]
    assert got(repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_text_longer_than_a_piece(spark, monkeypatch):
    """Windows that reach over the end of a piece."""
    r = random.Random(6)
    text = "".join(r.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, text), (2, "x" + text[700:1900] + "y"), (3, text[1500:])]
    want = brute(rows)
    for piece in (97, 1000):
        whole = [segments(_raw(t), 200) for _, t in rows]
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        cut = [segments(_raw(t), 200) for _, t in rows]
        monkeypatch.setattr(substring_dedup, "PIECE", 1 << 22)
        assert all({(g, e) for g, e in zip(a[2].tolist(), a[1].tolist())} <= {(g, e) for g, e in zip(b[2].tolist(), b[1].tolist())} for a, b in zip(whole, cut))
    assert got(repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_empty_table(spark):
    assert repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
