import random
from collections import Counter

from pairloom.llm.bwt_merge import build, intervals, merge, repeated_places


def brute(rows, width):
    places = [(d, i, t[i : i + width]) for d, t in rows for i in range(len(t) - width + 1)]
    n = Counter(p[2] for p in places)
    return sorted((d, i) for d, i, s in places if n[s] > 1)


def texts(seed, n=20):
    r = random.Random(seed)
    shared = bytes(r.choices(b"abc", k=60))
    return [bytes(r.choices(b"ab", k=r.randrange(60))) + (shared if r.random() < 0.4 else b"") + bytes(r.choices(b"xyz", k=r.randrange(9))) for _ in range(n)] + [b"", b"a" * 80, b"a" * 81, shared, shared]


def test_merge_of_two_and_of_three():
    for seed in range(8):
        for width in (1, 7, 40):
            rows = list(enumerate(texts(seed)))
            parts = [build([t for _, t in rows[k::3]], [d for d, _ in rows[k::3]]) for k in range(3)]
            both, _ = merge(parts[0], parts[1], width)
            whole, common = merge(both, parts[2], width)
            got = sorted((int(whole.doc[i]), int(whole.at[i])) for s, e in intervals(common, width) for i in range(s, e))
            assert got == brute(rows, width)
            for i in range(1, len(common)):  # the common prefixes themselves
                a, b = (dict(rows)[int(whole.doc[j])][int(whole.at[j]) :] for j in (i - 1, i))
                n = 0
                while n < min(len(a), len(b), width) and a[n] == b[n]:
                    n += 1
                assert common[i] == n


def test_in_spark(spark):
    rows = [(i, t.decode()) for i, t in enumerate(texts(3))] + [(90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([(d, t.encode()) for d, t in rows if t is not None], 20)
    assert sorted((r.doc_id, r.start) for r in repeated_places(docs, width=20, shards=3).collect()) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_places(docs, width=20, shards=1).count() == 0
