import random
import re

import numpy as np

from pairloom.llm.sentence_dedup import repeated_sentences, run_hashes


def cut(text):
    parts = re.split(r"(?<=[.!?])[ \t\r]+|\n", text or "")
    return [s for s in (re.sub(r"[ \t\r]+", " ", p).strip(" ") for p in parts) if s]


def brute(rows, width=3):
    first, runs = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        s = cut(t)
        for i in range(max(len(s) - width, 0) + 1 if s else 0):
            run = tuple(s[i : i + width])
            first.setdefault(run, (d, i))
            runs.setdefault(d, []).append((i, run))
    out = {}
    for d, t in rows:
        s = cut(t)
        gone = sorted({j for i, run in runs.get(d, []) if first[run] != (d, i) for j in range(i, min(i + width, len(s)))})
        out[d] = (len(s), gone, " ".join(x for i, x in enumerate(s) if i not in gone) if gone else t)
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(9000, None), (9001, ""), (9002, " \n "), (9003, "A b. C d! E f? G."), (9004, "Z. A b.\tC d!  E f? Q."), (9005, "x. " * 9), (9006, "only"), (9007, "only")]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 as own", "2 as s", "3 as h0")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_sentences, list(r.removed), r.kept_text) for r in repeated_sentences(docs).collect()}
    assert got == want and want[9004][1] and want[9007][1] == [0] and any(v[1] for k, v in want.items() if k < 9000)


def test_equal_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "A. B. C."), (1, "A. B. C."), (None, "A. B. C.")], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeated_sentences(docs).collect()) == [0, 3, 3]
    assert repeated_sentences(docs.limit(0)).count() == 0


def test_long_passages_of_few_sentences_go(spark):
    """Against shared windows of 50 words, texts of one and two sentences and unpunctuated ones."""
    w = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    two, one, tail = f"{w('p', 39)}. {w('q', 27)}.", w("r", 50) + ".", w("s", 70)
    texts = [f"A a. {two} B b.", f"C c. {two} D d.", f"E e. {one} F f.", f"G g. {one} H h.", f"{w('t', 30)} {tail} {w('u', 9)}", f"{w('v', 61)} {tail}. I i.", f"J j. {w('x', 24)}. {w('y', 25)}. K k.", f"L l. {w('x', 24)}. {w('y', 25)}. M m.", f"N {w('a', 80)}. O o.", f"P {w('a', 80)}. O o. Q q."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in repeated_sentences(docs, min_words=50).collect()}
    want = dict(enumerate(texts)) | {1: "C c. D d.", 3: "G g. H h.", 5: f"{w('v', 61)} {w('s', 70).split()[-1]}. I i.", 9: "P Q q."}
    assert got == want


def test_planted_passages_of_50_to_80_words_go(spark):
    """Cut anywhere out of a text of sentences of 3 to 40 words, between others: what is left of
    them is at most what lies in sentences that are cut at both ends of the passage."""
    r = random.Random(12)

    def prose(n, tag):
        words = [f"{tag}{r.randrange(10**6)}" for _ in range(n)]
        at = 0
        while at < n:
            at += r.randrange(3, 40)
            words[min(at, n) - 1] += "."
        return words

    rows, planted = [], []
    for i in range(60):
        passage = prose(r.randrange(50, 81), "p")
        passage[-1] = passage[-1].rstrip(".") + "."
        planted.append(passage)
        for side in range(2):
            before, after = prose(40, "b"), prose(40, "a")
            before[-1] = before[-1].rstrip(".") + "."
            rows.append((2 * i + side, " ".join([*before, *passage, *after])))
    got = {x.doc_id: x for x in repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string"), min_words=50).collect()}
    left = [sum(w in set(got[2 * i + 1].kept_text.split()) for w in p) / len(p) for i, p in enumerate(planted)]
    assert sum(x < 0.1 for x in left) >= 0.95 * len(left)
    assert all(got[2 * i].n_removed == 0 for i in range(60))


def test_very_long_unpunctuated_text(spark):
    words = [f"w{i}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[50_000:50_060], "y"])), (3, " ".join(["z", *words[70_000:70_049], "q"]))]
    got = {x.doc_id: x.kept_text for x in repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string"), min_words=50).collect()}
    assert got == {1: rows[0][1], 2: "x y", 3: rows[2][1]}


def test_run_hashes_tell_runs_apart():
    parts = ["a", "b", "a", "b", "c"]
    run = np.array([(s << 32) | n for s, n in ((0, 2), (2, 2), (1, 2), (0, 1), (2, 1), (0, 5))], np.int64)
    h = [tuple(x) for x in run_hashes(parts, run).tolist()]
    assert h[0] == h[1] and h[3] == h[4] and len(set(h)) == 4


def test_passages_that_begin_and_end_within_sentences_go(spark):
    """52 words over three sentences of which only one is whole, of 20 words."""
    w = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passage = f"{w('p', 16)}. {w('q', 20)}. {w('r', 16)}"
    texts = [f"{w('a', 15)} {passage} {w('b', 15)}.", f"{w('c', 9)} {passage} {w('d', 30)}.", f"{w('e', 20)}.\n{passage.replace('. ', '.\n')}. F."]
    got = {r.doc_id: r for r in repeated_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_words=50).collect()}
    assert {d: r.kept_text for d, r in got.items()} == {0: texts[0], 1: f"{w('c', 9)} {w('d', 30)}.", 2: f"{w('e', 20)}. r15. F."}
    assert [got[d].n_removed for d in range(3)] == [0, 16 + 1 + 16, 1 + 1 + 15]
    assert got[1].n_sentences == 9 + 16 + 1 + 16 + 30 and list(got[2].removed) == [1, 2, *range(3, 18)]


def test_windows_against_brute_force(spark):
    """Words under a later window of 20 words or a later run of three sentences, and no others."""
    r = random.Random(5)
    word = lambda: r.choice("abcdefghij") * r.randrange(1, 3) + r.choice(["", "", "", "", ".", "\n", "! "])
    pool = [[word() for _ in range(r.randrange(10, 120))] for _ in range(30)]
    rows = []
    for d in range(250):
        words = [word() for _ in range(r.randrange(40))]
        for p in r.sample(pool, 3):
            a = r.randrange(len(p))
            words += p[a : a + r.randrange(60)] + [word() for _ in range(r.randrange(25))]
        rows.append((d, " ".join(words)))
    rows += [(900, "a " * 90), (901, "x. " * 30), (902, "a b " * 30)]
    first, at = {}, []
    for d, text in rows:
        sizes = [len(s.split()) for s in cut(text)]
        words, edge = text.split(), np.concatenate(([0], np.cumsum(sizes)))
        runs = [(i, i + 20) for i in range(len(words) - 19)]
        keys = [(tuple(words[a:b]),) for a, b in runs]
        for i in range(max(len(sizes) - 3, 0) + 1 if sizes else 0):
            runs.append((int(edge[i]), int(edge[min(i + 3, len(sizes))])))
            keys.append(tuple(cut(text)[i : i + 3]) + (None,))
        for run, key in zip(runs, keys):
            first[key] = min(first.get(key, (d, run)), (d, run))
        at.append((d, words, list(zip(runs, keys))))
    want = {d: " ".join(w for i, w in enumerate(words) if not any(a <= i < b for (a, b), k in found if first[k] != (d, (a, b)))) for d, words, found in at}
    got = {x.doc_id: " ".join(x.kept_text.split()) for x in repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), min_words=20).collect()}
    assert got == want and 20 < sum(want[d] != " ".join(t.split()) for d, t in rows) < 253
