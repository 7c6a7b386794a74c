import pathlib
import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from pairloom.llm.quality import judged
from pairloom.llm.shingles import shared, shingle_set

from .test_line_dedup import brute as line_brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def near_brute(texts):
    sets = {d: shingle_set(t, 5) for d, t in texts.items()}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a]) and len(sets[b]):
                n = shared(sets[a], sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {d for d in ids if root(d) == d}


def test_each_stage_against_brute_force(spark):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("carried", F.lit(1)).withColumn("of", F.lit(2))
    kept = rows(P.quality(spark, docs, SF))
    assert set(kept) == {r.doc_id for r in judged(docs).collect() if r.kept} and 0 < len(kept) < docs.count()
    before = rows(docs)
    assert all(tuple(r) == tuple(before[d][c] for c in P.COLUMNS) for d, r in kept.items())

    docs = spark.createDataFrame(list(kept.values()), "doc_id long, text string, lang string, source string, n_chars long")
    lined = rows(P.line_dedup(spark, docs, SF))
    want = {x[0]: x for x in line_brute([(d, r.text) for d, r in kept.items()], most=0.5)}
    assert {d: r.text for d, r in lined.items()} == {d: x[5] for d, x in want.items()}
    assert all(r.n_chars == (len(r.text) if want[d][2] else kept[d].n_chars) and r.lang == kept[d].lang for d, r in lined.items())

    docs = spark.createDataFrame(list(lined.values()), docs.schema)
    near = rows(P.near_dedup(spark, docs, SF))
    assert set(near) == near_brute({d: r.text for d, r in lined.items()})

    docs = spark.createDataFrame(list(near.values()), docs.schema)
    clean = rows(P.decontaminate(spark, docs, SF))
    items = [shingle_set(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, r in near.items() if any(100 * shared(i, shingle_set(r.text, 5)) >= 80 * len(i) for i in items if len(i))}
    assert set(clean) == set(near) - leaks

    packed = P.packing(spark, spark.createDataFrame(list(clean.values()), docs.schema), SF).collect()
    assert {r.doc_id for r in packed} == set(clean)


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text + " x", "en", "a", 5), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in P.near_dedup(spark, docs, SF).collect()) == [0, 1]
    assert P.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_texts_of_mostly_repeated_lines_lose_them(spark):
    shared = [f"a line of boilerplate, number {i}: {' '.join(c * 3 for _ in range(9))}" for i, c in enumerate("abcdef")]
    own = lambda c: [" ".join(f"{c}{i}{j}" for j in range(12)) for i in range(4)]
    texts = ["\n".join(shared + own(c)) for c in "xyz"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in P.near_dedup(spark, P.line_dedup(spark, docs, SF), SF).collect()}
    want = [texts[0], *["\n".join(own(c)) for c in "yz"]]
    assert out == {i: (t, len(t)) for i, t in enumerate(want)}


def test_nulls_repeats_empty_and_clashes(spark):
    """Every stage on odd rows whose other columns have the operators' own names."""
    good = " ".join(f"{w}{c}" for c in "abcdefghij" for w in ("river", "stone", "cloud", "garden", "window", "letter", "music", "winter"))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = [(1, good), (1, good), (None, good + " end"), (2, None), (3, ""), (4, " \n"), (None, None), (5, item), (5, good + " other"), (6, "x" * 100_000)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", "1 as of", "2 as carried", "3 as kept", "4 as rest", "5 as gone", "6 as hash", "7 as item_id", "8 as own")
    count = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert count(P.quality(spark, clash, SF)) == sorted([x for x in odd if x[1] and x[1].startswith("river")], key=str)
    lined = P.line_dedup(spark, clash, SF)
    assert lined.columns == list(P.COLUMNS) and lined.count() == len(odd)
    near = P.near_dedup(spark, clash, SF)
    assert near.columns == list(P.COLUMNS) and {r.doc_id for r in near.collect()} == {None, 1, 2, 3, 4, 6} and near.where("doc_id = 1").count() == 1
    clean = P.decontaminate(spark, clash, SF)
    assert clean.columns == list(P.COLUMNS) and count(clean) == sorted([x for x in odd if x[0] != 5], key=str)
    packed = P.packing(spark, clash, SF)
    assert packed.where("start = 0").count() == len(odd)
    for _, stage in P.STAGES:
        assert stage(spark, clash.limit(0), SF).count() == 0


def test_run_leaves_only_the_last_table(spark, tmp_path):
    out = P.run(spark, SF)
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    found = [str(p) for p in pathlib.Path(root).rglob("*_*") if re.fullmatch(r"\d_[a-z_]+", p.name)]
    assert out.count() > 0 and [p.rsplit("/", 1)[1] for p in found] == ["4_packing"]
