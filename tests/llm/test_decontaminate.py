from pairloom.llm.decontaminate import contained_items, sketch_size

SF = "/root/testdata/sf0.001"
DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def shingles(text, k):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, items, k=5, percent=80):
    out = []
    for d, t in docs:
        w = t.encode().lower().split() if t else []
        for i, x in items:
            s = shingles(x, k)
            n = min(k, len(x.split())) if x else 0
            own = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n else set()
            if s and 100 * len(s & own) >= percent * len(s):
                out.append((d, i, len(s), len(s & own)))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "item_id", "n_item", "n_shared").collect())


def test_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and got(contained_items(docs, items)) == want


def test_partial_scattered_short_and_empty(spark):
    item = [f"w{i}" for i in range(30)]
    long = " ".join(f"z{i}" for i in range(40_000))
    docs = [
        (1, " ".join(item)),
        (2, long + " " + " ".join(item[:15]) + " q " + " ".join(item[15:]) + " " + long),
        (3, " ".join(item[:10]) + " q " + " ".join(item[10:20]) + " r " + " ".join(item[20:])),
        (4, None),
        (5, ""),
        (6, "say  HELLO there"),
        (None, " ".join(item)),
    ]
    items = [(1, " ".join(item)), (2, "hello There"), (3, ""), (4, None)]
    out = got(contained_items(spark.createDataFrame(docs[:6], DOC), spark.createDataFrame(items, ITEM)))
    assert out == brute(docs[:6], items) and (2, 1, 26, 22) in out and (6, 2, 1, 1) in out
    clash = spark.createDataFrame(docs, DOC).selectExpr("*", "1 as item_id", "2 as hash", "3 as n_item")
    assert contained_items(clash, spark.createDataFrame(items, ITEM)).where("doc_id is null").count() == 1


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOC), spark.createDataFrame([(1, "a b")], ITEM)
    assert contained_items(docs.limit(0), items).count() == 0
    assert contained_items(docs, items.limit(0)).count() == 0


def test_sketch_never_misses():
    for n in range(1, 300):
        assert sketch_size(n, 80) > n - -(-n * 80 // 100) or sketch_size(n, 80) == n
