import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer


from pairloom.llm.cutting_stock import column_generation, fillings, knapsack
from pairloom.llm.packing import _place, chosen, make_plan, pack
from pairloom.llm.tokenize import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_every_id_once_and_little_padding(spark):
    odd = [(9000, None), (9001, ""), (9001, ""), (None, "null id"), (9002, "word " * 30_000), (9003, "<|endoftext|> x")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 as rest", "2 as part")
    t = Tokenizer.from_file(PATH)
    want = sorted(((d, np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, x in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is None, x))
    rows = pack(docs, PATH).collect()
    ids = {d: b for d, b in want}
    starts = {}
    for r in rows:
        b = ids[r.doc_id]
        assert r.doc_tokens == len(b) // 4 and zlib.crc32(b[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        starts.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, parts in starts.items():
        if d != 9001:
            at = 0
            for s, n in sorted(parts):
                assert s == at
                at += n
            assert at == len(ids[d]) // 4
    assert len(starts[9001]) == 2 and len(starts) == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024 and (at >= 1016 or at & (at - 1) == 0)
    # pieces of 2^b leave a shorter sequence for each binary digit of 2^(10 - b) at most
    assert sum(sum(n for _, n in p) < 1024 for p in by.values()) <= sum(10 - b for b in range(10)) + sum(1016 <= sum(n for _, n in p) < 1024 for p in by.values())
    assert sum(1024 - sum(n for _, n in p) for p in by.values() if sum(n for _, n in p) >= 1016) < 0.01 * sum(r.length for r in rows)
    assert pack(docs.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=12), st.sampled_from([0, 2]))
def test_plan(histogram, lack):
    plan = make_plan(histogram, 64, lack)
    used = {}
    for n, count in histogram.items():
        for rank in range(count):
            if rank < plan.cut[n]:
                pieces = [(*_place(plan.ranges[n], rank, n), n)]
            else:
                pieces = [(*_place(plan.powers[b], plan.base[b, n] + rank - plan.cut[n], 1 << b), 1 << b) for b in range(6) if n >> b & 1]
            for s, o, size in pieces:
                used.setdefault(s, []).append((o, size))
    for parts in used.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        assert 64 - lack <= at <= 64 or at & (at - 1) == 0 and at < 64
    assert sorted(used) == list(range(len(used)))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.tuples(st.integers(-3, 20), st.integers(1, 3)), min_size=1, max_size=5), st.sampled_from([0, 3]))
def test_knapsack_against_brute_force(items, lack):
    lengths = np.array(sorted(items, reverse=True))
    values, most = np.array([items[n][0] for n in lengths], float), np.array([items[n][1] for n in lengths])
    fits = [c for c in np.ndindex(*(most + 1)) if 20 - lack <= lengths @ c <= 20]
    best = max((values @ c - (20 - lengths @ c) for c in fits), default=None)
    taken = knapsack(lengths, values, most, 20, lack)
    assert (taken is None) == (best is None)
    if taken is not None:
        assert (taken <= most).all() and 20 - lack <= lengths @ taken <= 20 and values @ taken - (20 - lengths @ taken) == best
    for pattern in fillings(lengths, values, 20, lack):
        assert 20 - lack <= lengths[pattern].sum() <= 20


def test_the_program_reaches_its_optimum():
    """Lengths 5, 4, 3 by 10: 5+5, 4+3+3 fill all but a piece that is cut up."""
    columns, share = column_generation([5, 4, 3], np.array([40, 20, 40]), 10, 0, gap=0)
    total = sum(c * x for c, x in columns)
    assert share < 0.01 and np.allclose(total, [40, 20, 40], rtol=1e-3)
    columns, share = column_generation([7, 6], np.array([30, 20]), 10, 0)
    assert not columns and share == 1


def test_patterns_of_the_program_place_nearly_all():
    own = encoder(PATH)
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    rests = np.array([(len(own.encode(t)) // 4 + 1) % 1024 for t in texts])
    lengths, demand = np.unique(rests[rests > 0], return_counts=True)
    lengths, demand = lengths[::-1], demand[::-1]
    columns, share = column_generation(lengths.tolist(), demand, 1024, 8)
    assert share <= 0.01  # over the material bound
    rounded, rest = chosen(lengths.tolist(), demand, 1024, 8)
    by = sum(n * int(c @ lengths) for c, n in rounded)
    all_of = int(lengths @ demand)
    assert by >= 0.9 * all_of and all_of - by - sum(n * int(c @ lengths) for c, n in rest) < 0.01 * all_of
