import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm import simple8b
from pairloom.llm.token_files import read_tokens, round_trip, write_tokens
from pairloom.llm.tokenize import Encoder

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_codec_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, first = simple8b.encode(ids)
    assert np.array_equal(simple8b.decode(words), ids)
    assert len(first) == -(-len(ids) // simple8b.BLOCK)


def test_blocks_decode_alone():
    ids = np.random.default_rng(1).integers(0, 50_000, 3 * simple8b.BLOCK + 17).astype(np.uint64)
    ids[5] = ids[simple8b.BLOCK] = np.uint64(2**63 + 5)
    words, first = simple8b.encode(ids)
    assert len(first) == 4 and len(words) < len(ids) / 2
    assert np.array_equal(simple8b.decode(words[first[1] : first[2]]), ids[simple8b.BLOCK : 2 * simple8b.BLOCK])
    ones, _ = simple8b.encode(np.ones(600, np.uint64))
    assert len(ones) == 10


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_ids_are_the_tokenizers_own(spark, path):
    own, plain = Encoder(path), Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["a  b", " a", "a ", "a\n\nb", "a \nb", "a\tb", "a\x1cb c", "it's o'clock.\nDon't!", "x***.y ,z", "ÉTÉ Straße. İ ΑΣ. ΑΣ", "é a ́b", "<|endoftext|> a", "a b c", "“Hi,” 12,345.6 abc123...", "\n", " ", "ab.\ncd ef", "日本語 テキスト。", "tab:\there", "A’s “b”"]
    for t in texts:
        assert own.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'sé.,*# \n\t1²A<|́", max_size=30))
def test_cached_ids_of_odd_texts(text):
    for path in (WORD, BYTE):
        own = test_cached_ids_of_odd_texts.__dict__.setdefault(path, Encoder(path))
        assert own.encode(text) == own.whole(text)


def expected(rows, path):
    plain, start, out = Tokenizer.from_file(path), 0, []
    for doc, text in rows:
        ids = (plain.encode(text, add_special_tokens=False).ids if text else []) + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(tuple(r) for r in round_trip(docs, WORD).collect()) == expected(rows, WORD)


def test_nulls_repeats_clashes_and_empty(spark, tmp_path):
    rows = [(5, "b"), (None, "x"), (5, "b"), (2, None), (3, ""), (9, "word " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as words")
    write_tokens(docs, f"{tmp_path}/t", WORD)
    out = sorted((tuple(r) for r in read_tokens(spark, f"{tmp_path}/t").collect()), key=lambda r: r[1])
    assert [r[:4] for r in out] == expected([(None, "x"), (2, None), (3, ""), (5, "b"), (5, "b"), (9, "word " * 300_000)], WORD)
    assert all(zlib.crc32(np.array(r[4], "<u4").tobytes()) == r[3] and len(r[4]) == r[2] for r in out)
    assert round_trip(docs.limit(0), WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**64 - 1)), min_size=1, max_size=60), st.integers(0, 20_000), st.integers(0, 9_000))
def test_ranges_by_block_offsets(some, start, n):
    ids = np.array((some * (20_000 // len(some) + 1))[:20_000], np.uint64)
    words, first = simple8b.encode(ids)
    n = min(n, len(ids) - start)
    assert np.array_equal(simple8b.decode_range(words, first, start, n), ids[start : start + n])


def test_some_documents_by_their_blocks(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = (tmp_path / "tokens").as_uri()
    write_tokens(docs, path, BYTE)
    whole = {r.doc_id: tuple(r) for r in read_tokens(spark, path).collect()}
    some = sorted(whole)[::17] + [10**9]
    assert {r.doc_id: tuple(r) for r in read_tokens(spark, path, doc_ids=some).collect()} == {d: whole[d] for d in some if d in whole}
