import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from polyframe.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WILD = st.text(st.one_of(st.sampled_from("abcst'., \n\t\x1c!_-09ÀéœßΣσİ²½́中😀\U00010edc"), st.characters(exclude_categories=["Cs"])), max_size=40)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


#: Runs of any characters, signs before white space and special strings, in any order.
MIXED = st.lists(st.one_of(WILD, st.sampled_from(["İ, ", "İ. ", "ŉ. ", "i̇, ", "<|endoftext|>", "<|STARTOFTEXT|>", ".\n", ", "])), max_size=6).map("".join)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(WILD, MIXED))
def test_encoding_and_decoding_equal_the_librarys(text):
    ids = ids_of(LIBRARY, text)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert b"".join(i.to_bytes(4, "little") for i in ids) == LIBRARY_CODEC.encode_bytes(text)


LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_padding()
LIBRARY.no_truncation()
CODEC, LIBRARY_CODEC = bpe.Codec(PATH), packing.LibraryCodec(PATH)


@pytest.mark.parametrize("text", ["", " ", "a", "<|endoftext|>", "x<|endoftext|>Y <|STARTOFTEXT|>", "it's  they'LL", "a. b, c.. d_. e", "ⅧⅣ ǅ", "The end.\nNext, line."])
def test_chosen_texts(library, text):
    assert CODEC.encode(text) == ids_of(library, text)


def test_blocks_do_not_show(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 7)
    monkeypatch.setattr(packing, "BLOCK_CHARS", 7)
    text = "Some words here, and é́ longer ones: don't <|endoftext|> stop.\n" * 20
    assert CODEC.encode(text) == ids_of(library, text)
    assert CODEC.encode_bytes(text) == LIBRARY_CODEC.encode_bytes(text)


def test_merging_skips_stale_entries():
    word = "abababab" * 500
    assert CODEC.merge(word) == Tokenizer.from_file(PATH).encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["İ, x", "İ. x", "Aİ, x", "aİ.\nb", "ĲİĲ. Ŀ, x"])
def test_lower_case_that_ends_in_a_mark(library, text):
    assert CODEC.encode(text) == ids_of(library, text)
    assert LIBRARY_CODEC.encode_bytes(text) == CODEC.encode_bytes(text)


def test_caches_start_anew_when_full(library):
    cache = bpe.Cache(len, most=2, longest=3)
    assert [cache[x] for x in ("a", "bb", "ccc", "a", "dddd")] == [1, 2, 3, 1, 4]
    assert len(cache) <= 2 and "dddd" not in cache
    cache = bpe.Cache(len, total=10)
    for k in range(100):
        cache["x" * (1 + k % 9)]
        assert sum(map(len, cache)) <= 10 + 9


def test_long_pieces_are_not_kept(library):
    text = "中文没有空格" * 2000 + " aGVsbG8" * 3 + "x" * 500
    codec = bpe.Codec(PATH)
    assert codec.encode(text) == ids_of(library, text)
    assert all(len(k) <= bpe.CACHE_CHARS for cache in (codec.cache, codec.word_ids) for k in cache)


def test_digests(spark, library):
    long = "word another " * 20000
    rows = [(1, "Hello world."), (2, None), (3, ""), (3, ""), (None, "x"), (4, long)]
    frame = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = sorted(map(tuple, bpe.encode_digests(frame, PATH).collect()), key=str)

    def expected(key, text):
        ids = ids_of(library, text or "")
        return (key, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    assert got == sorted((expected(*r) for r in rows), key=str)
    assert bpe.encode_digests(frame.limit(0), PATH).count() == 0


def test_batches_of_documents(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_TOKENS", 5)
    rows = [(k, "one two three" * (k % 3)) for k in range(20)] + [(None, None)]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted((str(r["id"]), r["ids"]) for r in got) == sorted((str(k), CODEC.encode(t)) for k, t in rows)


def test_documents(spark):
    row = bpe.encode_documents(spark.createDataFrame([(1, "Hi there")], "doc_id long, text string"), PATH).first()
    assert row["ids"] == CODEC.encode("Hi there") and row["decoded"] == CODEC.decode(row["ids"])


@pytest.mark.parametrize("text", ["\U00010d50\U00010d7d", "a\U00010f85́", "ᪿ́x", "\U0001e4ed́", "İ̇", "ẹ́ Ẹ́", "\U00010edcz. b"])
def test_characters_newer_than_pythons_tables(library, text):
    ids = ids_of(library, text)
    assert CODEC.encode(text) == ids
    assert LIBRARY_CODEC.encode_bytes(text) == b"".join(i.to_bytes(4, "little") for i in ids)
