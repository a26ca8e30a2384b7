import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polyframe.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(lengths, window):
    sequences = packing.plan(lengths, window)
    seen = [[] for _ in lengths]
    for sequence in sequences:
        size = sum(n for _, _, n in sequence)
        assert 0 < size <= window
        assert size == window or size & (size - 1) == 0  # no padding at all
        for doc, start, n in sequence:
            assert n > 0
            seen[doc].append((start, n))
    for length, own in zip(lengths, seen, strict=True):
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == length


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([64, 128]))
def test_every_token_lies_in_one_piece(lengths, window):
    check_plan(lengths, window)


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4095] * 9, [2048] * 3, [3000, 3100] * 500, [3] * 5000])
def test_chosen_lengths(lengths):
    check_plan(lengths, 4096)


def test_least_squares_is_not_negative_and_fits():
    a = packing.fills(8, 3)
    assert (a.T @ np.arange(1, 9) == 8).all()
    wanted = np.zeros(a.shape[1])
    wanted[[1, 4, 7]] = [3, 5, 2]
    x = packing.nnls(a, a @ wanted, rounds=4000)
    assert (x >= 0).all()
    assert np.abs(a @ x - a @ wanted).max() < 0.1


def test_documents(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (None, "x y z"), (4, "many words " * 9000)]
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, start int, length string").repartition(2)
    pieces = packing.pack_digests(frame, PATH).collect()
    full = packing.pack_documents(frame, PATH).collect()
    assert [p[:9] for p in full] == [tuple(p) for p in pieces]
    assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] for p in full)
    codec = bpe.Codec(PATH)
    long = [p for p in full if p["doc_id"] == 4]
    assert b"".join(p["ids"] for p in sorted(long, key=lambda p: p["start"])) == codec.encode_bytes(rows[5][1]) + (2).to_bytes(4, "little")
    assert sum(p["length"] for p in pieces) == sum(len(codec.encode(t)) + 1 for _, t in rows)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.pack_digests(frame.limit(0), PATH).count() == 0


def test_shards_are_bounded(spark, monkeypatch):
    frame = spark.createDataFrame([(k, "word " * 50) for k in range(200)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(packing, "SHARD_TOKENS", 1000)
    pieces = packing.pack_digests(frame, PATH).collect()
    assert sum(p["length"] for p in pieces) == 200 * 51
    assert len({p["sequence_id"] for p in pieces}) == len({(p["sequence_id"], p["offset"]) for p in pieces if p["offset"] == 0})


@pytest.fixture(scope="module")
def lengths():
    import duckdb

    codec = packing.LibraryCodec(PATH)
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' ORDER BY doc_id").fetchall()
    return [len(codec.encode_bytes(t)) // 4 + 1 for (t,) in texts]


def test_most_documents_are_placed_by_combinations(lengths):
    width = packing.WINDOW // packing.CLASSES
    pools = [[] for _ in range(packing.CLASSES)]
    rests = [n % packing.WINDOW for n in lengths if n % packing.WINDOW]
    for k, n in enumerate(rests):
        pools[-(-n // width) - 1].append((k, 0, n))
    built = packing.combined(pools)
    placed = sum(map(len, built))
    print(f"{placed / len(rests):.1%} of {len(rests)} documents placed by combinations")
    assert placed >= 0.8 * len(rests)
    assert placed + sum(map(len, pools)) == len(rests)
    assert all(sum(n for _, _, n in w) <= packing.WINDOW for w in built)


def test_documents_of_the_table(lengths):
    check_plan(lengths, packing.WINDOW)


def test_combinations_fill_their_window():
    ways = packing.fills(packing.CLASSES, packing.DEPTH)
    assert (ways.T @ np.arange(1, packing.CLASSES + 1) == packing.CLASSES).all()
    assert len({tuple(w) for w in ways.T}) == ways.shape[1]
    assert ((ways > 0).sum(axis=0) <= packing.DEPTH).all()
