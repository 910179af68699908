"""Known answers and exhaustive sweeps for both implementations of the codecs."""

import numpy as np
import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annomat.functions import bitpack, codecs

NONE = 4294967295


def test_zigzag_known():
    values = np.array([0, 1, -1, 2, -2, 2147483647, -2147483648])
    coded = bitpack.zigzag(values)
    assert coded.tolist() == [0, 2, 1, 4, 3, NONE - 1, NONE]
    assert bitpack.unzigzag(coded).tolist() == values.tolist()


def test_zigzag_column(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, -1, 2, -2, 2147483647, -2147483648)], "v long")
    out = df.select("v", codecs.zigzag(F.col("v")).alias("z")).select("v", "z", codecs.unzigzag(F.col("z")).alias("back")).collect()
    assert [r["z"] for r in out] == [0, 2, 1, 4, 3, NONE - 1, NONE]
    assert all(r["v"] == r["back"] for r in out)


def test_known_words():
    index = np.array([0, 2, 1, 0, 3, 1, 2, 3])
    data, begin, starts = bitpack.encode_d1z(index)
    assert data[:4].tolist() == [48, 28, 17, 17] and starts.tolist() == [0] and begin.tolist() == [0, 12]
    assert bitpack.decode_d1z(data, begin, starts)[:8].tolist() == index.tolist()
    tail = np.array([4294967280, 4294967260, 4294967273, 4294967290, *[NONE] * 8], np.uint32)  # unused places hold ones
    assert bitpack.decode_frame(tail, np.array([0, 12]))[:8].tolist() == [1, 5, 2, 3, 7, 4, 6, 8]
    edge = np.array([2863311528, *[2863311530] * 7], np.uint32)
    assert bitpack.decode_d1z(edge, np.array([0, 8]), np.array([0])).tolist() == list(range(128))


@pytest.mark.parametrize("width", range(33))
def test_every_width(width):
    rng = np.random.default_rng(width)
    chunk = rng.integers(0, 1 << width, (3, 128), dtype=np.uint64).astype(np.uint32) if width else np.zeros((3, 128), np.uint32)
    words = bitpack.pack(chunk, width)
    assert words.shape == (3, 4 * width) and (bitpack.unpack(words, width) == chunk).all()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 256, 10_000])
def test_every_length(n):
    v = np.random.default_rng(n).integers(0, 1 << 31, n).astype(np.uint32)
    data, begin, starts = bitpack.encode_d1z(v)
    assert bitpack.decode_d1z(data, begin, starts)[:n].tolist() == v.tolist()
    data, begin = bitpack.encode_frame(v)
    assert bitpack.decode_frame(data, begin)[:n].tolist() == v.tolist()


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(0, (1 << 31) - 1), max_size=300))
def test_any_stream(values):
    v = np.array(values, np.uint32)
    data, begin, starts = bitpack.encode_d1z(v)
    assert bitpack.decode_d1z(data, begin, starts)[: len(v)].tolist() == values


def test_empty_chunks_decode():
    assert set(bitpack.decode_frame(np.empty(0, np.uint32), np.zeros(267, np.int64)).tolist()) == {1}
    assert bitpack.decode_d1z(np.empty(0, np.uint32), np.zeros(4, np.int64), np.array([5, 6, 7])).tolist() == [5] * 128 + [6] * 128 + [7] * 128


def test_columns_agree_with_arrays(spark):
    """A stream with one chunk of every width, through the DataFrame algebra and through numpy."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 1 << b, 128, dtype=np.uint64) if b else np.zeros(128, np.uint64) for b in range(33)] + [np.array([9, 0, NONE], np.uint64)])
    df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(values)], "k long, v long")
    coded = codecs.frame(df)
    words, begin = bitpack.encode_frame(values.astype(np.uint32))
    packed = codecs.pack(coded)
    got = {(r["c"], r["pos"]): r["word"] for r in packed.collect()}
    want = {(c, p): int(words[begin[c] + p]) for c in range(len(begin) - 1) for p in range(begin[c + 1] - begin[c])}
    assert got == want
    assert rows(codecs.word_offsets(coded), "c", "idx") == sorted([[k, int(b)] for k, b in enumerate(begin)], key=repr)
    back = codecs.undo_frame(codecs.unpack(packed, codecs.chunk_table(coded)))
    assert sorted((r["k"], r["v"]) for r in back.collect()) == list(enumerate(values.tolist()))


def test_deltas_cross_chunks(spark):
    v = [(k * 37) % 1000 for k in range(300)]
    df = spark.createDataFrame(list(enumerate(v)), "k long, v long")
    coded, starts = codecs.d1z(df), codecs.d1z_starts(df)
    assert sorted((r["c"], r["start"]) for r in starts.collect()) == [(0, 0), (1, v[127]), (2, v[255])]
    back = codecs.undo_d1z(codecs.unpack(codecs.pack(coded), codecs.chunk_table(coded)), starts)
    assert sorted((r["k"], r["v"]) for r in back.collect()) == list(enumerate(v))
