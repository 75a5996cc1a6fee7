import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import codec, conventions
from tessera.functions.dtypes import ElementType


def test_shuffle_of_big_endian_ints():
    raw = np.array([1, 23, 43, 56, 35], ">i4").tobytes()
    assert codec.shuffle(raw, 4) == bytes(15) + bytes([0x01, 0x17, 0x2B, 0x38, 0x23])
    assert codec.unshuffle(codec.shuffle(raw, 4), 4) == raw


@pytest.mark.parametrize("width", [1, 2, 3, 4, 8, 16])
def test_chunk_codecs_round_trip(width):
    raw = np.random.default_rng(1).integers(0, 255, 48 * width, dtype=np.uint8).tobytes()
    for gzip in (None, 1, 9):
        for shuffled in (False, True):
            stored = codec.encode_chunk(raw, width, gzip, shuffled)
            assert codec.decode_chunk(stored, len(raw), width, gzip, shuffled) == raw


def test_wrong_sizes_are_errors():
    with pytest.raises(ValueError):
        codec.decode_chunk(b"abc", 4, 1, None, False)
    with pytest.raises(ValueError):
        codec.inflate(codec.deflate(b"abc"), 4)
    with pytest.raises(ValueError):
        ElementType("i", 4).native(b"abc")


def test_xdr():
    assert [codec.xdr_factor(k, s) for k, s in (("i", 2), ("i", 4), ("u", 1), ("u", 2), ("u", 4), ("c", 1))] == [2, 1, 4, 2, 1, 1]
    assert codec.xdr(np.array([1, -2], "<i2").tobytes(), ElementType("i", 2)) == b"\0\0\0\1\xff\xff\xff\xfe"
    assert codec.xdr(bytes([0, 10]), ElementType("u", 1)) == b"\0\0\0\0\0\0\0\n"
    assert codec.xdr(np.array([0, 10], "<f4").tobytes(), ElementType("f", 4)) == np.array([0, 10], ">f4").tobytes()
    assert codec.xdr(b"ab", ElementType("c", 1)) == b"ab"


def test_byte_swap_column(spark):
    values = [0, 1, -1, 255, 256, 2**31 - 1, -(2**31), 0x01020304]
    df = spark.createDataFrame([(v,) for v in values], "v int").select("v", codec.byte_swap32(F.col("v")).alias("s"))
    for r in df.collect():
        assert r["s"] == int(np.array([r["v"]], np.int32).byteswap()[0])


def test_element_types():
    assert ElementType.parse(">i2") == ElementType("i", 2, "BE")
    assert ElementType.parse("u1").spark.simpleString() == "smallint"
    assert ElementType.parse("<u8").spark.simpleString() == "decimal(20,0)"
    assert ElementType.parse(">f8").native(np.array([1.5], ">f8").tobytes())[0] == 1.5


def test_fill_value_resolution():
    assert conventions.resolve_fill_value({"_FillValue": 1, "units": "m"}) == (1, {"units": "m"})
    assert conventions.resolve_fill_value({"missing_value": 2, "_FillValue": 2}) == (2, {})
    assert conventions.resolve_fill_value({}) == (None, {})
    with pytest.raises(ValueError):
        conventions.resolve_fill_value({"missing_value": 2, "_FillValue": 3})


def test_fill_values(spark):
    df = spark.createDataFrame([(1, 1.0), (-9, float("nan")), (None, -9.0)], "i int, d double")
    rows = df.select(conventions.apply_fill_value(F.col("i"), -9).alias("i"), conventions.apply_fill_value(F.col("d"), float("nan")).alias("n"), conventions.mask_and_scale(F.col("d"), 2, 1, -9.0).alias("s")).collect()
    assert [r["i"] for r in rows] == [1, None, None]
    assert [r["n"] for r in rows] == [1.0, None, -9.0]
    assert rows[0]["s"] == 3.0 and math.isnan(rows[1]["s"]) and rows[2]["s"] is None


def test_times(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (None,)], "t double")
    got = [r[0] for r in df.select(conventions.decode_times(F.col("t"), "days since 2000-01-01T00:00:00Z").cast("string")).collect()]
    assert got == ["2000-01-01 00:00:00", "2000-01-02 12:00:00", None]
    with pytest.raises(ValueError):
        conventions.parse_time_units("fortnights since 2000-01-01")
