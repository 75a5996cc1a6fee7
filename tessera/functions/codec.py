"""Chunk codecs: deflate, byte shuffle, byte order and XDR widening, for bytes and for Spark columns.

Decoding always runs inflate, unshuffle, slice, byte swap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dtypes import ElementType
from tessera.scratch import map_batches


def inflate(raw: bytes, size: int) -> bytes:
    """A zlib stream, which must give exactly ``size`` bytes."""
    out = zlib.decompress(raw)
    if len(out) != size:
        raise ValueError(f"chunk inflates to {len(out)} bytes, not {size}")
    return out


def deflate(raw: bytes, level: int = 4) -> bytes:
    return zlib.compress(raw, level)


def shuffle(raw: bytes, width: int) -> bytes:
    """Bytes by their place within elements: all first bytes, then all second ones, and so on."""
    return np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes() if width > 1 and raw else raw


def unshuffle(raw: bytes, width: int) -> bytes:
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.tobytes() if width > 1 and raw else raw


def encode_chunk(raw: bytes, width: int, gzip: int | None, shuffled: bool) -> bytes:
    raw = shuffle(raw, width) if shuffled else raw
    return raw if gzip is None else deflate(raw, gzip)


def decode_chunk(raw: bytes, size: int, width: int, gzip: int | None, shuffled: bool) -> bytes:
    """Stored bytes of a chunk to its ``size`` plain bytes."""
    raw = inflate(raw, size) if gzip is not None else raw
    if len(raw) != size:
        raise ValueError(f"chunk has {len(raw)} bytes, not {size}")
    return unshuffle(raw, width) if shuffled else raw


def to_big_endian(values: np.ndarray) -> bytes:
    return values.astype(values.dtype.newbyteorder(">")).tobytes()


def xdr_factor(kind: str, size: int) -> int:
    """Bytes of an XDR-encoded element over its stored bytes."""
    return 4 // size if kind in "iu" and size < 4 else 1


def xdr(raw: bytes, dtype: ElementType) -> bytes:
    """Elements in XDR: integers under four bytes widen to four, all are big-endian; opaque bytes pass."""
    if dtype.kind == "c":
        return raw
    values = dtype.native(raw)
    return to_big_endian(values.astype(f"{dtype.kind}4") if xdr_factor(dtype.kind, dtype.size) > 1 else values)


# The same on columns, without Python workers.


def xdr_factor_column(kind: Column, size: Column) -> Column:
    return F.when(kind.isin("i", "u") & (size < 4), F.floor(F.lit(4) / size).cast("int")).otherwise(F.lit(1))


def xdr_hex(value: Column) -> Column:
    """XDR form of an integer of up to 32 bits, as eight hex digits."""
    return F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")


def byte_swap(value: Column, size: int) -> Column:
    """An integer column of ``size`` bytes (2, 4 or 8) with its bytes reversed; null stays null."""
    kind = {2: "short", 4: "int", 8: "long"}[size]
    v = value.cast("long")
    swapped = F.lit(0).cast("long")
    for k in range(size):
        part = F.shiftright(v, 8 * k).bitwiseAND(F.lit(0xFF))
        swapped = swapped.bitwiseOR(F.shiftleft(part, 8 * (size - 1 - k)))
    if size == 8:
        return swapped
    top = 1 << (8 * size - 1)
    return F.when(swapped >= F.lit(top), swapped - F.lit(2 * top)).otherwise(swapped).cast(kind)


def byte_swap32(value: Column) -> Column:
    """A 32-bit integer with its bytes reversed."""
    return byte_swap(value, 4)


def map_payload(df: DataFrame, column: str, fn) -> DataFrame:
    """``df`` with the bytes of a binary column mapped; nulls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            new = pa.array([None if x is None else fn(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield batch.set_column(at, column, new)

    return map_batches(df, run, df.schema)
