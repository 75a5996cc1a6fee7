"""Index arithmetic of chunked row-major arrays, on numbers and on columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.extents import index_names


def strides(shape: Sequence[int]) -> list[int]:
    """Elements that one step along each dimension skips."""
    out = [1] * len(shape)
    for j in range(len(shape) - 2, -1, -1):
        out[j] = out[j + 1] * shape[j + 1]
    return out


def chunk_counts(shape: Sequence[int], chunk_shape: Sequence[int]) -> list[int]:
    return [math.ceil(n / c) for n, c in zip(shape, chunk_shape, strict=True)]


def strides_column(shape: Column) -> Column:
    """The same for an array column of shapes."""
    tail = lambda j: F.slice(shape, j + 2, F.greatest(F.size(shape) - j - 1, F.lit(0)))
    each = F.transform(F.sequence(F.lit(0), F.size(shape) - 1), lambda j: F.aggregate(tail(j), F.lit(1).cast("long"), lambda a, x: a * x))
    return F.when(F.size(shape) > 0, each).otherwise(F.array().cast("array<bigint>"))


def size_column(shape: Column) -> Column:
    """Number of elements; one for a scalar, whose shape is empty."""
    return F.aggregate(shape.cast("array<bigint>"), F.lit(1).cast("long"), lambda a, n: a * n)


def is_scalar(shape: Column) -> Column:
    return F.size(shape) == 0


def ravel(indices: Sequence[Column], shape: Sequence[int]) -> Column:
    out = F.lit(0).cast("long")
    for i, s in zip(indices, strides(shape), strict=True):
        out = out + i * F.lit(s)
    return out


def unravel(flat: str, shape: Sequence[int]) -> list[Column]:
    """Indices of a row-major position, named i0, i1, ..."""
    parts = [F.expr(f"CAST({flat} AS bigint) div {s}") for s in strides(shape)]
    return [(p % F.lit(n)).cast("long").alias(f"i{j}") for j, (p, n) in enumerate(zip(parts, shape, strict=True))]


def cells_from_table(df: DataFrame, key: str, value: str, shape: Sequence[int]) -> DataFrame:
    """A table with a dense key 0..n-1 as cells (i0, ..., value) of an array of ``shape``."""
    return df.select(*unravel(f"`{key}`", shape), F.col(value).alias("value"))


def cells_from_arrays(df: DataFrame, key: str, values: str) -> DataFrame:
    """A table with one array per key as cells (i0, i1, value)."""
    return df.select(F.col(key).cast("long").alias("i0"), F.posexplode(values).alias("i1", "value")).select("i0", F.col("i1").cast("long").alias("i1"), "value")


def chunk_ordinal(indices: Sequence[Column], shape: Sequence[int], chunk_shape: Sequence[int]) -> Column:
    """The chunk of a cell, by arithmetic: its number in row-major order of chunks."""
    out = F.lit(0).cast("long")
    for i, c, s in zip(indices, chunk_shape, strides(chunk_counts(shape, chunk_shape)), strict=True):
        out = out + F.floor(i / F.lit(c)) * F.lit(s)
    return out


def place_in_chunk(indices: Sequence[Column], chunk_shape: Sequence[int]) -> Column:
    """Element position within the chunk, which is stored whole even at an edge."""
    out = F.lit(0).cast("long")
    for i, c, s in zip(indices, chunk_shape, strides(chunk_shape), strict=True):
        out = out + (i % F.lit(c)) * F.lit(s)
    return out


def contains(indices: Sequence[Column], offset: Sequence[Column], chunk_shape: Sequence[int]) -> Column:
    """-1, 0 or 1: whether a cell comes before, lies in, or comes after a chunk; the first dimension outside decides."""
    out = F.lit(0)
    for i, o, c in reversed(list(zip(indices, offset, chunk_shape, strict=True))):
        out = F.when(i < o, -1).when(i >= o + F.lit(c), 1).otherwise(out)
    return out


def chunk_grid(spark: SparkSession, shape: Sequence[int], chunk_shape: Sequence[int], start: Sequence[int] | None = None, count: Sequence[int] | None = None) -> DataFrame:
    """Chunks (chunk_id, offset array, o0.., l0..) of an array, or those that a selection touches.

    ``l`` is the clipped size of a chunk. Chunks are enumerated by arithmetic on a range, in parallel.
    """
    rank = len(shape)
    start, count = start or [0] * rank, list(shape) if count is None else count
    if not all(count):
        first, many = [0] * rank, [0] * rank
    else:
        first = [s // c for s, c in zip(start, chunk_shape, strict=True)]
        many = [(s + n - 1) // c - f + 1 for s, n, c, f in zip(start, count, chunk_shape, first, strict=True)]
    touched = math.prod(many) if all(count) else 0
    ids = unravel("id", many) if touched else [F.lit(0).cast("long").alias(n) for n in index_names(rank)]
    df = spark.range(touched).select(*[(c + F.lit(f)).alias(f"k{j}") for j, (c, f) in enumerate(zip(ids, first, strict=True))])
    number = ravel([F.col(f"k{j}") for j in range(rank)], chunk_counts(shape, chunk_shape))
    offs = [(F.col(f"k{j}") * F.lit(c)).cast("long") for j, c in enumerate(chunk_shape)]
    array = F.array(*offs) if rank else F.array().cast("array<bigint>")
    clipped = [F.least(F.lit(c), F.lit(n) - o).cast("long").alias(f"l{j}") for j, (o, c, n) in enumerate(zip(offs, chunk_shape, shape, strict=True))]
    return df.select(number.alias("chunk_id"), array.alias("offset"), *[o.alias(f"o{j}") for j, o in enumerate(offs)], *clipped)


def validity(chunks: DataFrame, shape: Sequence[int], chunk_shape: Sequence[int]) -> DataFrame:
    """One row: whether all offsets are chunk-aligned and inside, and every chunk is there once."""
    aligned = F.lit(True)
    for j, (n, c) in enumerate(zip(shape, chunk_shape, strict=True)):
        o = F.col("offset")[j]
        aligned = aligned & (o % c == 0) & (o >= 0) & (o < n)
    whole = math.prod(chunk_counts(shape, chunk_shape))
    return chunks.agg(
        F.coalesce(F.bool_and(aligned), F.lit(True)).alias("aligned"),
        ((F.count("*") == whole) & (F.countDistinct("offset") == whole)).alias("complete"),
    ).withColumn("valid", F.col("aligned") & F.col("complete"))
