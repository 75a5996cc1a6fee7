"""Scan plans: the contiguous runs of chunks whose concatenation is a selection in row-major order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.grid import chunk_grid, chunk_ordinal, place_in_chunk, ravel, strides


def segments_of_cells(cells: DataFrame, start: Sequence[int], count: Sequence[int], shape: Sequence[int], chunk_shape: Sequence[int]) -> DataFrame:
    """Segments from selected cells by their definition: the maximal runs, in output order, of one chunk
    and consecutive places in it. A global window: for small selections and for testing."""
    idx = [F.col(f"i{j}") for j in range(len(shape))]
    rows = cells.select(
        ravel([i - F.lit(s) for i, s in zip(idx, start, strict=True)], count).alias("dst"),
        chunk_ordinal(idx, shape, chunk_shape).alias("chunk_id"),
        place_in_chunk(idx, chunk_shape).alias("src"),
    )
    w = Window.orderBy("dst")
    new = (F.lag("chunk_id").over(w).isNull()) | (F.lag("chunk_id").over(w) != F.col("chunk_id")) | (F.lag("src").over(w) + 1 != F.col("src"))
    rows = rows.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("run").agg(
        F.min("chunk_id").alias("chunk_id"), F.min("dst").alias("dst_offset"), F.min("src").alias("src_start"), (F.max("src") + 1).alias("src_end")
    ).drop("run")


def segments(spark: SparkSession, start: Sequence[int], count: Sequence[int], shape: Sequence[int], chunk_shape: Sequence[int]) -> DataFrame:
    """The same in closed form: (chunk_id, dst_offset, src_start, src_end), without touching cells.

    Each chunk that the selection touches is cut by it to a box. Trailing dimensions in which the box
    spans the whole (unclipped) chunk and the whole selection join into one run with the dimension before
    them; each combination of the remaining outer indices is a run. Edge chunks never merge across their
    padding. All by arithmetic on a range of chunks, in parallel.
    """
    rank = len(shape)
    if rank == 0:
        return spark.range(1).selectExpr("0L AS chunk_id", "0L AS dst_offset", "0L AS src_start", "1L AS src_end")
    grid = chunk_grid(spark, shape, chunk_shape, start, count)
    for j in range(rank):
        low = F.greatest(F.col(f"o{j}"), F.lit(start[j]).cast("long"))
        high = F.least(F.col(f"o{j}") + F.lit(chunk_shape[j]), F.lit(start[j] + count[j]).cast("long"))
        grid = grid.withColumn(f"b{j}", low).withColumn(f"n{j}", high - low)
    # The dimension along which runs lie: all after it are spanned.
    axis, spanned = F.lit(rank - 1), F.lit(True)
    for j in range(rank - 1, 0, -1):
        spanned = spanned & (F.col(f"n{j}") == chunk_shape[j]) & (F.col(f"n{j}") == count[j])
        axis = F.when(spanned, j - 1).otherwise(axis)
    grid = grid.withColumn("axis", axis)
    outer, length = F.lit(1).cast("long"), F.lit(1).cast("long")
    for j in range(rank):
        outer = outer * F.when(F.col("axis") > j, F.col(f"n{j}")).otherwise(F.lit(1))
        length = length * F.when(F.col("axis") <= j, F.col(f"n{j}")).otherwise(F.lit(1))
    grid = grid.withColumn("length", length).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), outer - 1)))
    rest, dst, src = F.col("o"), F.lit(0).cast("long"), F.lit(0).cast("long")
    for j in range(rank - 1, -1, -1):
        n = F.when(F.col("axis") > j, F.col(f"n{j}")).otherwise(F.lit(1))
        i = F.col(f"b{j}") + rest % n
        dst = dst + (i - F.lit(start[j])) * F.lit(strides(count)[j])
        src = src + (i - F.col(f"o{j}")) * F.lit(strides(chunk_shape)[j])
        rest = F.floor(rest / n)
    return grid.select("chunk_id", dst.alias("dst_offset"), src.alias("src_start"), (src + F.col("length")).alias("src_end"))


def by_chunk(planned: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments gathered by chunk, with its address: each chunk is read and decoded once.

    (addr, size, chunk_id, segments array<struct<dst_offset, src_start, src_end>>), and file if ``chunks`` has it; a
    chunk's segments are bounded by its elements.
    """
    runs = F.array_sort(F.collect_list(F.struct("dst_offset", "src_start", "src_end")))
    grouped = planned.groupBy("chunk_id").agg(runs.alias("segments"))
    where = ["addr", "size", *(["file"] if "file" in chunks.columns else [])]
    return grouped.join(chunks.select("chunk_id", *where), "chunk_id").select(*where, "chunk_id", "segments")


def with_destinations(planned: DataFrame) -> DataFrame:
    """Destination offsets anew, as running sums of lengths in output order."""
    w = Window.orderBy("dst_offset").rowsBetween(Window.unboundedPreceding, -1)
    return planned.withColumn("dst_sum", F.coalesce(F.sum(F.col("src_end") - F.col("src_start")).over(w), F.lit(0)))


def cell_count(count: Sequence[int]) -> int:
    return math.prod(count)
