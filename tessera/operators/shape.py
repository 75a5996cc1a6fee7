"""Operators on the form of results: squeezing, row nesting, concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.extents import index_names


def squeeze(cells: DataFrame, count: Sequence[int]) -> DataFrame:
    """Cells without the index columns of dimensions selected at one index; one dimension stays at least."""
    single = [n for n, c in zip(index_names(len(count)), count, strict=True) if c == 1]
    return cells.drop(*(single if len(single) < len(count) else single[1:]))


def nest_rows(cells: DataFrame, rank: int) -> DataFrame:
    """One array per outer index, along the last dimension: (i0, ..., values)."""
    outer, last = index_names(rank)[:-1], f"i{rank - 1}"
    pairs = F.array_sort(F.collect_list(F.struct(F.col(last).alias("i"), F.col("value").alias("v"))))
    return cells.groupBy(*outer).agg(F.transform(pairs, lambda p: p["v"]).alias("values"))


def row_major(cells: DataFrame, rank: int) -> DataFrame:
    """Cells in row-major order: the order of flat results."""
    return cells.orderBy(*index_names(rank)) if rank else cells


def concat(parts: Sequence[tuple[DataFrame, int]], dim: int = 0) -> DataFrame:
    """Arrays end to end along ``dim``, given with their sizes in it."""
    out, at = None, 0
    for cells, size in parts:
        moved = cells.withColumn(f"i{dim}", F.col(f"i{dim}") + F.lit(at).cast("long"))
        out = moved if out is None else out.unionByName(moved)
        at += size
    if out is None:
        raise ValueError("nothing to concatenate")
    return out
