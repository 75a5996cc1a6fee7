"""Coalescing chunk reads into byte-range requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import share_package

#: Largest gap between chunks that one request reads over, and largest span of a request, in bytes.
# Fixed values.
MAX_GAP, MAX_SPAN = 32 * 1024, 8 * 1024 * 1024
#: Files are planned by ranges of this many bytes, in parallel; a request starts anew in each.
RANGE_BYTES = 1 << 30


def greedy_spans(chunks: Iterator[tuple[int, int]], max_gap: int = MAX_GAP, max_span: int = MAX_SPAN) -> Iterator[tuple[int, int, int]]:
    """(start, end, chunks) of requests for (addr, size) in order of address; equal addresses are one chunk."""
    start = end = last = None
    n = 0
    for addr, size in chunks:
        if addr == last:
            continue
        if start is not None and addr >= end and addr - end <= max_gap and addr + size - start <= max_span:
            end, n = addr + size, n + 1
        else:
            if start is not None:
                yield start, end, n
            start, end, n = addr, addr + size, 1
        last = addr
    if start is not None:
        yield start, end, n


def coalesce_requests(chunks: DataFrame, max_gap: int = MAX_GAP, max_span: int = MAX_SPAN) -> DataFrame:
    """Requests (file, start, end, chunks) for chunk rows (file, addr, size).

    Files are cut at fixed addresses, so one large file is planned by many tasks, and then into islands,
    between gaps that are too large, by a window; only the span limit, which depends on where a request
    began, is applied in sequence within each island. A chunk belongs to the range in which it begins.
    """
    share_package(chunks.sparkSession)
    w = Window.partitionBy("file", "range").orderBy("addr")
    ends = F.max(F.col("addr") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.select("file", "addr", "size").distinct().withColumn("range", F.floor(F.col("addr") / RANGE_BYTES))
    rows = rows.withColumn("gap", F.coalesce((F.col("addr") - ends > max_gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("gap").over(w))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("addr")
        found = greedy_spans(zip(pdf["addr"].tolist(), pdf["size"].tolist(), strict=True), max_gap, max_span)
        return pd.DataFrame([(pdf["file"].iloc[0], *r) for r in found], columns=["file", "start", "end", "chunks"])

    return rows.groupBy("file", "range", "island").applyInPandas(cut, "file string, start long, end long, chunks long")
