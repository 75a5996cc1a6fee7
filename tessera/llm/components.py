"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, materialize, release


def forest(left: list[int], right: list[int]) -> tuple[list[int], list[int]]:
    """A spanning forest of the given links: each node but the smallest of its tree, with that smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left, right, strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in list(parent)]
    pairs = [(x, r) for x, r in pairs if x != r]
    return [x for x, _ in pairs], [r for _, r in pairs]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a batch to its spanning forest: shrinks dense groups before they are shuffled."""
    for batch in batches:
        u, v = forest(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Smallest node reachable from each node of ``edges``.

    Returns (node long, component long), one row for each node that has a link to another node; a
    node without links is its own component and is left to the caller. Self-links and repeated links
    are allowed, rows with a null end are ignored. Every round writes its (never growing) edge table
    to the scratch folder and deletes the one before; the number of rounds grows with the logarithm of the
    longest chain.
    """
    cols = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    cols = cols.filter(F.col("u") != F.col("v"))
    current = materialize(map_batches(cols, _contract, "u long, v long").distinct(), "cc")
    while True:
        # Large star: every larger neighbour is linked to the smallest node seen from u.
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "cc-large")
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = materialize(small.filter("u <> v").distinct(), "cc-small")
        # A fixed point is a set of stars: no node is both a centre and a leaf, no leaf has two centres.
        leaves = after.groupBy("u").agg(F.count("*").alias("n"))
        twice = leaves.filter("n > 1").limit(1)
        chained = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        release(current, large)
        if not twice.select("u").union(chained.select("u")).take(1):
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        current = after
