import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import grid
from tessera.plans.requests import coalesce_requests, greedy_spans
from tessera.plans.segments import segments, segments_of_cells, with_destinations

CASES = [
    ([0, 0], [1, 10], [(0, 0, 10)]),
    ([0, 0], [1, 20], [(0, 0, 10), (1, 0, 10)]),
    ([0, 5], [1, 15], [(0, 5, 10), (1, 0, 10)]),
    ([0, 0], [2, 10], [(0, 0, 20)]),
    ([0, 5], [2, 10], [(0, 5, 10), (1, 0, 5), (0, 15, 20), (1, 10, 15)]),
    ([0, 0], [2, 20], [(0, 0, 10), (1, 0, 10), (0, 10, 20), (1, 10, 20)]),
    ([2, 0], [1, 10], [(0, 20, 30)]),
    ([2, 5], [1, 10], [(0, 25, 30), (1, 20, 25)]),
    ([2, 5], [4, 1], [(0, 25, 26), (0, 35, 36), (0, 45, 46), (0, 55, 56)]),
    ([2, 15], [4, 1], [(1, 25, 26), (1, 35, 36), (1, 45, 46), (1, 55, 56)]),
    ([0, 0], [1, 0], []),
]


def planned(df):
    return [(r["chunk_id"], r["src_start"], r["src_end"]) for r in df.orderBy("dst_offset").collect()]


@pytest.mark.parametrize(("start", "count", "expected"), CASES)
def test_segments_of_the_square_grid(spark, start, count, expected):
    assert planned(segments(spark, start, count, [20, 20], [10, 10])) == expected


def test_edge_chunks_do_not_merge_across_their_padding(spark):
    assert planned(segments(spark, [0, 10], [2, 5], [20, 15], [10, 10])) == [(1, 0, 5), (1, 10, 15)]


def test_scalar_has_one_segment(spark):
    assert planned(segments(spark, [], [], [], [])) == [(0, 0, 1)]


def test_closed_form_equals_the_definition(spark):
    rng = random.Random(3)
    for rank in (1, 2, 3, 3):
        shape = [rng.randint(1, 7) for _ in range(rank)]
        chunks = [rng.randint(1, 4) for _ in range(rank)]
        start = [rng.randrange(n) for n in shape]
        count = [rng.randint(1, n - s) for n, s in zip(shape, start, strict=True)]
        rows = list(itertools.product(*[range(s, s + c) for s, c in zip(start, count, strict=True)]))
        cells = spark.createDataFrame(rows, ", ".join(f"i{j} long" for j in range(rank)))
        want = segments_of_cells(cells, start, count, shape, chunks)
        got = with_destinations(segments(spark, start, count, shape, chunks))
        assert planned(got) == planned(want), (shape, chunks, start, count)
        assert got.filter("dst_offset <> dst_sum").count() == 0


def test_contains(spark):
    points = [([0, 0], -1), ([5, 0], -1), ([10, 0], -1), ([5, 10], -1), ([5, 25], -1), ([10, 10], 0), ([10, 15], 0), ([15, 15], 0), ([15, 10], 0)]
    points += [([20, 20], 1), ([25, 20], 1), ([25, 10], 1), ([10, 25], 1), ([25, 5], 1)]
    df = spark.createDataFrame([(*p, s) for p, s in points], "a long, b long, want int")
    got = df.withColumn("got", grid.contains([F.col("a"), F.col("b")], [F.lit(10), F.lit(10)], [10, 10]))
    assert got.filter("want <> got").count() == 0


def test_ordinals_and_places_follow_numpy(spark):
    shape, chunks = [5, 7, 4], [2, 3, 4]
    cells = spark.range(140).select(*grid.unravel("id", shape), "id")
    idx = [F.col(f"i{j}") for j in range(3)]
    rows = cells.select("id", grid.ravel(idx, shape).alias("flat"), grid.chunk_ordinal(idx, shape, chunks).alias("c"), grid.place_in_chunk(idx, chunks).alias("p"), *idx).collect()
    for r in rows:
        i = np.unravel_index(r["id"], shape)
        assert (r["i0"], r["i1"], r["i2"]) == tuple(i) and r["flat"] == r["id"]
        k = [a // c for a, c in zip(i, chunks, strict=True)]
        assert r["c"] == np.ravel_multi_index(k, grid.chunk_counts(shape, chunks))
        assert r["p"] == np.ravel_multi_index([a % c for a, c in zip(i, chunks, strict=True)], chunks)


def test_requests():
    gap, cap = 32 * 1024, 8 * 1024 * 1024
    assert list(greedy_spans([(1000, 500), (1500, 500), (2500, 500), (3000 + 2 * gap, 500)])) == [(1000, 3000, 3), (3000 + 2 * gap, 3500 + 2 * gap, 1)]
    assert list(greedy_spans([(1000, 500), (1000, 500)])) == [(1000, 1500, 1)]
    assert len(list(greedy_spans([(1000, cap - 500), (cap + 500, 1000)]))) == 2
    assert list(greedy_spans([])) == []


def test_requests_by_file_equal_the_greedy_rule(spark):
    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(300):
        size = rng.choice([100, 5000, 3_000_000])
        rows.append((rng.choice("ab"), at, size))
        at += size + rng.choice([0, 1000, 40_000])
    got = sorted(tuple(r) for r in coalesce_requests(spark.createDataFrame(rows, "file string, addr long, size long")).collect())
    want = sorted((f, *s) for f in "ab" for s in greedy_spans((a, n) for g, a, n in rows if g == f))
    assert got == want
