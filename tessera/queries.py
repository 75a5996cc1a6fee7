"""Registered queries over arrays, each with the same query in DuckDB SQL.

Arrays are taken from tables with dense keys: A1 ``events.value`` [n]; A2 ``embeddings`` [n, 64]; A3
``orders.o_totalprice`` [n / 500, 20, 25]; A4 ``part.p_size`` [n]. Selections are fixed by the query.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.api import Index, open_mfdataset
from tessera.functions import codec, conventions
from tessera.functions.dtypes import ElementType
from tessera.operators import extents as X
from tessera.operators import grid, shape
from tessera.plans import requests
from tessera.plans import segments as plan
from tessera.scratch import scratch_path
from tessera.sources.catalog import CHUNKS, ArraySpec, Catalog, chunks_as_numbers, numbers_as_chunks
from tessera.sources.chunk_files import read_array, read_segments, write_array
from tessera.sources.data_source import register
from tessera.streaming.segments import xdr_segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CHUNK2, CHUNK3 = [50, 24], [1, 8, 10]


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_of(df: DataFrame, key: str) -> int:
    """Length of a dense-key axis, from a scan of the key column; 0 for an empty table."""
    most = df.agg(F.max(key)).first()[0]
    return 0 if most is None else most + 1


def a1(spark, sf_dir) -> tuple[DataFrame, list[int]]:
    df = table(spark, sf_dir, "events")
    return df.select(F.col("event_id").alias("i0"), "value"), [size_of(df, "event_id")]


def a2(spark, sf_dir) -> tuple[DataFrame, list[int]]:
    df = table(spark, sf_dir, "embeddings")
    return grid.cells_from_arrays(df, "vec_id", "embedding"), [size_of(df, "vec_id"), 64]


def a3(spark, sf_dir) -> tuple[DataFrame, list[int]]:
    df = table(spark, sf_dir, "orders")
    dims = [math.ceil(size_of(df, "o_orderkey") / 500), 20, 25]
    return grid.cells_from_table(df, "o_orderkey", "o_totalprice", dims), dims


def a4(spark, sf_dir) -> tuple[DataFrame, list[int]]:
    df = table(spark, sf_dir, "part")
    return df.select(F.col("p_partkey").alias("i0"), F.col("p_size").alias("value")), [size_of(df, "p_partkey")]


A1 = "SELECT event_id AS i0, value FROM events"
A2 = "SELECT vec_id AS i0, unnest(range(len(embedding))) AS i1, unnest(embedding) AS value FROM embeddings"
A3 = "SELECT o_orderkey // 500 AS i0, (o_orderkey // 25) % 20 AS i1, o_orderkey % 25 AS i2, o_totalprice AS value FROM orders"
A4 = "SELECT p_partkey AS i0, p_size AS value FROM part"


# Scans and selections.


@query(A1)
def full_scan_1d(spark, sf_dir):
    cells, dims = a1(spark, sf_dir)
    return X.select(cells, X.ALL, dims)


@query(f"SELECT * FROM ({A2}) WHERE i0 >= 100 AND i0 < 300 AND i1 >= 10 AND i1 < 42")
def hyperslab_2d(spark, sf_dir):
    cells, dims = a2(spark, sf_dir)
    return X.select(cells, X.from_vectors([100, 10], [min(200, dims[0] - 100), 32]), dims)


@query(f"SELECT * FROM ({A3}) WHERE i0 >= 1 AND i0 < 3 AND i1 BETWEEN 5 AND 12 AND i2 < 20")
def hyperslab_3d(spark, sf_dir):
    cells, dims = a3(spark, sf_dir)
    return X.select(cells, [X.between(1, 3), X.through(5, 12), X.until(20)], dims)


SELECTIONS = {
    "ext_index": (X.at(7), "i0 = 7"),
    "ext_from": (X.since(900), "i0 >= 900"),
    "ext_range": (X.between(10, 20), "i0 >= 10 AND i0 < 20"),
    "ext_to": (X.until(25), "i0 < 25"),
    "ext_to_incl": (X.until_inclusive(25), "i0 <= 25"),
    "ext_range_incl": (X.through(10, 20), "i0 BETWEEN 10 AND 20"),
    "ext_full": (X.FULL, "true"),
    "ext_start_count": (X.run(30, 12), "i0 >= 30 AND i0 < 42"),
    "ext_empty": (X.between(20, 10), "false"),
    "ext_zero_count": (X.run(5, 0), "false"),
    "ext_python_range": (range(3, 9), "i0 >= 3 AND i0 < 9"),
}
for _name, (_extent, _where) in SELECTIONS.items():
    query(f"SELECT * FROM ({A1}) WHERE {_where}", _name)(
        lambda spark, sf_dir, e=_extent: (lambda found: X.select(found[0], [e], found[1]))(a1(spark, sf_dir))
    )


@query(f"SELECT * FROM ({A3}) WHERE i0 = 2 AND i1 >= 4 AND i1 < 9 AND i2 >= 20")
def ext_tuple_mixed(spark, sf_dir):
    cells, dims = a3(spark, sf_dir)
    return X.select(cells, (2, X.run(4, 5), X.since(20)), dims)


def subscript(cells: DataFrame, key: object, dims: list[int]) -> DataFrame:
    start, count, _ = X.normalize_key(key, dims)
    return X.select(cells, X.from_vectors(start, count), dims)


@query(f"SELECT * FROM ({A1}) WHERE i0 >= 950 AND i0 < 1000000")
def py_slice_clamped(spark, sf_dir):
    cells, dims = a1(spark, sf_dir)
    return subscript(cells, slice(950, 1_000_000), dims)


@query(f"SELECT * FROM ({A3}) WHERE i0 = 1")
def py_partial_key(spark, sf_dir):
    cells, dims = a3(spark, sf_dir)
    return subscript(cells, 1, dims)


@query(f"SELECT * FROM ({A1}) WHERE i0 = (SELECT max(event_id) FROM events)")
def py_negative_index(spark, sf_dir):
    cells, dims = a1(spark, sf_dir)
    return subscript(cells, -1, dims)


@query(f"SELECT * FROM ({A3}) WHERE i1 IN (0, 7, 19)")
def outer_index_take(spark, sf_dir):
    cells, _ = a3(spark, sf_dir)
    return shape_take(cells, spark.createDataFrame([(0,), (7,), (19,), (7,)], "k long"))


def shape_take(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    return X.take(cells, 1, wanted, "k")


# Index arithmetic and form.


@query(f"SELECT i0 * 500 + i1 * 25 + i2 AS flat, value FROM ({A3})")
def flat_ravel(spark, sf_dir):
    cells, dims = a3(spark, sf_dir)
    return cells.select(grid.ravel([F.col(n) for n in X.index_names(3)], dims).alias("flat"), "value")


@query("SELECT o_orderkey, o_orderkey // 500 AS i0, (o_orderkey // 25) % 20 AS i1, o_orderkey % 25 AS i2 FROM orders")
def unravel(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", *grid.unravel("o_orderkey", [math.ceil(size_of(df, "o_orderkey") / 500), 20, 25]))


@query(f"SELECT i1, value FROM ({A3}) WHERE i0 = 1 AND i2 = 3")
def squeeze(spark, sf_dir):
    cells, dims = a3(spark, sf_dir)
    start, count, _ = X.normalize_key((1, slice(None), 3), dims)
    return shape.squeeze(X.select(cells, X.from_vectors(start, count), dims), count)


@query(f"SELECT i0, i1, count(*) AS n, max(value) FILTER (i2 = 0) AS first, max(value) FILTER (i2 = 24) AS last FROM ({A3}) GROUP BY i0, i1")
def reshape_rows(spark, sf_dir):
    cells, _ = a3(spark, sf_dir)
    rows = shape.nest_rows(cells, 3)
    return rows.select("i0", "i1", F.size("values").cast("long").alias("n"), F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"))


@query(f"SELECT * FROM ({A4}) UNION ALL SELECT i0 + (SELECT count(*) FROM part), value FROM ({A4})")
def open_mfdataset_concat(spark, sf_dir):
    cells, dims = a4(spark, sf_dir)
    return shape.concat([(cells, dims[0]), (cells, dims[0])])


@query(f"SELECT * FROM ({A2}) UNION ALL SELECT i0 + (SELECT max(vec_id) + 1 FROM embeddings), i1, value FROM ({A2})")
def open_mfdataset_concat_whole(spark, sf_dir):
    cells, dims = a2(spark, sf_dir)
    return shape.concat([(cells, dims[0]), (cells, dims[0])])


@query(A3.replace("o_orderkey % 25 AS i2", "(o_orderkey % 25)::INT AS i2"))
def reshape_rows_values(spark, sf_dir):
    """Every nested value with its place in its row."""
    cells, _ = a3(spark, sf_dir)
    return shape.nest_rows(cells, 3).select("i0", "i1", F.posexplode("values").alias("i2", "value"))


# Chunks.


@query(f"SELECT i0, i1, i2, i0 * 9 + (i1 // 8) * 3 + i2 // 10 AS chunk_id, (i1 % 8) * 10 + i2 % 10 AS place FROM ({A3})")
def chunk_at_coord(spark, sf_dir):
    cells, dims = a3(spark, sf_dir)
    idx = [F.col(n) for n in X.index_names(3)]
    return cells.select(*idx, grid.chunk_ordinal(idx, dims, CHUNK3).alias("chunk_id"), grid.place_in_chunk(idx, CHUNK3).alias("place"))


@query(f"SELECT i0, i1, CASE WHEN i0 < 50 THEN -1 WHEN i0 >= 100 THEN 1 WHEN i1 < 24 THEN -1 WHEN i1 >= 48 THEN 1 ELSE 0 END AS side FROM ({A2})")
def chunk_contains(spark, sf_dir):
    cells, _ = a2(spark, sf_dir)
    side = grid.contains([F.col("i0"), F.col("i1")], [F.lit(50), F.lit(24)], CHUNK2)
    return cells.select("i0", "i1", side.alias("side"))


GRID2 = """SELECT k0 * 3 + k1 AS chunk_id, k0 * 50 AS o0, k1 * 24 AS o1, least(50, n - k0 * 50) AS l0, least(24, 64 - k1 * 24) AS l1
FROM (SELECT max(vec_id) + 1 AS n FROM embeddings), (SELECT unnest(range(3)) AS k1),
    (SELECT unnest(range((SELECT (max(vec_id) + 50) // 50 FROM embeddings))) AS k0)"""


@query(GRID2)
def chunk_grid(spark, sf_dir):
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    return grid.chunk_grid(spark, dims, CHUNK2).select("chunk_id", "o0", "o1", "l0", "l1")


@query(f"SELECT chunk_id FROM ({GRID2}) WHERE l1 < 24")
def chunk_grid_clipped(spark, sf_dir):
    return chunk_grid(spark, sf_dir).filter("l1 < 24").select("chunk_id")


@query(f"SELECT DISTINCT (i0 // 50) * 3 + i1 // 24 AS chunk_id FROM ({A2}) WHERE i0 >= 120 AND i0 < 260 AND i1 >= 30 AND i1 < 50")
def chunk_pruning(spark, sf_dir):
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    return grid.chunk_grid(spark, dims, CHUNK2, [120, 30], [140, 20]).select("chunk_id")


@query("SELECT true AS aligned, true AS complete, true AS valid")
def chunk_validity(spark, sf_dir):
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    return grid.validity(grid.chunk_grid(spark, dims, CHUNK2), dims, CHUNK2)


@query("SELECT * FROM (VALUES ('double', true, false, false), ('missing', true, false, false), ('shifted', false, true, false), ('whole', true, true, true)) AS t(kind, aligned, complete, valid)")
def chunk_validity_of_broken_grids(spark, sf_dir):
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    whole = grid.chunk_grid(spark, dims, CHUNK2).select("chunk_id", "offset")
    shifted = F.when(F.col("chunk_id") == 1, F.transform("offset", lambda o: o + 1)).otherwise(F.col("offset"))
    kinds = {"whole": whole, "missing": whole.filter("chunk_id <> 2"), "double": whole.union(whole.filter("chunk_id = 0")), "shifted": whole.withColumn("offset", shifted)}
    return functools.reduce(DataFrame.union, [grid.validity(g, dims, CHUNK2).select(F.lit(k).alias("kind"), "aligned", "complete", "valid") for k, g in kinds.items()])


def segment_sql(cells: str, dst: str, chunk: str, src: str) -> str:
    return f"""WITH c AS (SELECT {dst} AS dst, {chunk} AS chunk_id, {src} AS src FROM ({cells})),
m AS (SELECT *, CASE WHEN lag(chunk_id) OVER w IS DISTINCT FROM chunk_id OR lag(src) OVER w + 1 IS DISTINCT FROM src THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (ORDER BY dst)),
r AS (SELECT *, sum(new) OVER (ORDER BY dst) AS run FROM m)
SELECT min(chunk_id) AS chunk_id, min(dst) AS dst_offset, min(src) AS src_start, max(src) + 1 AS src_end FROM r GROUP BY run"""


SEG2 = segment_sql(
    f"SELECT * FROM ({A2}) WHERE i0 >= 30 AND i0 < 270 AND i1 >= 24 AND i1 < 64", "(i0 - 30) * 40 + i1 - 24", "(i0 // 50) * 3 + i1 // 24", "(i0 % 50) * 24 + i1 % 24"
)
SEG3 = segment_sql(
    f"SELECT * FROM ({A3}) WHERE i0 < 3 AND i1 >= 4 AND i2 >= 5", "i0 * 320 + (i1 - 4) * 20 + i2 - 5", "i0 * 9 + (i1 // 8) * 3 + i2 // 10", "(i1 % 8) * 10 + i2 % 10"
)


@query(SEG2)
def chunk_slices_2d(spark, sf_dir):
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    return plan.segments(spark, [30, 24], [240, 40], dims, CHUNK2)


@query(SEG3)
def chunk_slices_3d(spark, sf_dir):
    dims = [math.ceil(size_of(table(spark, sf_dir, "orders"), "o_orderkey") / 500), 20, 25]
    return plan.segments(spark, [0, 4, 5], [3, 16, 20], dims, CHUNK3)


@query(SEG3, "chunk_slices_by_definition")
def chunk_slices_by_definition(spark, sf_dir):
    cells, dims = a3(spark, sf_dir)
    picked = X.select(cells, X.from_vectors([0, 4, 5], [3, 16, 20]), dims)
    return plan.segments_of_cells(picked, [0, 4, 5], [3, 16, 20], dims, CHUNK3)


@query(segment_sql(A2, "i0 * 64 + i1", "(i0 // 50) * 3 + i1 // 24", "(i0 % 50) * 24 + i1 % 24"))
def chunk_slices_whole(spark, sf_dir):
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    return plan.segments(spark, [0, 0], dims, dims, CHUNK2)


def chunk_table(spark: SparkSession, dims: list[int]) -> DataFrame:
    """Chunks of A2 as one file would hold them, each followed by a gap of 100 bytes for every tenth one."""
    found = grid.chunk_grid(spark, dims, CHUNK2)
    addr = F.col("chunk_id") * 4800 + F.floor(F.col("chunk_id") / 10) * 40000
    return found.select(
        F.lit("a2").alias("file"), F.lit(None).cast("string").alias("part"), F.lit("").alias("group_path"), F.lit("embedding").alias("name"), "chunk_id", addr.cast("long").alias("addr"), F.lit(4800).cast("long").alias("size"), "offset"
    )


@query(f"SELECT chunk_id * 4800 + (chunk_id // 10) * 40000 AS addr, count(*) AS runs, min(dst_offset) AS first_dst, sum(src_end - src_start)::BIGINT AS elements FROM ({SEG2}) GROUP BY chunk_id")
def group_chunk_slices(spark, sf_dir):
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    grouped = plan.by_chunk(plan.segments(spark, [30, 24], [240, 40], dims, CHUNK2), chunk_table(spark, dims))
    lengths = F.transform("segments", lambda s: s["src_end"] - s["src_start"])
    return grouped.select(
        "addr", F.size("segments").cast("long").alias("runs"), F.col("segments")[0]["dst_offset"].alias("first_dst"), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n).alias("elements")
    )


@query(f"""WITH c AS (SELECT chunk_id * 4800 + (chunk_id // 10) * 40000 AS addr FROM ({GRID2})),
g AS (SELECT addr, CASE WHEN addr - lag(addr + 4800) OVER (ORDER BY addr) <= 32768 THEN 0 ELSE 1 END AS new FROM c),
r AS (SELECT addr, sum(new) OVER (ORDER BY addr) AS run FROM g)
SELECT 'a2' AS file, min(addr) AS start, max(addr) + 4800 AS end, count(*) AS chunks FROM r GROUP BY run""")
def coalesce_requests(spark, sf_dir):
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    return requests.coalesce_requests(chunk_table(spark, dims))


@query(f"""WITH c AS (SELECT chunk_id, chunk_id * 1000000 AS addr, chunk_id * 1000000 // {requests.RANGE_BYTES} AS r FROM ({GRID2})),
g AS (SELECT addr, r, (chunk_id - min(chunk_id) OVER (PARTITION BY r)) // 8 AS k FROM c)
SELECT 'a2' AS file, min(addr) AS start, max(addr) + 1000000 AS end, count(*) AS chunks FROM g GROUP BY r, k""")
def coalesce_requests_spans(spark, sf_dir):
    """Chunks of 1 MB end to end, so that requests end at the largest span."""
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    addr, size = F.col("chunk_id") * 1_000_000, F.lit(1_000_000).cast("long")
    return requests.coalesce_requests(chunk_table(spark, dims).withColumn("addr", addr).withColumn("size", size))


@query(f"SELECT chunk_id * 4 + p AS place, [chunk_id * 4800 + (chunk_id // 10) * 40000, 4800, o0, o1][p + 1] AS number FROM ({GRID2}), (SELECT unnest(range(4)) AS p)")
def reinterpret_u64s(spark, sf_dir):
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    flat = chunks_as_numbers(chunk_table(spark, dims))
    return flat.select(F.posexplode("numbers").alias("place", "number")).select(F.col("place").cast("long").alias("place"), "number")


@query(f"SELECT chunk_id * 4800 + (chunk_id // 10) * 40000 AS addr, 4800::BIGINT AS size, o0, o1 FROM ({GRID2})")
def reinterpret_chunks(spark, sf_dir):
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    back = numbers_as_chunks(chunks_as_numbers(chunk_table(spark, dims)), 2)
    return back.select("addr", "size", F.col("offset")[0].alias("o0"), F.col("offset")[1].alias("o1"))


# Catalog.


def catalog_of(spark: SparkSession, sf_dir: str) -> Catalog:
    n2, n1 = size_of(table(spark, sf_dir, "embeddings"), "vec_id"), size_of(table(spark, sf_dir, "events"), "event_id")
    specs = [
        ArraySpec("embedding", ElementType("f", 4), [n2, 64], CHUNK2, gzip=4, group_path="a/b"),
        ArraySpec("value", ElementType("f", 8), [n1], [1000]),
        ArraySpec("answer", ElementType("i", 4), [], [], group_path="/a/"),
    ]
    return Catalog.build(spark, [(sf_dir and "file", s, [(0, s.chunk_bytes, [0] * len(s.shape))]) for s in specs])


CATALOG = """SELECT '' AS group_path, 'value' AS name, (SELECT max(event_id) + 1 FROM events) AS elements, false AS scalar
UNION ALL SELECT 'a/b', 'embedding', (SELECT (max(vec_id) + 1) * 64 FROM embeddings), false UNION ALL SELECT 'a', 'answer', 1, true"""


@query(CATALOG)
def catalog_sizes(spark, sf_dir):
    df = catalog_of(spark, sf_dir).datasets
    return df.select("group_path", "name", grid.size_column(F.col("shape")).alias("elements"), grid.is_scalar(F.col("shape")).alias("scalar"))


@query("SELECT 'b' AS name, 'group' AS kind UNION ALL SELECT 'answer', 'dataset'")
def catalog_listing(spark, sf_dir):
    c = catalog_of(spark, sf_dir)
    groups = c.list_groups("/a/").select("name", F.lit("group").alias("kind"))
    return groups.unionByName(c.list_datasets("a").select("name", F.lit("dataset").alias("kind")))


@query("SELECT 64 AS s0, 1 AS s1, 24 AS c0, 1 AS c1, 3 AS g0, 1 AS g1")
def catalog_lookup(spark, sf_dir):
    d = catalog_of(spark, sf_dir).dataset("/a/b/embedding")
    named = {"s": "dim_sz", "c": "chunk_dim_sz", "g": "scaled_dim_sz"}
    return d.select(*[F.col(c)[j].alias(f"{k}{j}") for k, c in named.items() for j in range(2)])


@query(GRID2.replace("AS o0", "AS offset0").replace("AS o1", "AS offset1").replace("AS l0", "AS _l0").replace("AS l1", "AS _l1").join(["SELECT chunk_id, offset0, offset1 FROM (", ")"]))
def index_roundtrip(spark, sf_dir):
    dims = [size_of(table(spark, sf_dir, "embeddings"), "vec_id"), 64]
    spec = ArraySpec("embedding", ElementType("f", 4), dims, CHUNK2)
    path = scratch_path(spark, "index")
    Catalog(catalog_of(spark, sf_dir).datasets, spark.createDataFrame([], CHUNKS).unionByName(chunk_table(spark, dims))).write(path)
    back = Catalog.read(spark, path).chunks.filter(F.col("name") == spec.name)
    return back.select("chunk_id", F.col("offset")[0].alias("offset0"), F.col("offset")[1].alias("offset1"))


# Codecs.


@query("SELECT p_partkey, p_size, CASE WHEN s >= 2147483648 THEN s - 4294967296 ELSE s END::INT AS swapped FROM (SELECT *, ((p_size::BIGINT & 255) << 24) | (((p_size::BIGINT >> 8) & 255) << 16) | (((p_size::BIGINT >> 16) & 255) << 8) | ((p_size::BIGINT >> 24) & 255) AS s FROM part)")
def byteswap_i32(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", codec.byte_swap32(F.col("p_size")).alias("swapped"))


@query("""SELECT p_partkey, CASE WHEN a >= 32768 THEN a - 65536 ELSE a END::SMALLINT AS s16,
    CASE WHEN b >= 9223372036854775808 THEN b::HUGEINT - 18446744073709551616 ELSE b::HUGEINT END::BIGINT AS s64
FROM (SELECT p_partkey, ((p_size & 255) << 8) | ((p_size >> 8) & 255) AS a,
    ('0x' || list_aggregate(list_reverse(list_transform(range(8), lambda k: substr(h, (2 * k + 1)::INT, 2))), 'string_agg', ''))::UBIGINT AS b
    FROM (SELECT p_partkey, p_size, printf('%016x', p_partkey::BIGINT * 1000003) AS h FROM part))""")
def byteswap_i16_i64(spark, sf_dir):
    wide = F.col("p_partkey").cast("long") * 1000003
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", codec.byte_swap(F.col("p_size").cast("short"), 2).alias("s16"), codec.byte_swap(wide, 8).alias("s64"))


@query("SELECT p_partkey, upper(printf('%08x', (p_size - 25) & 4294967295)) AS xdr FROM (SELECT p_partkey, p_size::BIGINT AS p_size FROM part)")
def xdr_upcast_i16(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", codec.xdr_hex((F.col("p_size") - 25).cast("short")).alias("xdr"))


@query("SELECT * FROM (VALUES ('i', 1, 4), ('i', 2, 2), ('i', 4, 1), ('i', 8, 1), ('u', 1, 4), ('u', 2, 2), ('u', 4, 1), ('f', 4, 1), ('f', 8, 1), ('c', 1, 1), ('c', 2, 1)) AS t(kind, size, factor)")
def xdr_factor(spark, sf_dir):
    rows = [(k, s) for k, sizes in (("i", (1, 2, 4, 8)), ("u", (1, 2, 4)), ("f", (4, 8)), ("c", (1, 2))) for s in sizes]
    df = spark.createDataFrame(rows, "kind string, size int")
    return df.withColumn("factor", codec.xdr_factor_column(F.col("kind"), F.col("size")))


def payload_roundtrip(spark, sf_dir, encode, decode) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("raw"))
    return codec.map_payload(codec.map_payload(df, "raw", encode), "raw", decode).select("p_partkey", F.decode("raw", "UTF-8").alias("p_name"))


@query("SELECT p_partkey, p_name FROM part")
def gzip_roundtrip(spark, sf_dir):
    return payload_roundtrip(spark, sf_dir, lambda b: len(b).to_bytes(4, "big") + codec.deflate(b), lambda b: codec.inflate(b[4:], int.from_bytes(b[:4], "big")))


@query("SELECT p_partkey, p_name FROM part")
def unshuffle_roundtrip(spark, sf_dir):
    pad = lambda b: b + b" " * (-len(b) % 4)
    return payload_roundtrip(spark, sf_dir, lambda b: codec.shuffle(pad(b), 4), lambda b: codec.unshuffle(b, 4).rstrip(b" "))


# Stored arrays.


def stored(spark: SparkSession, cells: DataFrame, spec: ArraySpec) -> Catalog:
    return write_array(cells, spec, scratch_path(spark, spec.name))


@query(A3)
def decode_chunk_scan(spark, sf_dir):
    cells, dims = a3(spark, sf_dir)
    catalog = stored(spark, cells, ArraySpec("price", ElementType("f", 8, "BE"), dims, CHUNK3, shuffle=True, gzip=4))
    return read_array(catalog, "price")


@query(f"SELECT * FROM ({A2}) WHERE i0 >= 120 AND i0 < 260 AND i1 >= 30 AND i1 < 50")
def parallel_hyperslab(spark, sf_dir):
    cells, dims = a2(spark, sf_dir)
    catalog = stored(spark, cells, ArraySpec("embedding", ElementType("f", 4), dims, CHUNK2, shuffle=True, gzip=1, group_path="a/b"))
    return read_array(catalog, "a/b/embedding", X.from_vectors([120, 30], [140, 20]))


@query(f"SELECT * FROM ({A4}) WHERE i0 >= 60 AND i0 < 130")
def datasource_hyperslab(spark, sf_dir):
    cells, dims = a4(spark, sf_dir)
    folder = scratch_path(spark, "store")
    write_array(cells, ArraySpec("size", ElementType("i", 4, "BE"), dims, [50], gzip=4), f"{folder}/data").write(folder)
    register(spark)
    df = spark.read.format("chunked_array").option("catalog", folder).option("dataset", "size").load()
    return df.filter("i0 >= 60 AND i0 < 130")


@query(A2)
def datasource_parallel(spark, sf_dir):
    cells, dims = a2(spark, sf_dir)
    folder = scratch_path(spark, "store")
    write_array(cells, ArraySpec("embedding", ElementType("f", 4), dims, CHUNK2, shuffle=True, gzip=1), f"{folder}/data").write(folder)
    register(spark)
    return spark.read.format("chunked_array").option("catalog", folder).option("dataset", "embedding").load()


@query(f"""SELECT min(i0) - 10 AS dst_offset,
    string_agg(substr(h, 3, 2) || substr(h, 1, 2), '' ORDER BY i0) AS native, string_agg(w, '' ORDER BY i0) AS xdr
FROM (SELECT i0, upper(printf('%04x', (value - 25) & 65535)) AS h, upper(printf('%08x', (value::BIGINT - 25) & 4294967295)) AS w FROM ({A4}) WHERE i0 >= 10 AND i0 < 130)
GROUP BY i0 // 50""")
def stream_payloads(spark, sf_dir):
    """Bytes of the segments, as stored and in XDR."""
    cells, dims = a4(spark, sf_dir)
    shifted = cells.select("i0", (F.col("value") - 25).cast("short").alias("value"))
    catalog = stored(spark, shifted, ArraySpec("size", ElementType("i", 2), dims, [50], shuffle=True, gzip=2))
    picked = X.from_vectors([10], [min(120, dims[0] - 10)])
    native = read_segments(catalog, "size", picked).select("dst_offset", F.hex("payload").alias("native"))
    return native.join(xdr_segments(catalog, "size", picked).select("dst_offset", F.hex("payload").alias("xdr")), "dst_offset")


@query(f"SELECT dst_offset, src_end - src_start AS elements FROM ({SEG2})")
def stream_segments(spark, sf_dir):
    cells, dims = a2(spark, sf_dir)
    catalog = stored(spark, cells, ArraySpec("embedding", ElementType("f", 4), dims, CHUNK2, gzip=1))
    found = read_segments(catalog, "embedding", X.from_vectors([30, 24], [240, 40]))
    return found.select("dst_offset", (F.octet_length("payload") / 4).cast("long").alias("elements"))


# Conventions.


@query(f"SELECT i0, CASE WHEN value = 7 THEN 'NaN'::DOUBLE ELSE value END AS value FROM (SELECT i0, value::DOUBLE AS value FROM ({A4}))")
def fill_value_nan(spark, sf_dir):
    cells, _ = a4(spark, sf_dir)
    return cells.select("i0", conventions.apply_fill_value(F.col("value").cast("double"), 7.0, float("nan")).alias("value"))


@query(f"SELECT i0, nullif(value, 7) AS value FROM ({A4})")
def fill_value_null(spark, sf_dir):
    cells, _ = a4(spark, sf_dir)
    marker, _ = conventions.resolve_fill_value({"_FillValue": 7, "missing_value": 7, "units": "cm"})
    return cells.select("i0", conventions.apply_fill_value(F.col("value"), marker).alias("value"))


@query(f"SELECT i0, nullif(value, 7)::DOUBLE * 0.5 + 10 AS value FROM ({A4})")
def mask_and_scale(spark, sf_dir):
    cells, _ = a4(spark, sf_dir)
    return cells.select("i0", conventions.mask_and_scale(F.col("value"), 0.5, 10, 7).alias("value"))


@query(f"SELECT i0, TIMESTAMP '1970-01-01 12:00:00' + to_hours(i0 * 3) AS time FROM ({A4})")
def decode_times(spark, sf_dir):
    cells, _ = a4(spark, sf_dir)
    return cells.select("i0", conventions.decode_times(F.col("i0") * 3, "hours since 1970-01-01 12:00:00").alias("time"))


@query(f"SELECT i0, i0 * 5400 AS seconds FROM ({A4})")
def decode_timedelta(spark, sf_dir):
    cells, _ = a4(spark, sf_dir)
    span = conventions.decode_timedelta(F.col("i0") * 1.5, "hours")
    seconds = (F.lit("1970-01-01").cast("timestamp_ntz") + span).cast("timestamp").cast("long")
    return cells.select("i0", seconds.alias("seconds"))


def calendar_sql(days: str, month: str, day: str) -> str:
    return f"SELECT i0, 2000 + i0 // {days} AS year, {month} AS month, {day} AS day, 6 AS hour FROM (SELECT *, i0 % {days} AS d FROM ({A4}))"


@query(calendar_sql("360", "d // 30 + 1", "d % 30 + 1"))
def decode_times_360_day(spark, sf_dir):
    cells, _ = a4(spark, sf_dir)
    return calendar_fields(cells, "360_day")


NOLEAP = "[0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]"


@query(calendar_sql("365", f"len(list_filter({NOLEAP}, lambda x: x <= d))", f"d - list_max(list_filter({NOLEAP}, lambda x: x <= d)) + 1"))
def decode_times_noleap(spark, sf_dir):
    cells, _ = a4(spark, sf_dir)
    return calendar_fields(cells, "noleap")


def calendar_fields(cells: DataFrame, calendar: str) -> DataFrame:
    at = conventions.decode_calendar_times(F.col("i0"), "days since 2000-01-01 06:00", calendar)
    return cells.select("i0", *[at[n].cast("long" if n != "hour" else "int").alias(n) for n in ("year", "month", "day", "hour")])


# Opening a dataset, by flag.


def opened(spark: SparkSession, sf_dir: str) -> Index:
    """A group with a packed variable ``size`` on ``time``, its time coordinate, a lead time and nation names as characters."""
    cells, dims = a4(spark, sf_dir)
    n = table(spark, sf_dir, "nation")
    names = n.select(F.col("n_nationkey").alias("i0"), F.posexplode(F.split(F.rpad("n_name", 20, "\0"), "")).alias("i1", "c"))
    names = names.select("i0", F.col("i1").cast("long").alias("i1"), F.encode("c", "UTF-8").alias("value"))
    hours = cells.select("i0", (F.col("i0") * 3).cast("int").alias("value"))
    parts = [
        (cells, ArraySpec("size", ElementType("i", 4), dims, [500], gzip=1, dims=["time"], group_path="g", attrs={"scale_factor": "0.5", "add_offset": "10", "_FillValue": "7"})),
        (hours, ArraySpec("time", ElementType("i", 4), dims, [500], dims=["time"], group_path="g", attrs={"units": "hours since 1970-01-01 12:00:00"})),
        (hours, ArraySpec("lead", ElementType("i", 4), dims, [500], dims=["time"], group_path="g", attrs={"units": "hours"})),
        (names, ArraySpec("name", ElementType("c", 1, "NA"), [size_of(n, "n_nationkey"), 20], [25, 20], dims=["nation", "length"], group_path="g")),
    ]
    catalogs = [stored(spark, c, s) for c, s in parts]
    return Index(functools.reduce(Catalog.union, catalogs))


@query(f"SELECT i0, nullif(value, 7)::DOUBLE * 0.5 + 10 AS value FROM ({A4})")
def open_dataset_mask_and_scale(spark, sf_dir):
    return opened(spark, sf_dir).open_dataset(group="g", decode_coords=False)["size"]


@query(A4)
def open_dataset_raw(spark, sf_dir):
    return opened(spark, sf_dir).open_dataset(group="g", mask_and_scale=False, decode_coords=False, drop_variables=["lead"])["size"]


@query(f"SELECT i0, TIMESTAMP '1970-01-01 12:00:00' + to_hours(i0 * 3) AS value FROM ({A4})")
def open_dataset_decode_times(spark, sf_dir):
    return opened(spark, sf_dir).open_dataset(group="g", decode_coords=False)["time"]


@query(f"SELECT i0, (i0 * 3)::INT AS value FROM ({A4})")
def open_dataset_times_off(spark, sf_dir):
    return opened(spark, sf_dir).open_dataset(group="g", decode_times=False, decode_coords=False)["time"]


@query(f"SELECT i0, i0 * 10800 AS seconds FROM ({A4})")
def open_dataset_decode_timedelta(spark, sf_dir):
    spans = opened(spark, sf_dir).open_dataset(group="g", decode_timedelta=True, decode_coords=False)["lead"]
    return spans.select("i0", (F.lit("1970-01-01").cast("timestamp_ntz") + F.col("value")).cast("timestamp").cast("long").alias("seconds"))


@query("SELECT n_nationkey AS i0, n_name AS value FROM nation")
def open_dataset_concat_characters(spark, sf_dir):
    return opened(spark, sf_dir).open_dataset(group="g")["name"]


@query(f"SELECT i0, nullif(value, 7)::DOUBLE * 0.5 + 10 AS value, TIMESTAMP '1970-01-01 12:00:00' + to_hours(i0 * 3) AS time FROM ({A4})")
def open_dataset_decode_coords(spark, sf_dir):
    return opened(spark, sf_dir).open_dataset(group="g")["size"]


@query(f"SELECT i0, year(t)::INT AS year, month(t)::INT AS month, day(t)::INT AS day, hour(t)::INT AS hour FROM (SELECT i0, TIMESTAMP '1970-01-01 12:00:00' + to_hours(i0 * 3) AS t FROM ({A4}))")
def open_dataset_use_cftime(spark, sf_dir):
    found = opened(spark, sf_dir).open_dataset(group="g", use_cftime=True, decode_coords=False)["time"]
    return found.select("i0", *[F.col("value")[n].alias(n) for n in ("year", "month", "day", "hour")])


@query(f"SELECT i0, nullif(value, 7)::DOUBLE * 0.5 + 10 AS value FROM (SELECT * FROM ({A4}) UNION ALL SELECT i0 + (SELECT count(*) FROM part), value FROM ({A4}))")
def open_mfdataset_by_dimension(spark, sf_dir):
    index = opened(spark, sf_dir)
    return open_mfdataset([index, index], "time", by="time", group="g")["size"]


@query("SELECT n_nationkey, n_name FROM nation")
def concat_characters(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.split(F.rpad("n_name", 20, "\0"), "")).alias("p", "c"))
    return conventions.concat_characters(df, ["n_nationkey"], "p", "c", "n_name")


@query("SELECT n_nationkey, n_name FROM nation")
def fixed_string_trim(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return df.select("n_nationkey", conventions.fixed_string(F.encode(F.rpad("n_name", 20, "\0"), "UTF-8")).alias("n_name"))


@query(f"SELECT a.i0, i1, i2, a.value, n_name FROM ({A3}) a JOIN nation ON a.i1 = n_nationkey")
def decode_coords_join(spark, sf_dir):
    cells, _ = a3(spark, sf_dir)
    return conventions.decode_coords(cells, table(spark, sf_dir, "nation"), {"i1": "n_nationkey"}, ["n_name"])
