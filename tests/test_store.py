import random

import numpy as np
import pytest

import tessera
from tessera.operators.grid import unravel
from tessera.scratch import scratch_path
from tessera.sources.catalog import FILL, ArraySpec, Catalog, chunks_as_numbers, numbers_as_chunks
from tessera.sources.chunk_files import write_array
from tessera.sources.data_source import register
from tessera.streaming.segments import stream_bytes, stream_values, stream_xdr


def store(spark, values, spec):
    flat = spark.createDataFrame([(k, v.item()) for k, v in enumerate(values.ravel())], "id long, value " + spec.dtype.spark.simpleString())
    return write_array(flat.select(*unravel("id", spec.shape), "value") if spec.shape else flat.select("value"), spec, scratch_path(spark, spec.name))


@pytest.mark.parametrize(
    ("dtype", "shape", "chunk", "shuffle", "gzip"),
    [("<f4", [9, 7], [4, 3], True, 4), (">i2", [30], [7], False, None), (">f8", [3, 5, 4], [2, 2, 4], True, 1), ("u1", [6, 6], [6, 6], False, 9), ("<i4", [2, 3, 2, 3], [1, 2, 2, 2], True, None)],
)
def test_subscripts_equal_numpy(spark, dtype, shape, chunk, shuffle, gzip):
    t = tessera.ElementType.parse(dtype)
    values = np.random.default_rng(2).integers(0, 100, shape).astype(t.numpy.newbyteorder("="))
    found = tessera.Index(store(spark, values, ArraySpec("x", t, shape, chunk, shuffle, gzip, group_path="a/b")))["a/b/x"]
    assert (found[...] == values).all() and len(found) == values.size and found.shape == values.shape
    rng = random.Random(1)
    for _ in range(2):
        key = tuple(slice(a := rng.randrange(n), rng.randint(a, n)) if rng.random() < 0.7 else rng.randrange(-n, n) for n in shape)
        assert np.array_equal(found[key], values[key]), key
    start = [n // 3 for n in shape]
    extents = tessera.from_vectors(start, [n - s for n, s in zip(shape, start, strict=True)])
    want = values[tuple(slice(s, None) for s in start)].ravel()
    assert np.array_equal(np.concatenate(list(stream_values(found.catalog, "a/b/x", extents))), want)
    assert b"".join(stream_bytes(found.catalog, "a/b/x", extents)) == want.astype(t.numpy).tobytes()
    wide = want.astype(f">{t.kind}4") if t.kind in "iu" and t.size < 4 else want.astype(f">{t.kind}{t.size}")
    assert b"".join(stream_xdr(found.catalog, "a/b/x", extents)) == wide.tobytes()


def test_errors_of_reads(spark):
    catalog = store(spark, np.arange(6.0), ArraySpec("x", tessera.ElementType("f", 8), [6], [2]))
    x = tessera.Index(catalog)["x"]
    with pytest.raises(IndexError):
        x.to_numpy([tessera.run(4, 3)])
    with pytest.raises(ValueError, match="capacity"):
        x.to_numpy(out=np.zeros(3))
    with pytest.raises(KeyError):
        tessera.Index(catalog)["y"]
    assert tessera.Index(catalog).dataset("y") is None
    assert x[4:2].shape == (0,)


def test_unsigned_64_bits(spark):
    spec = ArraySpec("x", tessera.ElementType("u", 8), [3], [2])
    values = np.array([0, 1, 2**64 - 1], np.uint64)
    df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(values)], "i0 long, value string").selectExpr("i0", "CAST(value AS decimal(20,0)) AS value")
    found = tessera.Index(write_array(df, spec, scratch_path(spark, "x")))["x"]
    assert (found[...] == values).all()


def test_groups_and_storage(spark):
    f8 = tessera.ElementType("f", 8)
    specs = [ArraySpec(n, f8, [1], [1], group_path=g) for n, g in (("x", ""), ("x", "a/b"), ("x", "a/b/c"), ("y", "a"))]
    path = scratch_path(spark, "catalog")
    Catalog.build(spark, [("f", s, [(0, 8, [0])]) for s in specs]).write(path)
    index = tessera.Index.open(spark, path)
    assert index.datasets() == ["x"] and index.groups() == ["a"] and index.groups("/") == ["a"]
    for spelling in ("a/b", "/a/b", "a/b/", "/a/b/"):
        assert index.datasets(spelling) == ["x"] and index.groups(spelling) == ["c"]
        assert index.dataset("x", spelling).path == "a/b/x"
    assert index.datasets("none") == []
    assert index.catalog.group("a").datasets.count() == 3
    assert [r["complete"] for r in index.catalog.check().collect()] == [True] * 4


def test_missing_chunks_show_and_read_as_nothing(spark):
    catalog = store(spark, np.arange(6.0), ArraySpec("x", tessera.ElementType("f", 8), [6], [2]))
    sparse = Catalog(catalog.datasets, catalog.chunks.filter("chunk_id <> 1"))
    row = sparse.check().first()
    assert (row["found"], row["due"], row["complete"]) == (2, 3, False)
    assert tessera.Index(sparse)["x"][...].tolist() == [0, 1, 0, 0, 4, 5]


def test_numbers_round_trip(spark):
    catalog = Catalog.build(spark, [("f", ArraySpec("x", tessera.ElementType("f", 4), [20, 40], [10, 20]), [(3, 17, [10, 20]), (2, 7, [0, 20]), (1, 5, [0, 0])])])
    flat = chunks_as_numbers(catalog.chunks)
    assert flat.first()["numbers"] == [1, 5, 0, 0, 2, 7, 0, 20, 3, 17, 10, 20]
    back = numbers_as_chunks(flat, 2).select("addr", "size", "offset").collect()
    assert sorted((r["addr"], r["size"], r["offset"]) for r in back) == [(1, 5, [0, 0]), (2, 7, [0, 20]), (3, 17, [10, 20])]
    with pytest.raises(Exception, match="divide"):
        numbers_as_chunks(flat, 3).count()


def test_data_source_prunes_chunks(spark):
    spec = ArraySpec("x", tessera.ElementType("i", 4), [40, 6], [10, 4], gzip=2, group_path="g")
    folder = scratch_path(spark, "source")
    values = np.arange(240, dtype=np.int32).reshape(40, 6)
    store(spark, values, spec).write(folder)
    register(spark)
    df = spark.read.format("chunked_array").option("catalog", folder).option("dataset", "g/x").load()
    picked = df.filter("i0 > 11 AND i0 <= 13 AND i1 = 5 AND value <> 77")
    assert sorted(tuple(r) for r in picked.collect()) == [(i, 5, int(values[i, 5])) for i in (12, 13) if values[i, 5] != 77]
    assert df.filter("i0 IN (1, 39)").count() == 12
    assert df.filter("i0 >= 40").count() == 0


def test_conventions_of_variables(spark):
    spec = ArraySpec("t", tessera.ElementType("i", 2), [4], [2], attrs={"_FillValue": "-9", "scale_factor": "0.5", "add_offset": "1"})
    catalog = store(spark, np.array([2, -9, 4, 6], np.int16), spec)
    got = tessera.Index(catalog).variables()["t"].orderBy("i0").collect()
    assert [r["value"] for r in got] == [2.0, None, 3.0, 4.0]
    assert tessera.Index(catalog).variables(drop=("t",)) == {}


def test_files_are_indexed_by_executors(spark):
    f8 = tessera.ElementType("f", 8)

    def provider(file):
        yield file, ArraySpec("x", f8, [5], [2], attrs={"units": "m"}, group_path="g"), [(48, 8, [4]), (16, 16, [0]), (32, 16, [2])]
        yield file, ArraySpec("scalar", f8, [], []), [(0, 8, [])]

    files = spark.createDataFrame([(f"f{k}",) for k in range(7)], "file string")
    found = Catalog.index_files(files, provider)
    want = Catalog.build(spark, [e for k in range(7) for e in provider(f"f{k}")])
    for part in ("datasets", "chunks"):
        a, b = (sorted(map(str, getattr(c, part).collect())) for c in (found, want))
        assert a == b
    assert found.check().filter("NOT complete").count() == 0
    path = scratch_path(spark, "json")
    found.write(path, source="json")
    assert sorted(map(str, Catalog.read(spark, path, "json").chunks.collect())) == sorted(map(str, want.chunks.collect()))


def test_chunks_never_written_read_as_fill_values(spark):
    values = np.arange(60, dtype=np.int32).reshape(10, 6)
    for attrs, fill in (({}, 0), ({"_FillValue": "-9"}, -9), ({"_FillValue": "-9", FILL: "7"}, 7)):
        whole = store(spark, values, ArraySpec("x", tessera.ElementType("i", 4, "BE"), [10, 6], [4, 4], gzip=2, attrs=attrs))
        sparse = Catalog(whole.datasets, whole.chunks.filter("chunk_id NOT IN (0, 3, 5)"))
        want = values.copy()
        want[:4, :4] = want[4:8, 4:] = want[8:, 4:] = fill
        extents = tessera.from_vectors([1, 2], [9, 4])
        assert np.array_equal(tessera.Index(sparse)["x"][...], want)
        assert sparse.chunks.count() == 3 and tessera.Index(sparse)["x"].cells(extents).count() == 36
        assert np.array_equal(np.concatenate(list(stream_values(sparse, "x", extents))), want[1:, 2:].ravel())
    folder = scratch_path(spark, "sparse")
    sparse.write(folder)
    register(spark)
    df = spark.read.format("chunked_array").option("catalog", folder).option("dataset", "x").load()
    assert sorted(tuple(r) for r in df.collect()) == [(i, j, int(want[i, j])) for i in range(10) for j in range(6)]
    assert sorted(tuple(r) for r in df.filter("i0 >= 5 AND i1 = 4").collect()) == [(i, 4, int(want[i, 4])) for i in range(5, 10)]
    none = Catalog(whole.datasets, whole.chunks.limit(0))
    assert tessera.Index(none)["x"][...].tolist() == np.full((10, 6), 7).tolist()
    scalar = store(spark, np.array(5.0), ArraySpec("s", tessera.ElementType("f", 8), [], [], attrs={"_FillValue": "1.5"}))
    assert tessera.Index(scalar)["s"][...] == 5 and tessera.Index(Catalog(scalar.datasets, scalar.chunks.limit(0)))["s"][...] == 1.5
