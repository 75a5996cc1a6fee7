"""HDF5 metadata with a stand-in for h5py, and opening datasets by its flags."""

import sys
import types
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera
from tessera.functions.conventions import decode_calendar_times
from tessera.scratch import scratch_path
from tessera.sources.catalog import FILL, ArraySpec, Catalog
from tessera.sources.chunk_files import read_payloads, write_array
from tessera.sources.data_source import ChunkedArrayReader
from tessera.sources.hdf5_metadata import attribute_text
from tessera.sources.hdf5_metadata import h5py_metadata as array_metadata
from tests.test_store import store


class FakeDataset:
    def __init__(self, name, dtype, shape, chunks=None, info=(), offset=None, attrs=None, compression=None, shuffle=False, fill=0, maxshape=None):
        self.name, self.dtype, self.shape, self.chunks, self.attrs = f"/{name}", np.dtype(dtype), shape, chunks, attrs or {}
        self.ndim, self.nbytes, self.shuffle, self.fillvalue = len(shape), int(np.prod(shape)) * np.dtype(dtype).itemsize, shuffle, np.array(fill, dtype)
        self.compression, self.compression_opts, self.maxshape = compression, 4 if compression else None, maxshape or shape
        self._filters = {k: 1 for k, on in (("gzip", compression), ("shuffle", shuffle)) if on}
        found = [SimpleNamespace(byte_offset=a, size=s, chunk_offset=o) for a, s, o in info]
        self.id = SimpleNamespace(get_chunk_info=lambda k: found[k], get_num_chunks=lambda: len(found), get_offset=lambda: offset)


@pytest.fixture
def fake_file(monkeypatch):
    """One file with an unlimited time scale, a packed variable on it, and an array that was never written."""
    time = FakeDataset("time", "<f8", (3,), (2,), [(100, 16, (0,)), (116, 16, (2,))], attrs={"CLASS": b"DIMENSION_SCALE", "units": b"hours since 2000-01-01"}, maxshape=(None,))
    lat = FakeDataset("lat", ">f4", (2,), offset=60, attrs={"CLASS": b"DIMENSION_SCALE", "NAME": b"lat"})
    sst = FakeDataset(
        "g/sst", "<i2", (3, 2), (2, 2), [(200, 8, (0, 0)), (208, 8, (2, 0))], compression="gzip", shuffle=True, fill=-9, maxshape=(None, 2),
        attrs={"DIMENSION_LIST": [["r:time"], ["r:lat"]], "_FillValue": np.array([-9], "i2"), "scale_factor": np.array([0.5]), "units": np.bytes_(b"K"), "valid": np.array([1, 2]), "coordinates": np.array([b"lat"])},
    )
    never = FakeDataset("never", "<f8", (4,))
    nodes = {"time": time, "lat": lat, "g/sst": sst, "never": never}

    class File:
        def __init__(self, path, mode):
            pass

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def visititems(self, visit):
            for name, node in nodes.items():
                visit(name, node)

        def __getitem__(self, ref):
            return nodes[ref.removeprefix("r:")]

    module = types.ModuleType("h5py")
    module.File, module.Dataset = File, FakeDataset
    monkeypatch.setitem(sys.modules, "h5py", module)
    return nodes


def test_metadata_of_a_file(spark, fake_file):
    found = {(s.group_path, s.name): (s, c) for _, s, c in array_metadata("f.nc")}
    assert found.keys() == {("", "time"), ("", "lat"), ("g", "sst")}
    sst, chunks = found["g", "sst"]
    assert (sst.dims, sst.unlimited_dims, sst.gzip, sst.shuffle, sst.dtype) == (["time", "lat"], ["time"], 4, True, tessera.ElementType("i", 2, "LE"))
    assert chunks == [(200, 8, [0, 0]), (208, 8, [2, 0])]
    assert sst.attrs == {"_FillValue": "-9", "scale_factor": "0.5", "units": "K", "valid": "[1, 2]", "coordinates": "lat", FILL: "-9", "_UnlimitedDims": "time"}
    assert sst.public_attrs == {"scale_factor": "0.5", "units": "K", "valid": "[1, 2]", "coordinates": "lat"}
    assert sst.encoding("f.nc") == {
        "zlib": True, "complevel": 4, "shuffle": True, "contiguous": False, "chunksizes": (2, 2), "source": "f.nc", "original_shape": (3, 2), "dtype": "int16", "unlimited_dims": {"time"}, "_FillValue": "-9",
    }
    time, lat = found["", "time"][0], found["", "lat"]
    assert time.dims == ["time"] and time.attrs["units"] == "hours since 2000-01-01" and lat[0].dims == ["lat"]
    assert lat[0].dtype.order == "BE" and lat[1] == [(60, 8, [0])] and lat[0].encoding()["contiguous"]
    catalog = Catalog.build(spark, array_metadata("f.nc"))
    assert catalog.spec("g/sst")[1].dims == ["time", "lat"] and catalog.check().filter("NOT complete").count() == 0
    fake_file["lat"]._filters["lzf"] = 1
    with pytest.raises(ValueError, match="lzf"):
        list(array_metadata("f.nc"))


def test_attributes_as_text():
    cases = [(b"m s-1\0", "m s-1"), (np.array([-1e34], "f4"), str(float(np.float32(-1e34)))), (np.float64(2.5), "2.5"), (np.array(["a", "b"]), "[a, b]"), (np.array([], "f4"), "[]"), (object(), None), ("x", "x")]
    assert [attribute_text(v) for v, _ in cases] == [t for _, t in cases]


def test_calendars_of_equal_years(spark):
    def fields(values, units, calendar):
        df = spark.createDataFrame([(v,) for v in values], "v double").select(decode_calendar_times(F.col("v"), units, calendar).alias("t"))
        return [tuple(r["t"]) if r["t"] else None for r in df.collect()]

    assert fields([0.0, 59.0, -1.0, None], "days since 2001-01-01", "noleap") == [(2001, 1, 1, 0, 0, 0, 0), (2001, 3, 1, 0, 0, 0, 0), (2000, 12, 31, 0, 0, 0, 0), None]
    assert fields([59.5], "days since 2001-01-01 06:30:15.5", "all_leap") == [(2001, 2, 29, 18, 30, 15, 500000)]
    assert fields([29.0, 1.0], "days since 2000-02-01", "360_day") == [(2000, 2, 30, 0, 0, 0, 0), (2000, 2, 2, 0, 0, 0, 0)]
    assert fields([13.0], "months since 2000-01-01", "360_day") == [(2001, 2, 1, 0, 0, 0, 0)]
    assert fields([2.0], "years since 2000-01-01", "365_day") == [(2002, 1, 1, 0, 0, 0, 0)]
    with pytest.raises(ValueError, match="units"):
        fields([1.0], "months since 2000-01-01", "noleap")
    with pytest.raises(ValueError, match="calendar"):
        fields([1.0], "days since 2000-01-01", "lunar")


def test_calendar_flags_of_open_dataset(spark):
    spec = ArraySpec("t", tessera.ElementType("i", 4), [2], [2], attrs={"units": "days since 2000-02-01", "calendar": "360_day"})
    index = tessera.Index(store(spark, np.array([0, 29], np.int32), spec))
    assert [r["value"]["day"] for r in index.open_dataset()["t"].orderBy("i0").collect()] == [1, 30]
    with pytest.raises(ValueError, match="360_day"):
        index.open_dataset(use_cftime=False)
    assert [r["value"] for r in index.open_dataset(decode_times=False)["t"].orderBy("i0").collect()] == [0, 29]
    assert index.open_dataset(drop_variables="t") == {}


def test_auxiliary_coordinates_of_two_dimensions(spark):
    f8 = tessera.ElementType("f", 8)
    v = ArraySpec("v", f8, [2, 3], [2, 3], dims=["y", "x"], attrs={"coordinates": "lon"})
    lon = ArraySpec("lon", f8, [2, 3], [1, 3], dims=["y", "x"])
    x = ArraySpec("x", f8, [3], [3], dims=["x"])
    values = np.arange(6.0).reshape(2, 3)
    catalog = store(spark, values, v).union(store(spark, values * 10, lon)).union(store(spark, np.array([7.0, 8.0, 9.0]), x))
    got = tessera.Index(catalog).open_dataset()["v"]
    assert got.columns == ["i0", "i1", "value", "x", "lon"]
    assert sorted(tuple(r) for r in got.collect()) == [(i, j, values[i, j], 7.0 + j, values[i, j] * 10) for i in range(2) for j in range(3)]


def test_outer_indexing_and_cached_reads_equal_numpy(spark):
    values = np.arange(9 * 7 * 3, dtype=np.int32).reshape(9, 7, 3)
    found = tessera.Index(store(spark, values, ArraySpec("x", tessera.ElementType("i", 4, "BE"), [9, 7, 3], [4, 3, 2], gzip=1, shuffle=True)))["x"]
    assert np.array_equal(found[[8, 0, -2, 0], 1:4], values[[8, 0, -2, 0], 1:4])
    mask = np.arange(7) % 3 == 0
    assert np.array_equal(found[2, mask], values[2, mask]) and np.array_equal(found[..., [2, 0]], values[..., [2, 0]])
    assert np.array_equal(found[[1, 5], mask, 0], values[[1, 5]][:, mask, 0]) and found[[], 1].shape == (0, 3)
    with pytest.raises(IndexError):
        found[[9]]
    near = found.cached(max_bytes=3 * 96)
    for key in (0, (3, 2), (slice(2, 9), slice(1, 6), -1), (8, 6, 2), (slice(4, 2),), ...):
        assert np.array_equal(near[key], values[key if key != (slice(4, 2),) else slice(4, 2)]), key
    assert len(near.chunks) <= 3
    near[0, 0, 0]
    near.dataset = None  # what is kept needs no catalog
    assert near[1, 1, 1] == values[1, 1, 1]


def test_many_files_open_as_one(spark):
    f8, indexes = tessera.ElementType("f", 8), []
    for at, n in ((10, 2), (0, 3)):
        time = ArraySpec("time", f8, [n], [2], dims=["time"])
        v = ArraySpec("v", f8, [2, n], [2, 2], dims=["y", "time"])
        y = ArraySpec("y", f8, [2], [2], dims=["y"])
        parts = [(np.arange(n) + float(at), time), (np.arange(2 * n).reshape(2, n) + float(at), v), (np.array([5.0, 6.0]), y)]
        catalogs = [store(spark, *p) for p in parts]
        indexes.append(tessera.Index(catalogs[0].union(catalogs[1]).union(catalogs[2])))
    got = tessera.open_mfdataset(indexes, "time", by="time")
    assert [r["value"] for r in got["time"].orderBy("i0").collect()] == [0, 1, 2, 10, 11]
    want = np.concatenate([np.arange(6.0).reshape(2, 3), np.arange(4.0).reshape(2, 2) + 10], axis=1)
    assert sorted(tuple(r) for r in got["v"].collect()) == [(i, j, want[i, j]) for i in range(2) for j in range(5)]
    assert got["y"].count() == 2
    with pytest.raises(ValueError, match="dimensions"):
        tessera.open_mfdataset(indexes, "y")


def test_two_cells_at_one_place_are_an_error(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 3.0)], "i0 long, value double")
    with pytest.raises(Exception, match="two cells"):
        write_array(df, ArraySpec("x", tessera.ElementType("f", 8), [2], [2]), scratch_path(spark, "x"))


def test_requests_run_together_and_short_files_are_an_error(tmp_path):
    path = tmp_path / "raw"
    path.write_bytes(bytes(range(256)) * 1024)
    addrs = [200_000, 0, 100_000, 5]
    assert read_payloads([str(path)] * 4 + [None], [*addrs, None], [7, 3, 9, 2, None]) == [bytes((a + k) % 256 for k in range(n)) for a, n in zip(addrs, (7, 3, 9, 2), strict=True)] + [None]
    with pytest.raises(ValueError, match="ends before"):
        read_payloads([str(path)] * 2, [0, 262_140], [4, 10])


def test_runs_of_chunks_cover_a_selection(spark):
    """Partitions are planned without chunk rows; together they are the chunks that the selection touches."""
    spec = ArraySpec("x", tessera.ElementType("i", 4), [40, 6], [10, 4])
    folder = scratch_path(spark, "runs")
    store(spark, np.arange(240, dtype=np.int32).reshape(40, 6), spec).write(folder)
    reader = ChunkedArrayReader(spec, folder, "x")
    reader.low, reader.high = [12, 3], [35, 6]
    (whole,) = reader.partitions()
    assert sorted(r[3] for r in reader.chunk_rows(whole)) == [[i, j] for i in (10, 20, 30) for j in (0, 4)]
    whole.first, whole.last = 1, 4
    assert sorted(r[3] for r in reader.chunk_rows(whole)) == [[10, 4], [20, 0], [20, 4]]
