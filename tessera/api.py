"""The array façade: open a catalog, pick an array, subscript it."""

from __future__ import annotations

import itertools
import math
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.conventions import (
    STANDARD_CALENDARS,
    apply_fill_value,
    concat_characters,
    decode_calendar_times,
    decode_coords,
    decode_timedelta,
    decode_times,
    fixed_string,
    is_time_unit,
    mask_and_scale,
    resolve_fill_value,
)
from tessera.functions.dtypes import ElementType
from tessera.operators.extents import from_vectors, index_names, normalize_key, resolve
from tessera.operators.grid import chunk_counts, strides
from tessera.operators.shape import concat
from tessera.sources.catalog import Catalog, normal_path
from tessera.sources.chunk_files import payload_uri, plain_chunk, read_array, read_payloads
from tessera.streaming.segments import stream_values


class Dataset:
    """One array; reads are lazy DataFrames until asked for values."""

    def __init__(self, catalog: Catalog, path: str):
        self.catalog, self.path = catalog, path
        self.file, self.spec = catalog.spec(path)

    def __len__(self) -> int:
        return math.prod(self.spec.shape)

    def __repr__(self) -> str:
        return f"Dataset {self.path}: {list(self.spec.shape)} of {self.spec.dtype.kind}{self.spec.dtype.size}, chunks {list(self.spec.chunk_shape)}"

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.spec.shape)

    @property
    def chunk_shape(self) -> tuple[int, ...]:
        return tuple(self.spec.chunk_shape)

    @property
    def dtype(self) -> ElementType:
        return self.spec.dtype

    @property
    def is_scalar(self) -> bool:
        return not self.spec.shape

    def cells(self, extents: object = ...) -> DataFrame:
        return read_array(self.catalog, self.path, extents)

    def decoded(
        self, extents: object = ..., scale: bool = True, times: bool = True, characters: bool = True, use_cftime: bool | None = None, timedelta: bool | None = None
    ) -> DataFrame:
        """Cells under the array's conventions; each can be left out.

        ``scale``: missing values null, scaled. ``times``: timestamps, in other calendars (or all, with
        ``use_cftime``) structs of date fields; with ``use_cftime`` false other calendars are an error.
        ``timedelta`` (None: as ``times``): numbers of a time unit as intervals. ``characters``: byte fields as
        text, single characters joined along the last dimension.
        """
        cells, value, dtype = self.cells(extents), F.col("value"), self.spec.dtype
        if dtype.kind == "c":
            if not characters:
                return cells
            text = cells.withColumn("value", fixed_string(value))
            rank = len(self.spec.shape)
            if dtype.size > 1 or not rank:
                return text
            *keys, last = index_names(rank)
            plain = cells.withColumn("value", F.decode(value, "UTF-8"))
            return concat_characters(plain, keys, last, "value", "value")
        marker, attrs = resolve_fill_value(self.spec.public_attrs | {k: v for k, v in self.spec.attrs.items() if k in ("_FillValue", "missing_value")})
        marker = None if marker is None else (int if dtype.kind in "iu" else float)(marker)
        units, calendar = attrs.get("units", ""), attrs.get("calendar", "standard").lower()
        masked = value if marker is None else apply_fill_value(value, marker)
        if " since " in units:
            if not times:
                return cells.withColumn("value", masked) if scale else cells
            standard = calendar in STANDARD_CALENDARS
            if standard and not use_cftime:
                return cells.withColumn("value", decode_times(masked, units))
            if use_cftime is False:
                raise ValueError(f"calendar {calendar} has dates that timestamps lack")
            if standard:
                at = decode_times(masked, units)
                fields = {n: F.extract(F.lit(n), at).cast("int") for n in ("year", "month", "day", "hour", "minute")}
                fields |= {"second": F.second(at), "microsecond": F.pmod(F.unix_micros(at.cast("timestamp")), F.lit(1_000_000)).cast("int")}
                return cells.withColumn("value", F.when(masked.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()])))
            return cells.withColumn("value", decode_calendar_times(masked, units, calendar))
        if (times if timedelta is None else timedelta) and is_time_unit(units):
            return cells.withColumn("value", decode_timedelta(masked, units))
        if not scale or not ({"scale_factor", "add_offset"} & attrs.keys() or marker is not None):
            return cells
        return cells.withColumn("value", mask_and_scale(value, float(attrs.get("scale_factor", 1)), float(attrs.get("add_offset", 0)), marker))

    def to_numpy(self, extents: object = ..., out: np.ndarray | None = None) -> np.ndarray:
        """Values of a selection in an array of its counts; ``out`` must have room for them.

        The driver holds the selection, so this is for results, not for whole archives. Chunks that are
        missing give fill values.
        """
        start, count = resolve(extents, self.spec.shape)
        found = np.zeros(math.prod(count), self.spec.dtype.numpy.newbyteorder("=")) if out is None else out.reshape(-1)
        if found.size < math.prod(count):
            raise ValueError("destination has insufficient capacity")
        step = strides(count)
        for batch in self.cells(extents).toArrow().to_batches():
            at = np.zeros(batch.num_rows, np.int64)
            for j in range(len(count)):
                at += (batch.column(j).to_numpy() - start[j]) * step[j]
            column = batch.column("value")
            wide = [int(v) for v in column.to_pylist()] if self.spec.dtype.kind == "u" and self.spec.dtype.size == 8 else column.to_numpy(zero_copy_only=False)
            found[at] = wide
        return found[: math.prod(count)].reshape(count)

    def __getitem__(self, key: object) -> np.ndarray:
        """NumPy subscripts of step 1; lists, arrays and masks index their axis by itself (outer indexing)."""
        items = list(key) if isinstance(key, tuple) else [key]
        if any(isinstance(i, (list, np.ndarray)) for i in items):
            return self._outer(items)
        start, count, squeezed = normalize_key(key, self.spec.shape)
        found = self.to_numpy(from_vectors(start, count)) if self.spec.shape else self.to_numpy()
        return found.reshape([c for c, s in zip(count, squeezed, strict=True) if not s])

    def _outer(self, items: list[object]) -> np.ndarray:
        """The box that the wanted indices span, without cells that no list names; then each list's order."""
        if any(i is Ellipsis for i in items):
            k = next(k for k, i in enumerate(items) if i is Ellipsis)
            items[k : k + 1] = [slice(None)] * (len(self.spec.shape) - len(items) + 1)
        lists: dict[int, np.ndarray] = {}
        for j, item in enumerate(items):
            if not isinstance(item, (list, np.ndarray)):
                continue
            n, wanted = self.spec.shape[j], np.asarray(item)
            if wanted.dtype == bool:
                if len(wanted) != n:
                    raise IndexError(f"a mask of {len(wanted)} for a dimension of size {n}")
                wanted = np.flatnonzero(wanted)
            wanted = wanted.astype(np.int64)
            if wanted.ndim != 1 or ((wanted < -n) | (wanted >= n)).any():
                raise IndexError(f"indices leave a dimension of size {n}, or are not one-dimensional")
            lists[j] = wanted % max(n, 1)
            items[j] = slice(int(lists[j].min()), int(lists[j].max()) + 1) if len(wanted) else slice(0, 0)
        start, count, squeezed = normalize_key(tuple(items), self.spec.shape)
        cells = self.cells(from_vectors(start, count))
        for j, wanted in lists.items():
            cells = cells.filter(F.col(f"i{j}").isin(np.unique(wanted).tolist()))
        axes = [np.unique(lists[j]) if j in lists else np.arange(s, s + c) for j, (s, c) in enumerate(zip(start, count, strict=True))]
        found = np.zeros([len(a) for a in axes], self.spec.dtype.numpy.newbyteorder("="))
        table = cells.toArrow()
        at = tuple(np.searchsorted(a, table.column(f"i{j}").to_numpy()) for j, a in enumerate(axes))
        column = table.column("value")
        found[at] = [int(v) for v in column.to_pylist()] if self.spec.dtype.kind == "u" and self.spec.dtype.size == 8 else column.to_numpy()
        for j, wanted in lists.items():
            found = np.take(found, np.searchsorted(axes[j], wanted), axis=j)
        return found.reshape([n for n, s in zip(found.shape, squeezed, strict=True) if not s])

    def cached(self, max_bytes: int = 64 << 20) -> CachedDataset:
        """The array for repeated small reads on the driver."""
        return CachedDataset(self, max_bytes)

    def stream(self, extents: object = ...) -> Iterator[np.ndarray]:
        return stream_values(self.catalog, self.path, extents)


class CachedDataset:
    """Small reads of one array on the driver, without a job for chunks seen before.

    Decoded chunks stay in memory up to ``max_bytes``, the least recently used going first. Addresses of the
    chunks that a read lacks come from the chunk table in one small job.
    """

    def __init__(self, dataset: Dataset, max_bytes: int):
        self.dataset, self.max_bytes = dataset, max_bytes
        self.spec, self.chunks = dataset.spec, OrderedDict()

    def _load(self, wanted: list[int]) -> dict[int, np.ndarray]:
        spec, found = self.spec, {k: self.chunks[k] for k in wanted if k in self.chunks}
        lacking = [k for k in wanted if k not in found]
        if lacking:
            own = self.dataset.catalog.chunks.filter((F.col("name") == spec.name) & (F.col("group_path") == normal_path(spec.group_path)) & F.col("chunk_id").isin(lacking))
            rows = {r["chunk_id"]: r for r in own.select("chunk_id", payload_uri(), "addr", "size").collect()}
            none = {"file": None, "addr": None, "size": None}
            payloads = read_payloads(*([rows.get(k, none)[c] for k in lacking] for c in ("file", "addr", "size")))
            for k, raw in zip(lacking, payloads, strict=True):
                found[k] = spec.dtype.native(plain_chunk(raw, spec)).reshape(tuple(spec.chunk_shape))
        for k in wanted:
            self.chunks[k] = found[k]
            self.chunks.move_to_end(k)
        while len(self.chunks) > 1 and len(self.chunks) * spec.chunk_bytes > self.max_bytes:
            self.chunks.popitem(last=False)
        return found

    def __getitem__(self, key: object) -> np.ndarray:
        spec = self.spec
        start, count, squeezed = normalize_key(key, spec.shape)
        out = np.zeros(count, spec.dtype.numpy.newbyteorder("="))
        if all(count):
            scaled = strides(chunk_counts(spec.shape, spec.chunk_shape))
            axes = [range(s // c, (s + n - 1) // c + 1) for s, n, c in zip(start, count, spec.chunk_shape, strict=True)]
            places = {sum(p * s for p, s in zip(at, scaled, strict=True)): at for at in itertools.product(*axes)}
            for k, chunk in self._load(list(places)).items():
                inside, outside = [], []
                for p, c, s, n in zip(places[k], spec.chunk_shape, start, count, strict=True):
                    low, high = max(s, p * c), min(s + n, p * c + c)
                    inside.append(slice(low - p * c, high - p * c))
                    outside.append(slice(low - s, high - s))
                out[tuple(outside)] = chunk[tuple(inside)]
        return out.reshape([c for c, s in zip(count, squeezed, strict=True) if not s])


class Index:
    """A catalog with subscripts by path: ``index["a/b/x"][0:2, ...]``."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        return cls(Catalog.read(spark, folder))

    def dataset(self, name: str, group: str | None = None) -> Dataset | None:
        path = "/".join(p for p in (normal_path(group), normal_path(name)) if p)
        return Dataset(self.catalog, path) if self.catalog.dataset(path).take(1) else None

    def __getitem__(self, path: str) -> Dataset:
        found = self.dataset(path)
        if found is None:
            raise KeyError(path)
        return found

    def datasets(self, group: str | None = None) -> list[str]:
        return sorted(r["name"] for r in self.catalog.list_datasets(group).select("name").collect())

    def groups(self, group: str | None = None) -> list[str]:
        return sorted(r["name"] for r in self.catalog.list_groups(group).collect())

    def variables(self, group: str | None = None, drop: tuple[str, ...] = (), decode: bool = True) -> dict[str, DataFrame]:
        """All arrays of a group as lazy DataFrames, decoded by convention."""
        found = {n: self.dataset(n, group) for n in self.datasets(group) if n not in drop}
        return {n: d.decoded() if decode else d.cells() for n, d in found.items()}

    def open_dataset(
        self,
        *,
        drop_variables: str | Sequence[str] | None = None,
        mask_and_scale: bool = True,
        decode_times: bool = True,
        concat_characters: bool = True,
        decode_coords: bool = True,
        use_cftime: bool | None = None,
        decode_timedelta: bool | None = None,
        group: str | None = None,
    ) -> dict[str, DataFrame]:
        """Variables of a group as lazy DataFrames of cells, under the usual decoding flags.

        With ``decode_coords`` each variable's cells carry its coordinates as columns: arrays of one dimension that are
        named like one of its dimensions, and those that its ``coordinates`` attribute names.
        """
        drop = {drop_variables} if isinstance(drop_variables, str) else set(drop_variables or ())
        arrays = {n: self.dataset(n, group) for n in self.datasets(group) if n not in drop}
        flags = {"scale": mask_and_scale, "times": decode_times, "characters": concat_characters, "use_cftime": use_cftime, "timedelta": decode_timedelta}
        cells = {n: d.decoded(**flags) for n, d in arrays.items()}
        return {n: attach_coords(n, arrays, cells) if decode_coords else c for n, c in cells.items()}

    def __repr__(self) -> str:
        return f"Index: datasets {self.datasets()}, groups {self.groups()}"


def attach_coords(name: str, arrays: dict[str, Dataset], cells: dict[str, DataFrame]) -> DataFrame:
    """Cells of a variable with its coordinates as columns named like them."""
    spec, out = arrays[name].spec, cells[name]
    listed = spec.attrs.get("coordinates", "").split()
    for coord in dict.fromkeys([*spec.dims, *listed]):
        other = arrays.get(coord)
        if other is None or coord == name or not set(other.spec.dims) <= set(spec.dims) or (coord not in listed and list(other.spec.dims) != [coord]):
            continue
        on = {f"i{list(spec.dims).index(d)}": f"i{j}" for j, d in enumerate(other.spec.dims)}
        on = {a: b for a, b in on.items() if a in out.columns and b in cells[coord].columns}
        out = decode_coords(out, cells[coord].withColumnRenamed("value", coord), on, [coord])
    return out


def open_mfdataset(indexes: Sequence[Index], dim: str, by: str | None = None, group: str | None = None, decode: bool = True) -> dict[str, DataFrame]:
    """Variables of several files as one, joined along the dimension ``dim``.

    Files come in the order given or, with ``by``, in order of the first value of that variable. Sizes come from the
    catalogs. A variable without ``dim`` is taken from the first file; one that has it must be in all files, with
    equal sizes in its other dimensions. Reads are lazy.
    """
    if not indexes:
        raise ValueError("nothing to open")
    if by is not None:
        first = [(i.dataset(by, group).cached()[(0,) * len(i.dataset(by, group).shape)], k) for k, i in enumerate(indexes)]
        indexes = [indexes[k] for _, k in sorted((v.item(), k) for v, k in first)]
    out = {}
    for name in indexes[0].datasets(group):
        head = indexes[0].dataset(name, group)
        if dim not in head.spec.dims:
            out[name] = head.decoded() if decode else head.cells()
            continue
        parts, axis = [i.dataset(name, group) for i in indexes], list(head.spec.dims).index(dim)
        if any(p is None or [n for j, n in enumerate(p.shape) if j != axis] != [n for j, n in enumerate(head.shape) if j != axis] for p in parts):
            raise ValueError(f"{name} is missing from a file, or its other dimensions differ")
        out[name] = concat([(p.decoded() if decode else p.cells(), p.shape[axis]) for p in parts], axis)
    return out
