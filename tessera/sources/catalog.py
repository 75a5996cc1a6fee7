"""The catalog of arrays: datasets and chunks as DataFrames, which are the contract of every reader.

datasets: file, group_path, name, kind, dsize, byte_order, shape, chunk_shape, dim_sz, chunk_dim_sz,
scaled_dim_sz, shuffle, gzip, dims, attrs. chunks: file, part, group_path, name, chunk_id, addr, size,
offset. The root group is ``''``. A chunk lies in the file itself, or in its ``part`` where ``file`` is a folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.conventions import resolve_fill_value
from tessera.functions.dtypes import ElementType
from tessera.operators.grid import chunk_counts, strides
from tessera.scratch import map_batches, materialize

DATASETS = (
    "file string, group_path string, name string, kind string, dsize int, byte_order string, shape array<bigint>, "
    "chunk_shape array<bigint>, dim_sz array<bigint>, chunk_dim_sz array<bigint>, scaled_dim_sz array<bigint>, "
    "shuffle boolean, gzip int, dims array<string>, attrs map<string,string>"
)
CHUNKS = "file string, part string, group_path string, name string, chunk_id bigint, addr bigint, size bigint, offset array<bigint>"

#: The attribute for a fill value that a file has apart from its attributes.
FILL = "_ChunkFill"
#: The attribute that names unlimited dimensions, with commas between.
UNLIMITED = "_UnlimitedDims"


@dataclass
class ArraySpec:
    """One array: its type, shape, chunking and filters. Strides derive from these."""

    name: str
    dtype: ElementType
    shape: Sequence[int]
    chunk_shape: Sequence[int]
    shuffle: bool = False
    gzip: int | None = None
    dims: Sequence[str] = ()
    attrs: dict[str, str] = field(default_factory=dict)
    group_path: str = ""

    def __post_init__(self):
        if len(self.shape) != len(self.chunk_shape):
            raise ValueError(f"shape has {len(self.shape)} dimensions, chunks have {len(self.chunk_shape)}")
        if any(c <= 0 for c in self.chunk_shape):
            raise ValueError("chunk sizes must be positive")

    @property
    def chunk_bytes(self) -> int:
        return math.prod(self.chunk_shape) * self.dtype.size

    @property
    def fill(self) -> bytes:
        """Bytes of an element that was never written: the file's own fill value, else the marker of missing data, else zero."""
        marker = self.attrs.get(FILL, resolve_fill_value(dict(self.attrs))[0])
        if marker is None:
            return bytes(self.dtype.size)
        if self.dtype.kind == "c":
            return str(marker).encode()[: self.dtype.size].ljust(self.dtype.size, b"\0")
        return np.array((int if self.dtype.kind in "iu" else float)(marker)).astype(self.dtype.numpy).tobytes()

    @property
    def unlimited_dims(self) -> list[str]:
        return [d for d in self.attrs.get(UNLIMITED, "").split(",") if d]

    @property
    def public_attrs(self) -> dict[str, str]:
        """Attributes of the variable itself: without missing-data markers and what the catalog adds."""
        return {k: v for k, v in self.attrs.items() if k not in (FILL, UNLIMITED, "_FillValue", "missing_value", "least_significant_digit")}

    def encoding(self, source: str | None = None) -> dict[str, object]:
        """How the array is stored."""
        whole = list(self.chunk_shape) == list(self.shape) and self.gzip is None and not self.shuffle
        out: dict[str, object] = {
            "zlib": self.gzip is not None, "complevel": self.gzip or 0, "shuffle": bool(self.shuffle), "contiguous": whole, "chunksizes": None if whole else tuple(self.chunk_shape),
            "source": source, "original_shape": tuple(self.shape), "dtype": str(self.dtype.numpy), "unlimited_dims": set(self.unlimited_dims),
        }
        return out | {k: self.attrs[k] for k in ("_FillValue", "missing_value", "least_significant_digit") if k in self.attrs}

    def row(self, file: str) -> tuple:
        scaled = strides(chunk_counts(self.shape, self.chunk_shape))
        return (
            file, normal_path(self.group_path), self.name, self.dtype.kind, self.dtype.size, self.dtype.order, list(self.shape), list(self.chunk_shape),
            strides(self.shape), strides(self.chunk_shape), scaled, self.shuffle, self.gzip, list(self.dims), dict(self.attrs),
        )

    @classmethod
    def of(cls, r: T.Row) -> ArraySpec:
        return cls(r["name"], ElementType(r["kind"], r["dsize"], r["byte_order"]), r["shape"], r["chunk_shape"], r["shuffle"], r["gzip"], r["dims"] or (), r["attrs"] or {}, r["group_path"])


#: From a file name to its arrays: (file, spec, chunks as (addr, size, offset)).
Provider = Callable[[str], Iterable[tuple[str, "ArraySpec", Iterable[tuple[int, int, Sequence[int]]]]]]


def numbered_chunks(spec: ArraySpec, found: Iterable[tuple[int, int, Sequence[int]]]) -> list[tuple[int, int, int, list[int]]]:
    """(chunk_id, addr, size, offset), sorted by offset."""
    scaled = strides(chunk_counts(spec.shape, spec.chunk_shape))
    number = lambda offset: sum(o // c * s for o, c, s in zip(offset, spec.chunk_shape, scaled, strict=True))
    return [(number(offset), addr, size, list(offset)) for addr, size, offset in sorted(found, key=lambda c: tuple(c[2]))]


def normal_path(path: str | None) -> str:
    """Group paths without outer slashes; None, ``''`` and ``/`` are the root."""
    return (path or "").strip("/")


class Catalog:
    """Arrays of one or many files: lookups, listings, checks and storage."""

    def __init__(self, datasets: DataFrame, chunks: DataFrame):
        self.datasets, self.chunks = datasets, chunks

    @classmethod
    def build(cls, spark: SparkSession, entries: Iterable[tuple[str, ArraySpec, Iterable[tuple[int, int, Sequence[int]]]]]) -> Catalog:
        """From (file, spec, [(addr, size, offset)]) of a metadata provider, chunks sorted by offset.

        An array stored contiguously has one chunk of its whole shape. This runs on the driver: for a
        few files; for many, see :meth:`index_files`.
        """
        datasets, chunks = [], []
        for file, spec, found in entries:
            datasets.append(spec.row(file))
            chunks += [(file, None, normal_path(spec.group_path), spec.name, *c) for c in numbered_chunks(spec, found)]
        return cls(spark.createDataFrame(datasets, DATASETS), spark.createDataFrame(chunks, CHUNKS))

    @classmethod
    def index_files(cls, files: DataFrame, provider: Provider) -> Catalog:
        """From a table of file names (column ``file``), each indexed by an executor with ``provider``.

        A file that cannot be indexed fails the job. The metadata are written once and read by both tables.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file in batch.column("file").to_pylist():
                    rows = []
                    for name, spec, found in provider(file):
                        chunks = [dict(zip(("chunk_id", "addr", "size", "offset"), c, strict=True)) for c in numbered_chunks(spec, found)]
                        row = spec.row(name)
                        rows.append(dict(zip(arrow.names, (*row[:-1], list(row[-1].items()), chunks), strict=True)))
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, arrow)

        schema = T.StructType.fromDDL(f"{DATASETS}, chunks array<struct<chunk_id: bigint, addr: bigint, size: bigint, offset: array<bigint>>>")
        arrow = to_arrow_schema(schema)
        found = materialize(map_batches(files.select("file").repartition("file"), run, schema), "index")
        keys = ["file", F.lit(None).cast("string").alias("part"), "group_path", "name"]
        return cls(found.drop("chunks"), found.select(*keys, F.inline("chunks")))

    def union(self, other: Catalog) -> Catalog:
        return Catalog(self.datasets.unionByName(other.datasets), self.chunks.unionByName(other.chunks))

    # Lookups. Paths are accepted with and without outer slashes.

    def dataset(self, path: str, group: str | None = None) -> DataFrame:
        """The catalog row of ``a/b/x`` (or x in ``group``): empty if there is none."""
        whole = normal_path("/".join(p for p in (normal_path(group), normal_path(path)) if p))
        parent, _, name = whole.rpartition("/")
        return self.datasets.filter((F.col("group_path") == parent) & (F.col("name") == name))

    def spec(self, path: str, group: str | None = None) -> tuple[str, ArraySpec]:
        """(file, spec) of one dataset; an error if there is none, or several files have it."""
        rows = self.dataset(path, group).take(2)
        if not rows:
            raise KeyError(f"dataset does not exist: {path}")
        if len(rows) > 1:
            raise KeyError(f"several files have dataset {path}")
        return rows[0]["file"], ArraySpec.of(rows[0])

    def group(self, path: str | None) -> Catalog:
        """The part of the catalog at and below a group."""
        p = normal_path(path)
        inside = (F.col("group_path") == p) | F.col("group_path").startswith(f"{p}/") if p else F.lit(True)
        return Catalog(self.datasets.filter(inside), self.chunks.filter(inside))

    def list_datasets(self, group: str | None = None) -> DataFrame:
        """Names and shapes at one level."""
        return self.datasets.filter(F.col("group_path") == normal_path(group)).select("name", "shape")

    def list_groups(self, group: str | None = None) -> DataFrame:
        """Names of child groups at one level."""
        p = normal_path(group)
        below = F.when(F.col("group_path").startswith(f"{p}/"), F.substring(F.col("group_path"), len(p) + 2, 1 << 20)) if p else F.when(F.col("group_path") != "", F.col("group_path"))
        return self.datasets.select(F.split_part(below, F.lit("/"), F.lit(1)).alias("name")).filter("name IS NOT NULL").distinct()

    def check(self) -> DataFrame:
        """By dataset: chunks found and due, whether offsets are aligned, and whether it is complete.

        A chunk that is missing reads as fill values; here it shows as ``complete`` false.
        """
        due = F.aggregate(
            F.zip_with("shape", "chunk_shape", lambda n, c: F.ceil(n / c)), F.lit(1).cast("long"), lambda a, n: a * n
        )
        keys = ["file", "group_path", "name"]
        joined = self.datasets.join(self.chunks.select(*keys, "offset"), keys, "left")
        aligned = F.forall(F.zip_with(F.zip_with("offset", "chunk_shape", lambda o, c: o % c), F.zip_with("offset", "shape", lambda o, n: o >= n), lambda m, out: (m == 0) & ~out), lambda ok: ok)
        return joined.groupBy(*keys).agg(
            F.count("offset").alias("found"), F.first(due).alias("due"), F.coalesce(F.bool_and(aligned), F.lit(True)).alias("aligned"), F.countDistinct("offset").alias("_distinct")
        ).withColumn("complete", (F.col("found") == F.col("due")) & (F.col("_distinct") == F.col("due"))).drop("_distinct")

    # Storage.

    def write(self, path: str, mode: str = "errorifexists", source: str = "parquet") -> None:
        """Store as ``parquet`` (what the data source reads), ``orc`` or ``json``.

        Chunk rows are stored in order of array and chunk, so a range of chunks is found by file statistics.
        """
        self.datasets.write.mode(mode).format(source).save(f"{path}/datasets")
        keys = ["group_path", "name", "chunk_id"]
        self.chunks.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).format(source).save(f"{path}/chunks")

    @classmethod
    def read(cls, spark: SparkSession, path: str, source: str = "parquet") -> Catalog:
        read = lambda schema, part: spark.read.schema(schema).format(source).load(f"{path}/{part}")
        return cls(read(DATASETS, "datasets"), read(CHUNKS, "chunks"))


def chunks_as_numbers(chunks: DataFrame) -> DataFrame:
    """Chunk lists as one array of numbers per dataset: addr, size, offsets, and so on by offset."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "addr", "size")))
    flat = F.flatten(F.transform(rows, lambda r: F.concat(F.array(r["addr"], r["size"]), r["offset"])))
    return chunks.groupBy("file", "group_path", "name").agg(flat.alias("numbers"))


def numbers_as_chunks(flat: DataFrame, rank: int) -> DataFrame:
    """The inverse; a length that does not divide by 2 + rank is an error."""
    width = 2 + rank
    ok = F.assert_true(F.size("numbers") % width == 0, F.lit("numbers do not divide into chunks"))
    checked = flat.withColumn("_ok", ok).filter(F.col("_ok").isNull())
    rows = F.sequence(F.lit(0), F.floor(F.size("numbers") / width).cast("int") - 1)
    some = checked.filter(F.size("numbers") > 0).withColumn("k", F.explode(rows))
    at = F.col("k") * width
    return some.select(
        "file", "group_path", "name", F.element_at("numbers", at + 1).alias("addr"), F.element_at("numbers", at + 2).alias("size"), F.slice("numbers", at + 3, F.lit(rank)).alias("offset")
    )
