"""Spark data source ``chunked_array``: cells of one array of a stored catalog.

    spark.dataSource.register(ChunkedArraySource)
    spark.read.format("chunked_array").option("catalog", uri).option("dataset", "a/b/x").load()

Comparisons on index columns prune chunks before any is read (with
``spark.sql.python.filterPushdown.enabled``). A partition is a run of chunks; its task finds their addresses.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import LongType, StructField, StructType

from tessera.operators.extents import index_names
from tessera.operators.grid import chunk_counts, strides
from tessera.sources.catalog import ArraySpec, normal_path
from tessera.sources.chunk_files import chunk_cells, file_system, read_payloads, value_array

#: Decoded bytes of the chunks of a partition, about.
PARTITION_BYTES = 64 * 1024 * 1024


@dataclass
class ChunkRun(InputPartition):
    """Chunks ``first`` to before ``last`` in the order of those that the selection touches."""

    first: int
    last: int
    start: list[int]
    count: list[int]


class ChunkedArrayReader(DataSourceReader):
    def __init__(self, spec: ArraySpec, catalog: str, wanted: str):
        self.spec, self.catalog, self.wanted = spec, catalog, wanted
        self.low, self.high = [0] * len(spec.shape), list(spec.shape)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of an index with a number; gives the others back."""
        names = index_names(len(self.spec.shape))
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in names:
                yield f
                continue
            j = names.index(column)
            if isinstance(f, IsNotNull):
                continue  # an index is never null
            if isinstance(f, EqualTo):
                low, high = f.value, f.value + 1
            elif isinstance(f, GreaterThan):
                low, high = f.value + 1, self.high[j]
            elif isinstance(f, GreaterThanOrEqual):
                low, high = f.value, self.high[j]
            elif isinstance(f, LessThan):
                low, high = 0, f.value
            elif isinstance(f, LessThanOrEqual):
                low, high = 0, f.value + 1
            elif isinstance(f, In) and all(v is not None for v in f.value):
                low, high = min(f.value), max(f.value) + 1
                yield f  # prunes to the range; Spark applies the list
            else:
                yield f
                continue
            self.low[j], self.high[j] = max(self.low[j], low), min(self.high[j], high)

    def touched(self) -> list[range]:
        """By axis, the numbers of the chunks that the selection touches."""
        return [range(low // c, -(-high // c)) for low, high, c in zip(self.low, self.high, self.spec.chunk_shape, strict=True)]

    def partitions(self) -> list[InputPartition]:
        """Runs of chunks, by arithmetic: the driver reads no chunk rows."""
        count = [h - low for low, h in zip(self.low, self.high, strict=True)]
        if any(c <= 0 for c in count):
            return []
        total = math.prod(map(len, self.touched()))
        many = max(1, PARTITION_BYTES // max(1, self.spec.chunk_bytes))
        return [ChunkRun(k, min(k + many, total), list(self.low), count) for k in range(0, total, many)]

    def chunk_rows(self, run: ChunkRun) -> list[tuple[str | None, int | None, int | None, list[int]]]:
        """(file, addr, size, offset) of a run's chunks, in order of address; no file for those never written.

        The chunk table is read by a range of chunk numbers, which its files' statistics prune.
        """
        axes = self.touched()
        scaled = strides(chunk_counts(self.spec.shape, self.spec.chunk_shape))
        offsets: dict[int, list[int]] = {}
        for k in range(run.first, run.last):
            at = []
            for axis in reversed(axes):
                k, rest = divmod(k, len(axis))
                at.append(axis[rest])
            at.reverse()
            offsets[sum(n * s for n, s in zip(at, scaled, strict=True))] = [n * c for n, c in zip(at, self.spec.chunk_shape, strict=True)]
        group, _, name = self.wanted.rpartition("/")
        system, path = file_system(f"{self.catalog}/chunks")
        number = pc.field("chunk_id")
        own = (pc.field("name") == name) & (pc.field("group_path") == group) & (number >= min(offsets)) & (number <= max(offsets))
        table = ds.dataset(path, filesystem=system).to_table(columns=["file", "part", "addr", "size", "chunk_id"], filter=own)
        hit = []
        for r in table.to_pylist():
            offset = offsets.pop(r["chunk_id"], None)
            if offset is not None:
                hit.append(("/".join(p for p in (r["file"], r["part"]) if p), r["addr"], r["size"], offset))
        return sorted(hit, key=lambda r: r[:2]) + [(None, None, None, o) for o in offsets.values()]

    def read(self, partition: ChunkRun | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where no chunk is left
            return
        names = [*index_names(len(self.spec.shape)), "value"]
        rows = self.chunk_rows(partition)
        for at in range(0, len(rows), 64):
            part = rows[at : at + 64]
            payloads = read_payloads(*([r[k] for r in part] for k in range(3)))
            for raw, row in zip(payloads, part, strict=True):
                idx, values = chunk_cells(raw, row[3], self.spec, partition.start, partition.count)
                yield pa.RecordBatch.from_arrays([*(pa.array(i) for i in idx), value_array(values, self.spec)], names=names)


class ChunkedArraySource(DataSource):
    """Options: ``catalog`` (folder that holds datasets/ and chunks/), ``dataset`` (path of the array)."""

    @classmethod
    def name(cls) -> str:
        return "chunked_array"

    def _spec(self) -> ArraySpec:
        group, _, name = normal_path(self.options["dataset"]).rpartition("/")
        system, path = file_system(f"{self.options['catalog']}/datasets")
        rows = ds.dataset(path, filesystem=system).to_table(filter=(pc.field("name") == name) & (pc.field("group_path") == group)).to_pylist()
        if len(rows) != 1:
            raise KeyError(f"{len(rows)} datasets named {self.options['dataset']}")
        row = rows[0] | {"attrs": dict(rows[0]["attrs"] or ())}
        return ArraySpec.of(row)

    def schema(self) -> StructType:
        spec = self._spec()
        return StructType([StructField(n, LongType()) for n in index_names(len(spec.shape))] + [StructField("value", spec.dtype.spark)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChunkedArrayReader(self._spec(), self.options["catalog"], normal_path(self.options["dataset"]))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedArraySource)
