"""Reading and writing chunk payload files.

A payload file holds encoded chunks one after another; the catalog has their addresses. Executors
open it by URI through Arrow's file systems (local, s3, hdfs), so it must be where all can reach it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.codec import decode_chunk, encode_chunk
from tessera.operators.extents import index_names, resolve
from tessera.operators.grid import chunk_grid, chunk_ordinal, place_in_chunk
from tessera.plans.requests import MAX_GAP, MAX_SPAN
from tessera.plans.segments import by_chunk, segments
from tessera.scratch import map_batches, materialize
from tessera.sources.catalog import DATASETS, ArraySpec, Catalog


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def open_file(uri: str) -> pa.NativeFile:
    system, path = file_system(uri)
    return system.open_input_file(path)


def element_values(column: pa.Array, spec: ArraySpec) -> np.ndarray:
    """A value column in the array's element type."""
    wide = spec.dtype.spark == T.DecimalType(20, 0)  # 64 bits unsigned come as decimals
    values = np.array([int(v) for v in column.to_pylist()], np.uint64) if wide else column.to_numpy(zero_copy_only=False)
    return values.astype(spec.dtype.numpy)


def write_array(cells: DataFrame, spec: ArraySpec, folder: str, fill: object = 0) -> Catalog:
    """Write cells (i0, ..., value) as chunks; returns the catalog.

    One task per group of chunks writes one payload file, named by what it holds; an attempt writes to a name of
    its own first, so attempts that run at the same time do not meet. Two cells at one place are an error. Edge
    chunks are stored whole, padded with ``fill``.
    """
    rank, dtype = len(spec.shape), spec.dtype
    idx = [F.col(n) for n in index_names(rank)]
    keyed = cells.select(chunk_ordinal(idx, spec.shape, spec.chunk_shape).alias("chunk_id"), place_in_chunk(idx, spec.chunk_shape).alias("place"), "value")
    size, name = math.prod(spec.chunk_shape), f"{spec.group_path}/{spec.name}".strip("/").replace("/", ".")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, filled, out, addr = -1, None, None, None, 0
        system, final, attempt = None, "", ""
        rows: list[tuple[str, int, int, int]] = []

        def close() -> None:
            nonlocal out, addr, system, final, attempt
            part = rows[0][0] if rows else f"{name}-{current}.chunks"
            if out is None:
                system, final = file_system(f"{folder}/{part}")
                attempt = f"{final}.{uuid.uuid4().hex}"
                system.create_dir(final.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(attempt)
            raw = encode_chunk(block.tobytes(), dtype.size, spec.gzip, spec.shuffle)
            out.write(raw)
            rows.append((part, current, addr, len(raw)))
            addr += len(raw)

        for batch in batches:
            ids, place, values = batch.column("chunk_id").to_numpy(), batch.column("place").to_numpy(), element_values(batch.column("value"), spec)
            for k in np.unique(ids).tolist():  # sorted within the partition: chunks come one after another
                if k != current:
                    if block is not None:
                        close()
                    current, block, filled = k, np.full(size, fill, dtype.numpy), np.zeros(size, bool)
                at = place[ids == k]
                if filled[at].any() or len(np.unique(at)) < len(at):
                    raise ValueError(f"two cells at one place of chunk {k}")
                filled[at] = True
                block[at] = values[ids == k]
        if block is None:
            return
        close()
        out.close()
        system.move(attempt, final)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "chunk_id", "addr", "size"])

    dealt = keyed.repartition("chunk_id").sortWithinPartitions("chunk_id")
    found = map_batches(dealt, encode, "part string, chunk_id long, addr long, size long")
    found = materialize(found, "chunks")
    spark = cells.sparkSession
    grid = chunk_grid(spark, spec.shape, spec.chunk_shape).select("chunk_id", "offset")
    chunks = found.join(grid, "chunk_id").select(
        F.lit(folder).alias("file"), "part", F.lit(spec.group_path).alias("group_path"), F.lit(spec.name).alias("name"), "chunk_id", "addr", "size", "offset"
    )
    datasets = spark.createDataFrame([spec.row(folder)], DATASETS)
    return Catalog(datasets, chunks)


def ranged_reads(reads: list[tuple[int, int, int]], max_gap: int = MAX_GAP, max_span: int = MAX_SPAN) -> list[list[tuple[int, int, int]]]:
    """(addr, size, position) reads of one file, grouped to requests over small gaps."""
    out: list[list[tuple[int, int, int]]] = []
    start = end = 0
    for read in sorted(reads):
        if out and read[0] - end <= max_gap and read[0] + read[1] - start <= max_span:
            out[-1].append(read)
        else:
            out.append([read])
            start = read[0]
        end = max(end, read[0] + read[1]) if len(out[-1]) > 1 else read[0] + read[1]
    return out


#: Requests of a task that are under way at the same time.
REQUESTS_IN_FLIGHT = 16


def read_payloads(files: list[str | None], addrs: list[int | None], sizes: list[int | None]) -> list[bytes | None]:
    """Stored bytes of chunks; None for those without a file.

    Neighbouring chunks are fetched by one request, and several requests run at once, which hides the latency of
    object stores. A file that ends early is an error.
    """
    out: list[bytes | None] = [None] * len(files)

    def fetch(source: pa.NativeFile, uri: str, group: list[tuple[int, int, int]]) -> None:
        start, end = group[0][0], max(a + s for a, s, _ in group)
        raw = source.read_at(end - start, start)
        if len(raw) < end - start:
            raise ValueError(f"{uri} ends before byte {end}")
        for addr, size, k in group:
            out[k] = raw[addr - start : addr - start + size]

    for uri in sorted({f for f in files if f is not None}):
        groups = ranged_reads([(addrs[k], sizes[k], k) for k, f in enumerate(files) if f == uri])
        with open_file(uri) as source:
            if len(groups) == 1:
                fetch(source, uri, groups[0])
            else:
                with ThreadPoolExecutor(REQUESTS_IN_FLIGHT) as pool:
                    list(pool.map(lambda g, s=source, u=uri: fetch(s, u, g), groups))
    return out


def plain_chunk(raw: bytes | None, spec: ArraySpec) -> bytes:
    """Decoded bytes of a chunk; fill values if it was never written."""
    if raw is None:
        return spec.fill * math.prod(spec.chunk_shape)
    return decode_chunk(raw, spec.chunk_bytes, spec.dtype.size, spec.gzip, spec.shuffle)


def chunk_cells(raw: bytes | None, offset: list[int], spec: ArraySpec, start: list[int], count: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Indices and values of a chunk's cells within a selection, edge padding left out."""
    values = spec.dtype.native(plain_chunk(raw, spec)).reshape(tuple(spec.chunk_shape))
    low = [max(s - o, 0) for s, o in zip(start, offset, strict=True)]
    high = [min(s + n, o + c, m) - o for s, n, o, c, m in zip(start, count, offset, spec.chunk_shape, spec.shape, strict=True)]
    box = values[tuple(slice(a, b) for a, b in zip(low, high, strict=True))]
    axes = [np.arange(o + a, o + b) for o, a, b in zip(offset, low, high, strict=True)]
    mesh = np.meshgrid(*axes, indexing="ij") if axes else []
    return [m.ravel() for m in mesh], box.ravel()


def value_array(values: np.ndarray, spec: ArraySpec) -> pa.Array:
    if spec.dtype.kind == "c":
        return pa.array([v.tobytes() for v in values], pa.binary())
    if spec.dtype.spark == T.DecimalType(20, 0):
        return pa.array(values, pa.uint64()).cast(pa.decimal128(20, 0))
    wide = {"smallint": np.int16, "int": np.int32, "bigint": np.int64}.get(spec.dtype.spark.simpleString())
    return pa.array(values.astype(wide) if spec.dtype.kind == "u" and wide else values)


def payload_uri() -> Column:
    """Where a chunk row's bytes are."""
    return F.concat_ws("/", "file", "part").alias("file")


def due_chunks(catalog: Catalog, spec: ArraySpec, start: list[int], count: list[int]) -> DataFrame:
    """Chunks (chunk_id, offset, file, addr, size) that a selection touches; no file for those never written.

    The chunk table is pruned first, by comparisons on offsets.
    """
    chunks = catalog.chunks.filter((F.col("name") == spec.name) & (F.col("group_path") == spec.group_path))
    for j, (s, n, c) in enumerate(zip(start, count, spec.chunk_shape, strict=True)):
        chunks = chunks.filter((F.col("offset")[j] > s - c) & (F.col("offset")[j] < s + n) if all(count) else F.lit(False))
    due = chunk_grid(catalog.chunks.sparkSession, spec.shape, spec.chunk_shape, start, count).select("chunk_id", "offset")
    return due.join(chunks.select("chunk_id", payload_uri(), "addr", "size"), "chunk_id", "left")


def read_array(catalog: Catalog, path: str, extents: object = ..., group: str | None = None) -> DataFrame:
    """Cells (i0, ..., value) of a selection.

    The selection prunes the chunk table first, by comparisons on offsets; each remaining chunk is read
    and decoded once, in order of address within a task, and only selected cells leave Python. Chunks that
    were never written give fill values.
    """
    _, spec = catalog.spec(path, group)
    start, count = resolve(extents, spec.shape)
    names = index_names(len(spec.shape))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names] + [T.StructField("value", spec.dtype.spark)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                payloads = read_payloads(*(part.column(n).to_pylist() for n in ("file", "addr", "size")))
                for raw, offset in zip(payloads, part.column("offset").to_pylist(), strict=True):
                    idx, values = chunk_cells(raw, offset, spec, start, count)
                    yield pa.RecordBatch.from_arrays([*(pa.array(i) for i in idx), value_array(values, spec)], names=[*names, "value"])

    keys = ["file", "addr", "chunk_id"]  # by chunk_id, those without a file are spread too
    ordered = due_chunks(catalog, spec, start, count).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = ordered.select("file", "addr", "size", "offset")
    return map_batches(ordered, decode, schema)


def read_segments(catalog: Catalog, path: str, extents: object = ..., group: str | None = None) -> DataFrame:
    """Decoded bytes by segment: (dst_offset, payload), in the array's own byte order.

    Each chunk is decoded once for all its segments. Ordered by dst_offset, the payloads are the
    selection in row-major order; chunks that were never written give fill values.
    """
    _, spec = catalog.spec(path, group)
    start, count = resolve(extents, spec.shape)
    due = due_chunks(catalog, spec, start, count)
    planned = by_chunk(segments(catalog.chunks.sparkSession, start, count, spec.shape, spec.chunk_shape), due)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = read_payloads(*(batch.column(n).to_pylist() for n in ("file", "addr", "size")))
            dst, out = [], []
            for raw, runs in zip(payloads, batch.column("segments").to_pylist(), strict=True):
                plain = plain_chunk(raw, spec)
                for r in runs:
                    dst.append(r["dst_offset"])
                    out.append(plain[r["src_start"] * spec.dtype.size : r["src_end"] * spec.dtype.size])
            yield pa.RecordBatch.from_arrays([pa.array(dst, pa.int64()), pa.array(out, pa.binary())], names=["dst_offset", "payload"])

    return map_batches(planned.select("file", "addr", "size", "segments"), decode, "dst_offset long, payload binary")

