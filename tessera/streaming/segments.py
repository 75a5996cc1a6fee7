"""Ordered streams of a selection: decoded segments in row-major order, pulled as they are needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tessera.functions.codec import map_payload, xdr
from tessera.sources.catalog import Catalog
from tessera.sources.chunk_files import read_segments


def stream_bytes(catalog: Catalog, path: str, extents: object = ..., group: str | None = None) -> Iterator[bytes]:
    """Payloads of the segments, in the array's byte order. One partition at a time reaches the driver,
    the next being computed meanwhile."""
    ordered = read_segments(catalog, path, extents, group).orderBy("dst_offset")
    for row in ordered.toLocalIterator(prefetchPartitions=True):
        yield bytes(row["payload"])


def stream_values(catalog: Catalog, path: str, extents: object = ..., group: str | None = None) -> Iterator[np.ndarray]:
    """Values of the segments, in this machine's byte order."""
    _, spec = catalog.spec(path, group)
    for raw in stream_bytes(catalog, path, extents, group):
        yield spec.dtype.native(raw)


def xdr_segments(catalog: Catalog, path: str, extents: object = ..., group: str | None = None) -> DataFrame:
    """(dst_offset, payload) by segment, in XDR: big-endian, integers under four bytes widened. Executors widen."""
    _, spec = catalog.spec(path, group)
    return map_payload(read_segments(catalog, path, extents, group), "payload", lambda raw: xdr(raw, spec.dtype))


def stream_xdr(catalog: Catalog, path: str, extents: object = ..., group: str | None = None) -> Iterator[bytes]:
    """Payloads of :func:`xdr_segments` in order."""
    for row in xdr_segments(catalog, path, extents, group).orderBy("dst_offset").toLocalIterator(prefetchPartitions=True):
        yield bytes(row["payload"])
