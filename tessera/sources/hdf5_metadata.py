"""Array metadata of HDF5 and NetCDF4 files.

Only metadata is read here; payloads are read by the chunk readers. Everything after this works from
the catalog tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from tessera.functions.dtypes import ElementType
from tessera.sources.catalog import FILL, UNLIMITED, ArraySpec
from tessera.sources.chunk_files import file_system
from tessera.sources.hdf5_format import CHECKSUM, GZIP, SHUFFLE, HDF5File, Node, Unsupported

#: Attributes by which files link arrays to dimensions; they are read as dimension names.
STRUCTURAL = ("CLASS", "DIMENSION_LIST", "NAME", "REFERENCE_LIST", "_Netcdf4Coordinates", "_Netcdf4Dimid", "_nc3_strict")

EXTENSIONS = (".nc", ".nc4", ".cdf", ".h5", ".hdf5")


def can_open(path: str) -> bool:
    """By its extension."""
    return path.lower().endswith(EXTENSIONS)


def attribute_text(value: object) -> str | None:
    """An attribute as text: one-element arrays are their element, byte strings are decoded, empty ones are null."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)) and len(value) == 1:
        value = value[0]
    if isinstance(value, bytes):
        value = value.decode("utf-8", "replace")
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(str(attribute_text(v)) for v in value) + "]"
    if isinstance(value, str):
        return value.rstrip("\0")
    return str(value) if isinstance(value, (int, float)) else None


def dimension_names(node, leaf: str, file) -> list[str]:
    """Names of an array's dimensions: of the scales attached, its own for a scale, else by place."""
    names = [f"phony_dim_{k}" for k in range(node.ndim)]
    if attribute_text(node.attrs.get("CLASS", "")) == "DIMENSION_SCALE" and node.ndim:
        names[0] = leaf
    for k, refs in enumerate(node.attrs.get("DIMENSION_LIST", ())):
        if len(refs):
            names[k] = file[refs[0]].name.rpartition("/")[2]
    return names


Entry = tuple[str, ArraySpec, list[tuple[int, int, Sequence[int]]]]


def array_metadata(path: str) -> Iterator[Entry]:
    """(file, spec, chunks) of every array of a file; arrays without storage of their own are passed over.

    ``path`` is a local path or the URI of an object. A contiguous array is one chunk. Filters other than deflate
    and byte shuffle are an error. Chunks that were never written are missing from the list: they read as fill
    values. Structures of the file format that are not understood are left to h5py if it is installed, else an error.
    """
    system, inside = file_system(path)
    try:
        with system.open_input_file(inside) as source:
            size = source.size()
            nodes = list(HDF5File(lambda at, n: source.read_at(max(0, min(n, size - at)), at) if at < size else b"").datasets())
    except Unsupported:
        try:
            yield from h5py_metadata(path)
        except ImportError:
            pass
        else:
            return
        raise
    names = {n.address: n.path.rpartition("/")[2] for n in nodes}
    for node in nodes:
        if node.chunks or node.chunk_shape:
            yield path, node_spec(node, names), node.chunks


def node_spec(node: Node, names: dict[int, str]) -> ArraySpec:
    """A dataset's spec; ``names`` are those of datasets by header address."""
    group, _, leaf = node.path.rpartition("/")
    known = [number for number, _ in node.filters]
    if set(known) - {GZIP, SHUFFLE} or known != sorted(known, reverse=True):
        raise ValueError(f"{node.path}: unsupported filters {known}{' (a checksum)' if CHECKSUM in known else ''}")
    level = next((values[0] for number, values in node.filters if number == GZIP), None)
    dims = [f"phony_dim_{k}" for k in range(len(node.shape))]
    if attribute_text(node.attrs.get("CLASS", "")) == "DIMENSION_SCALE" and dims:
        dims[0] = leaf
    for k, scales in enumerate(node.attrs.get("DIMENSION_LIST", ())):
        if scales and scales[0] in names:
            dims[k] = names[scales[0]]
    attrs = {k: t for k, v in node.attrs.items() if k not in STRUCTURAL and (t := attribute_text(v)) is not None}
    kind = node.dtype.kind if node.dtype.kind in "uif" else "c"
    dtype = ElementType(kind, node.dtype.size, "NA" if kind == "c" else node.dtype.order)
    if kind != "c" and node.fill is not None and any(node.fill):
        attrs[FILL] = attribute_text(np.frombuffer(node.fill, dtype.numpy))
    if unlimited := [d for d, most in zip(dims, node.maxshape, strict=True) if most is None]:
        attrs[UNLIMITED] = ",".join(unlimited)
    return ArraySpec(leaf, dtype, node.shape, node.chunk_shape or node.shape, SHUFFLE in known, level, dims, attrs, group)


def h5py_metadata(path: str) -> Iterator[Entry]:
    """The same through h5py, where it is installed; local files only."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 metadata needs h5py; write the catalog tables by other means") from e
    found: list = []

    def visit(name: str, node) -> None:
        if not isinstance(node, h5py.Dataset):
            return
        order = {"<": "LE", ">": "BE"}.get(node.dtype.byteorder, "LE" if node.dtype.itemsize > 1 else "NA")
        kind = node.dtype.kind if node.dtype.kind in "uif" else "c"
        unknown = set(node._filters) - {"gzip", "shuffle"}
        if unknown:
            raise ValueError(f"{name}: unsupported filters {sorted(unknown)}")
        if node.chunks:
            info = [node.id.get_chunk_info(k) for k in range(node.id.get_num_chunks())]
            chunks = [(c.byte_offset, c.size, list(c.chunk_offset)) for c in info]
        elif node.id.get_offset() is not None:
            chunks = [(node.id.get_offset(), node.nbytes, [0] * node.ndim)]
        else:
            return
        group, _, leaf = name.rpartition("/")
        attrs = {k: t for k, v in node.attrs.items() if k not in STRUCTURAL and (t := attribute_text(v)) is not None}
        dims = dimension_names(node, leaf, f)
        if kind != "c" and node.fillvalue != 0:
            attrs[FILL] = attribute_text(node.fillvalue)
        if unlimited := [d for d, most in zip(dims, node.maxshape, strict=True) if most is None]:
            attrs[UNLIMITED] = ",".join(unlimited)
        spec = ArraySpec(
            leaf, ElementType(kind, node.dtype.itemsize, order), node.shape, node.chunks or node.shape, bool(node.shuffle), node.compression_opts if node.compression == "gzip" else None, dims, attrs, group
        )
        found.append((path, spec, chunks))

    with h5py.File(path, "r") as f:
        f.visititems(visit)
    yield from found
