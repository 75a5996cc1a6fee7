"""Reading HDF5 metadata from bytes: files are written here block by block, as the published format says."""

import struct

import numpy as np
import pytest

import tessera
from tessera import cli
from tessera.functions.codec import encode_chunk
from tessera.sources.catalog import FILL, Catalog
from tessera.sources.hdf5_format import HDF5File, Unsupported
from tessera.sources.hdf5_metadata import array_metadata

UNDEFINED = (1 << 64) - 1


def pad(raw, to=8):
    return raw + bytes(-len(raw) % to)


class Writer:
    def __init__(self):
        self.raw = bytearray(2048)

    def put(self, block):
        at = len(self.raw)
        self.raw += pad(block)
        return at


def space(shape, most=None):
    return struct.pack("<BBB5x", 1, len(shape), most is not None) + b"".join(struct.pack("<Q", n) for n in [*shape, *(most or [])])


def dtype(text):
    t = np.dtype(text)
    big = text[0] == ">"
    if t.kind == "f":
        return bytes([0x11, 0x20 | big, 31, 0]) + struct.pack("<I", t.itemsize) + bytes(12)
    return bytes([0x10, (8 if t.kind == "i" else 0) | big, 0, 0]) + struct.pack("<IHH", t.itemsize, 0, 8 * t.itemsize)


def string(n):
    return bytes([0x13, 0, 0, 0]) + struct.pack("<I", n)


REFERENCE = bytes([0x17, 0, 0, 0]) + struct.pack("<I", 8)
REFERENCE_LISTS = bytes([0x19, 0, 0, 0]) + struct.pack("<I", 16) + REFERENCE


def attribute(name, kind, shape, data, version=1):
    key = name.encode() + b"\0"
    if version == 1:
        return struct.pack("<BxHHH", 1, len(key), len(kind), len(space(shape))) + pad(key) + pad(kind) + pad(space(shape)) + data
    return struct.pack("<BBHHHB", 3, 0, len(key), len(kind), len(space(shape)), 0) + key + kind + space(shape) + data


def text_attribute(name, text, version=1):
    return attribute(name, string(len(text)), [], text.encode(), version)


def chunk_tree(w, chunks, rank, width):
    body = b"TREE" + struct.pack("<BBHQQ", 1, 0, len(chunks), UNDEFINED, UNDEFINED)
    for addr, size, offset in chunks:
        body += struct.pack("<II", size, 0) + b"".join(struct.pack("<Q", o) for o in [*offset, 0]) + struct.pack("<Q", addr)
    return w.put(body + bytes(8 + 8 * (rank + 1)))


def chunked_layout(tree, chunk, width):
    return struct.pack("<BBBQ", 3, 2, len(chunk) + 1, tree) + b"".join(struct.pack("<I", n) for n in [*chunk, width])


def filters(*found):
    out = struct.pack("<BB6x", 1, len(found))
    for number, values in found:
        out += struct.pack("<HHHH", number, 0, 1, len(values)) + b"".join(struct.pack("<I", v) for v in values) + bytes(4 * (len(values) % 2))
    return out


def old_header(messages, continued=None):
    """Version 1; with ``continued`` the last message lies in a block of its own."""
    body = b"".join(struct.pack("<HHB3x", k, len(pad(m)), 0) + pad(m) for k, m in messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body


def new_header(messages):
    body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
    return b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + bytes(4)


def old_group(w, entries):
    names, offsets = bytearray(8), []
    for name, _ in entries:
        offsets.append(len(names))
        names += pad(name.encode() + b"\0")
    data = w.put(bytes(names))
    heap = w.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, data))
    symbols = w.put(b"SNOD" + struct.pack("<BxH", 1, len(entries)) + b"".join(struct.pack("<QQII16x", o, at, 0, 0) for o, (_, at) in zip(offsets, entries, strict=True)))
    tree = w.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, UNDEFINED, UNDEFINED) + struct.pack("<QQQ", 0, symbols, offsets[-1]))
    return w.put(old_header([(17, struct.pack("<QQ", tree, heap))]))


def chunks_of(w, values, chunk, gzip=None, shuffled=False):
    """Encoded chunks, edges padded; one is left out if all of it is -9."""
    out = []
    for offset in np.ndindex(*[-(-n // c) for n, c in zip(values.shape, chunk, strict=True)]):
        at = [o * c for o, c in zip(offset, chunk, strict=True)]
        block = np.zeros(chunk, values.dtype)
        part = values[tuple(slice(a, a + c) for a, c in zip(at, chunk, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = encode_chunk(block.tobytes(), values.dtype.itemsize, gzip, shuffled)
        if not (part == -9).all():
            out.append((w.put(raw), len(raw), at))
    return out


def old_file(path):
    w = Writer()
    time, sst = np.array([0.0, 6.0, 12.0]), np.arange(15, dtype="<i2").reshape(3, 5)
    sst[2:, 4:] = -9
    raw = w.put(np.array([10, 20, 30, 40, 50], ">f4").tobytes())
    lat = w.put(old_header([(1, space([5])), (3, dtype(">f4")), (8, struct.pack("<BBQQ", 3, 1, raw, 20)), (12, text_attribute("CLASS", "DIMENSION_SCALE"))]))
    found = chunks_of(w, time, [2])
    more = old_header([(12, text_attribute("units", "hours since 2000-01-01")), (0, bytes(8))])[16:]
    rest = w.put(more)
    head = [(1, space([3], [UNDEFINED])), (3, dtype("<f8")), (8, chunked_layout(chunk_tree(w, found, 1, 8), [2], 8)), (12, text_attribute("CLASS", "DIMENSION_SCALE")), (16, struct.pack("<QQ", rest, len(more)))]
    time_at = w.put(old_header(head))
    heap = w.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + 2 * 24) + b"".join(struct.pack("<HH4xQQ", k + 1, 1, 8, at) for k, at in enumerate((time_at, lat))))
    lists = b"".join(struct.pack("<IQI", 1, heap, k + 1) for k in range(2))
    tree = chunk_tree(w, chunks_of(w, sst, [2, 2], 4, True), 2, 2)
    sst_at = w.put(old_header([
        (1, space([3, 5], [UNDEFINED, 5])), (3, dtype("<i2")), (5, struct.pack("<BBBBI", 2, 2, 0, 1, 2) + struct.pack("<h", -9)), (11, filters((2, [2]), (1, [4]))), (8, chunked_layout(tree, [2, 2], 2)),
        (12, attribute("DIMENSION_LIST", REFERENCE_LISTS, [2], lists)), (12, attribute("_FillValue", dtype("<i2"), [1], struct.pack("<h", -9))), (12, attribute("scale", dtype(">f8"), [], struct.pack(">d", 0.5))),
    ]))
    empty = w.put(old_header([(1, space([4])), (3, dtype("<f8")), (8, struct.pack("<BBQQ", 3, 1, UNDEFINED, 0))]))
    root = old_group(w, [("empty", empty), ("g", old_group(w, [("sst", sst_at)])), ("lat", lat), ("time", time_at)])
    top = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, UNDEFINED, len(w.raw), UNDEFINED) + struct.pack("<QQII16x", 0, root, 0, 0)
    w.raw[: len(top)] = top
    path.write_bytes(w.raw)
    return time, sst


def test_a_file_of_the_old_format(spark, tmp_path, capsys):
    path = tmp_path / "old.nc"
    time, sst = old_file(path)
    found = {(s.group_path, s.name): (s, c) for _, s, c in array_metadata(str(path))}
    assert found.keys() == {("", "time"), ("", "lat"), ("g", "sst")}
    spec, chunks = found["g", "sst"]
    assert (spec.dims, spec.unlimited_dims, spec.gzip, spec.shuffle, list(spec.chunk_shape), len(chunks)) == (["time", "lat"], ["time"], 4, True, [2, 2], 5)
    assert spec.attrs == {"_FillValue": "-9", "scale": "0.5", FILL: "-9", "_UnlimitedDims": "time"}
    assert found["", "time"][0].attrs == {"units": "hours since 2000-01-01", "_UnlimitedDims": "time"}
    index = tessera.Index(Catalog.build(spark, array_metadata(str(path))))
    assert np.array_equal(index["g/sst"][...], sst) and index["lat"][...].tolist() == [10, 20, 30, 40, 50] and np.array_equal(index["time"][...], time)
    folder = str(tmp_path / "catalog")
    assert cli.main(["index", str(path), folder]) == 0 and cli.main(["list", folder]) == 0 and cli.main(["list"]) == 2
    assert Catalog.read(spark, folder).chunks.count() == 5 + 2 + 1
    assert sorted(capsys.readouterr().out.split("\n"))[1:] == [f"{path} {n}" for n in ("/g/sst [3, 5]", "/lat [5]", "/time [3]")]


def heap_and_tree(w, objects, record, offset_first):
    """A fractal heap of one direct block, and a version 2 B-tree of its objects with a root above two leaves."""
    block, ids = bytearray(5 + 8 + 4), []
    for raw in objects:
        ids.append(bytes([0]) + struct.pack("<I", len(block)) + struct.pack("<H", len(raw)))
        block += raw
    size = 4096
    direct = w.put(b"FHDB" + bytes(13) + bytes(block[17:]) + bytes(size - len(block)))
    head = b"FRHP" + struct.pack("<BHHBI", 0, 7 if not offset_first else 8, 0, 0, size) + struct.pack("<QQQQ", 0, UNDEFINED, 0, UNDEFINED) + bytes(64)
    heap = w.put(head + struct.pack("<HQQHHQH", 4, size, 65536, 32, 1, direct, 0) + bytes(4))
    records = [record(i) for i in ids]
    width, node = len(records[0]), 512
    leaves = [records[: len(records) // 2], records[len(records) // 2 + 1 :]]
    at = [w.put(b"BTLF" + bytes([0, 5]) + b"".join(part) + bytes(node - 6 - width * len(part))) for part in leaves]
    most = (node - 10) // width
    count = lambda n: struct.pack("<B", n) if most < 256 else struct.pack("<H", n)
    root = w.put(b"BTIN" + bytes([0, 5]) + records[len(records) // 2] + b"".join(struct.pack("<Q", a) + count(len(p)) for a, p in zip(at, leaves, strict=True)) + bytes(node))
    tree = w.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, 5, node, width, 1, 98, 40, root, 1, len(records)) + bytes(4))
    return heap, tree


def link(name, at):
    return struct.pack("<BBB", 1, 0, len(name)) + name.encode() + struct.pack("<Q", at)


def test_a_file_of_the_new_format(tmp_path):
    """Links in a message and in a heap, attributes in a heap, each kind of chunk index."""
    w = Writer()
    layouts = {
        "one": (struct.pack("<BBBBBBBB", 4, 2, 0, 2, 1, 4, 8, 1) + struct.pack("<Q", 100), [(100, 32, [0])]),
        "one_filtered": (struct.pack("<BBBBBBBB", 4, 2, 2, 2, 1, 4, 8, 1) + struct.pack("<QIQ", 20, 0, 100), [(100, 20, [0])]),
        "implicit": (struct.pack("<BBBBBBBB", 4, 2, 0, 2, 1, 2, 8, 2) + struct.pack("<Q", 300), [(300, 16, [0]), (316, 16, [2])]),
    }
    elements = b"".join(struct.pack("<QHI", a, s, 0) for a, s in ((500, 11), (UNDEFINED, 0)))
    block = w.put(b"FADB" + bytes([0, 1]) + struct.pack("<Q", 0) + elements + bytes(4))
    fixed = w.put(b"FAHD" + struct.pack("<BBBBQQ", 0, 1, 14, 10, 2, block) + bytes(4))
    layouts["fixed"] = (struct.pack("<BBBBBBBB", 4, 2, 0, 2, 1, 2, 8, 3) + struct.pack("<BQ", 10, fixed), [(500, 11, [0])])
    pages = w.put(b"FADB" + bytes([0, 0]) + struct.pack("<Q", 0) + b"\xc0" + bytes(4) + struct.pack("<QQ", 600, 700) + bytes(4) + struct.pack("<Q", 800) + bytes(4))
    paged = w.put(b"FAHD" + struct.pack("<BBBBQQ", 0, 0, 8, 1, 3, pages) + bytes(4))
    layouts["paged"] = (struct.pack("<BBBBBBBB", 4, 2, 0, 2, 1, 2, 8, 3) + struct.pack("<BQ", 1, paged), [(600, 16, [0]), (700, 16, [2]), (800, 16, [4])])
    leaf = w.put(b"BTLF" + bytes([0, 10]) + struct.pack("<QQQQ", 900, 0, 950, 1) + bytes(500))
    tree = w.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, 10, 512, 16, 0, 98, 40, leaf, 2, 2) + bytes(4))
    layouts["tree"] = (struct.pack("<BBBBBBBB", 4, 2, 0, 2, 1, 2, 8, 5) + struct.pack("<IBBQ", 512, 98, 40, tree), [(900, 16, [0]), (950, 16, [2])])
    heads = {}
    for name, (layout, _) in layouts.items():
        messages = [(1, struct.pack("<BBBB", 2, 1, 0, 1) + struct.pack("<Q", 6 if name == "paged" else 4)), (3, dtype("<f8")), (8, layout)]
        if "filtered" in name or name == "fixed":
            messages.append((11, struct.pack("<BB", 2, 1) + struct.pack("<HHHI", 1, 0, 1, 6)))
        if name == "one":
            named = [text_attribute(f"a{k}", f"value {k}", 3) for k in range(12)]
            heap, names = heap_and_tree(w, named, lambda i: i + bytes(1 + 1 + 4 + 4), True)
            messages.append((21, struct.pack("<BBQQ", 0, 0, heap, names)))
        heads[name] = w.put(new_header(messages))
    heap, names = heap_and_tree(w, [link(n, at) for n, at in heads.items()], lambda i: bytes(4) + i, False)
    dense = w.put(new_header([(2, struct.pack("<BBQQ", 0, 0, heap, names))]))
    root = w.put(new_header([(2, struct.pack("<BBQQ", 0, 0, UNDEFINED, UNDEFINED)), (6, link("dense", dense)), (6, link("again", dense))]))
    top = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", 0, UNDEFINED, len(w.raw), root) + bytes(4)
    w.raw[512 : 512 + len(top)] = top  # after a user block
    raw = bytes(w.raw)
    found = {n.path.rpartition("/")[2]: n for n in HDF5File(lambda at, n: raw[at : at + n]).datasets()}
    assert {n: node.chunks for n, node in found.items()} == {n: chunks for n, (_, chunks) in layouts.items()}
    assert found["one"].attrs == {f"a{k}": f"value {k}".encode() for k in range(12) if True}
    path = tmp_path / "new.h5"
    path.write_bytes(raw)
    assert {s.name: s.gzip for _, s, _ in array_metadata(str(path))} == {n: 6 if "filtered" in n or n == "fixed" else None for n in layouts}


def test_what_is_not_understood_is_an_error(tmp_path):
    with pytest.raises(ValueError, match="not an HDF5"):
        HDF5File(lambda at, n: bytes(5000)[at : at + n])
    w = Writer()
    layout = struct.pack("<BBBBBBBB", 4, 2, 0, 2, 1, 2, 8, 4) + bytes(20)
    data = w.put(new_header([(1, struct.pack("<BBBBQ", 2, 1, 0, 1, 4)), (3, dtype("<f8")), (8, layout)]))
    root = w.put(new_header([(6, link("x", data))]))
    w.raw[:48] = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", 0, UNDEFINED, len(w.raw), root) + bytes(4)
    path = tmp_path / "new.h5"
    path.write_bytes(w.raw)
    with pytest.raises(Unsupported, match="extensible"):
        list(array_metadata(str(path)))
