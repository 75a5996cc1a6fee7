"""Metadata of HDF5 files (NetCDF4 among them), read from the published file format, without a library.

Only headers, links, attributes and chunk indexes are read, in pages, through Arrow's file systems; so files may lie
in object stores. Understood are superblocks 0 to 3, both kinds of object headers, groups of all kinds, attributes
inside headers and in heaps, and chunks indexed by either B-tree, a fixed array, or without an index. Extensible
arrays, which only files made for the newest library versions hold, are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

# Signature, pages, and message types of the format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
PAGE = 64 * 1024
DATASPACE, LINK_INFO, DATATYPE, FILL_OLD, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOL_TABLE, ATTRIBUTE_INFO = 1, 2, 3, 4, 5, 6, 8, 11, 12, 16, 17, 21
GZIP, SHUFFLE, CHECKSUM = 1, 2, 3


class Unsupported(ValueError):
    """A structure of the format that this reader does not know."""


@dataclass
class Datatype:
    kind: str  # u, i, f, c (opaque bytes), s (string), v (variable length), r (reference)
    size: int
    order: str  # LE, BE, NA
    base: Datatype | None = None


@dataclass
class Node:
    """A dataset: its messages, read."""

    path: str
    address: int
    dtype: Datatype
    shape: list[int]
    maxshape: list[int | None]
    attrs: dict[str, object] = field(default_factory=dict)
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    chunk_shape: list[int] | None = None
    chunks: list[tuple[int, int, list[int]]] = field(default_factory=list)  # addr, size, offset
    fill: bytes | None = None


def whole(raw: bytes) -> int:
    return int.from_bytes(raw, "little")


def encoded_size(n: int) -> int:
    """Bytes that hold numbers up to ``n``."""
    return max(1, (n.bit_length() + 7) // 8)


class Cursor:
    """Successive fields of a block."""

    def __init__(self, raw: bytes, file: HDF5File, at: int = 0):
        self.raw, self.file, self.at = raw, file, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("a block of the file ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, n: int) -> int:
        return whole(self.take(n))

    def address(self) -> int | None:
        """A file address; None if undefined."""
        n = self.number(self.file.offset_size)
        return None if n == (1 << 8 * self.file.offset_size) - 1 else n + self.file.base

    def length(self) -> int:
        return self.number(self.file.length_size)

    def expect(self, signature: bytes) -> Cursor:
        if self.take(len(signature)) != signature:
            raise ValueError(f"no {signature.decode()} block where one should be")
        return self


class HDF5File:
    """One file, given by a function (address, bytes) -> bytes that may return fewer at the end."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self._read, self._pages = read, {}
        self.offset_size = self.length_size = 8
        self.base = 0
        start = 0
        while self.bytes(start, 8, short=True) != SIGNATURE:
            if len(self.bytes(start, 8, short=True)) < 8:
                raise ValueError("not an HDF5 file")
            start = start * 2 or 512
        c = Cursor(self.bytes(start, 160, short=True), self, 8)
        version = c.number(1)
        if version in (0, 1):
            c.take(4)
            self.offset_size, self.length_size = c.number(1), c.number(1)
            c.take(9 + 4 * version)
            self.base = c.number(self.offset_size)
            c.take(4 * self.offset_size)
        elif version in (2, 3):
            self.offset_size, self.length_size = c.number(1), c.number(1)
            c.take(1)
            self.base = c.number(self.offset_size)
            c.take(2 * self.offset_size)
        else:
            raise Unsupported(f"superblock version {version}")
        self.root = c.address()

    def bytes(self, at: int, n: int, short: bool = False) -> bytes:
        out = b""
        for page in range(at // PAGE, (at + n - 1) // PAGE + 1):
            if page not in self._pages:
                if len(self._pages) > 256:
                    self._pages.clear()
                self._pages[page] = self._read(page * PAGE, PAGE)
            out += self._pages[page]
        out = out[at % PAGE : at % PAGE + n]
        if len(out) < n and not short:
            raise ValueError(f"the file ends before byte {at + n}")
        return out

    def cursor(self, at: int, n: int) -> Cursor:
        return Cursor(self.bytes(at, n, short=True), self)

    # Object headers.

    def messages(self, at: int) -> Iterator[tuple[int, int, bytes]]:
        """(type, flags, body) of an object's messages."""
        if self.bytes(at, 4) == b"OHDR":
            c = self.cursor(at + 4, 64)
            if c.number(1) != 2:
                raise Unsupported("object header version")
            flags = c.number(1)
            c.take((16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0))
            size = c.number(1 << (flags & 3))
            blocks, head = [(at + 4 + c.at, size)], (1, 2, 1, 2 if flags & 4 else 0)
        else:
            c = self.cursor(at, 16)
            if c.number(1) != 1:
                raise Unsupported("object header version")
            c.take(7)
            blocks, head = [(at + 16, c.number(4))], (2, 2, 1, 3)
        while blocks:
            start, size = blocks.pop(0)
            c = self.cursor(start, size)
            while c.at + sum(head) <= size:
                kind, length, flags = (c.number(n) for n in head[:3])
                c.take(head[3])
                if c.at + length > size:
                    break  # a gap at the end of the block
                body = c.take(length)
                if kind == CONTINUATION:
                    more = Cursor(body, self)
                    where, length = more.address(), more.length()
                    blocks.append((where, length) if head[0] == 2 else (where + 4, length - 8))
                elif flags & 2:
                    yield kind, flags, self.shared(kind, body)
                else:
                    yield kind, flags, body

    def shared(self, kind: int, body: bytes) -> bytes:
        """The message that a reference to another object's header stands for."""
        c = Cursor(body, self)
        version, where = c.number(1), c.number(1)
        if version == 3 and where == 1:
            raise Unsupported("messages shared in a heap")
        c.take(6 if version == 1 else 0)
        return next(b for k, _, b in self.messages(c.address()) if k == kind)

    # Groups.

    def links(self, at: int) -> Iterator[tuple[str, int]]:
        """(name, header address) of a group's hard links."""
        for kind, _, body in self.messages(at):
            c = Cursor(body, self)
            if kind == SYMBOL_TABLE:
                tree, heap = c.address(), c.address()
                h = self.cursor(heap, 8 + 3 * 8 + 8).expect(b"HEAP")
                h.take(4)
                size = h.length()
                h.length()
                names = self.bytes(h.address(), size)
                yield from self.symbols(tree, names)
            elif kind == LINK:
                yield from self.link(c)
            elif kind == LINK_INFO:
                c.take(1)
                c.take(8 if c.number(1) & 1 else 0)
                heap, tree = c.address(), c.address()
                if heap is not None and tree is not None:
                    store = FractalHeap(self, heap)
                    for record in self.records(tree):
                        yield from self.link(Cursor(store.get(record[4:]), self))

    def symbols(self, at: int, names: bytes) -> Iterator[tuple[str, int]]:
        c = self.cursor(at, 8 + 2 * self.offset_size).expect(b"TREE")
        c.take(1)
        level, used = c.number(1), c.number(2)
        c = self.cursor(at + 8 + 2 * self.offset_size, used * (self.length_size + self.offset_size))
        for _ in range(used):
            c.length()
            child = c.address()
            if level:
                yield from self.symbols(child, names)
                continue
            n = whole(self.cursor(child, 8).expect(b"SNOD").take(4)[2:])
            s = self.cursor(child + 8, n * (2 * self.offset_size + 24))
            for _ in range(n):
                name = s.number(self.offset_size)
                header, kind = s.address(), s.number(4)
                s.take(20)
                if kind != 2:  # 2: a symbolic link
                    yield names[name : names.index(b"\0", name)].decode(), header

    def link(self, c: Cursor) -> Iterator[tuple[str, int]]:
        c.take(1)
        flags = c.number(1)
        kind = c.number(1) if flags & 8 else 0
        c.take((8 if flags & 4 else 0) + (1 if flags & 16 else 0))
        name = c.take(c.number(1 << (flags & 3))).decode()
        if kind == 0:
            yield name, c.address()

    # Version 2 B-trees.

    def records(self, at: int) -> Iterator[bytes]:
        """All records of a version 2 B-tree."""
        c = self.cursor(at, 64).expect(b"BTHD")
        c.take(2)
        node, size, depth = c.number(4), c.number(2), c.number(2)
        c.take(2)
        root, n = c.address(), c.number(2)
        most = [(node - 10) // size]
        below, counts = [most[0]], [0]  # by level: records in a subtree, bytes that count them
        for _ in range(depth):
            pointer = self.offset_size + encoded_size(most[0]) + counts[-1]
            most.append((node - 10 - pointer) // (size + pointer))
            below.append((most[-1] + 1) * below[-1] + most[-1])
            counts.append(encoded_size(below[-1]))

        def walk(where: int, n: int, level: int) -> Iterator[bytes]:
            c = self.cursor(where, node).expect(b"BTIN" if level else b"BTLF")
            c.take(2)
            found = [c.take(size) for _ in range(n)]
            if not level:
                yield from found
                return
            for k in range(n + 1):
                child, has = c.address(), c.number(encoded_size(most[0]))
                c.take(counts[level - 1])
                yield from walk(child, has, level - 1)
                if k < n:
                    yield found[k]

        if root is not None:
            yield from walk(root, n, depth)

    # Messages of datasets.

    def dataspace(self, body: bytes) -> tuple[list[int], list[int | None]]:
        c = Cursor(body, self)
        version, rank, flags = c.number(1), c.number(1), c.number(1)
        c.take(5 if version == 1 else 1)
        shape = [c.length() for _ in range(rank)]
        most = [c.length() for _ in range(rank)] if flags & 1 else shape
        return shape, [None if m == (1 << 8 * self.length_size) - 1 else m for m in most]

    def datatype(self, body: bytes) -> Datatype:
        kind, bits, size = body[0] & 15, body[1], whole(body[4:8])
        order = "NA" if size == 1 else "BE" if bits & 1 else "LE"
        if kind == 0:
            return Datatype("i" if bits & 8 else "u", size, order)
        if kind == 1:
            return Datatype("f", size, order)
        if kind == 8:  # an enumeration reads as its numbers
            return self.datatype(body[8:])
        if kind == 9:
            return Datatype("v", size, "NA", Datatype("s", 1, "NA") if bits & 15 == 1 else self.datatype(body[8:]))
        return Datatype({3: "s", 7: "r"}.get(kind, "c"), size, "NA")

    def filter_pipeline(self, body: bytes) -> list[tuple[int, list[int]]]:
        c = Cursor(body, self)
        version, n = c.number(1), c.number(1)
        c.take(6 if version == 1 else 0)
        out = []
        for _ in range(n):
            number = c.number(2)
            name = c.number(2) if version == 1 or number >= 256 else 0
            c.take(2)
            values = c.number(2)
            c.take(-(-name // 8) * 8 if version == 1 else name)
            out.append((number, [c.number(4) for _ in range(values)]))
            c.take(4 if version == 1 and values % 2 else 0)
        return out

    def attribute(self, body: bytes) -> tuple[str, object]:
        c = Cursor(body, self)
        version, flags = c.number(1), c.number(1)
        sizes = [c.number(2) for _ in range(3)]
        c.take(1 if version == 3 else 0)
        name, kind, space = (c.take(-(-n // 8) * 8 if version == 1 else n)[:n] for n in sizes)
        if version > 1 and flags & 1:
            kind = self.shared(DATATYPE, kind)
        dtype, shape = self.datatype(kind), self.dataspace(space)[0]
        return name.rstrip(b"\0").decode(), self.values(dtype, shape, c)

    def values(self, dtype: Datatype, shape: list[int], c: Cursor) -> object:
        """An attribute's value: a number, text, list of addresses, or array of these."""
        n = int(np.prod(shape))
        if dtype.kind in "uif":
            found = np.frombuffer(c.take(n * dtype.size), f"{'>' if dtype.order == 'BE' else '<'}{dtype.kind}{dtype.size}")
            return found if shape else found[0]
        out: list[object] = []
        for _ in range(n):
            raw = c.take(dtype.size)
            if dtype.kind == "v":
                f = Cursor(raw, self)
                count, heap, index = f.number(4), f.address(), f.number(4)
                raw = self.global_object(heap, index) if count and heap else b""
                if dtype.base.kind == "r":
                    out.append([whole(raw[k : k + self.offset_size]) + self.base for k in range(0, count * dtype.base.size, dtype.base.size)])
                    continue
                raw = raw[: count * dtype.base.size]
            out.append(whole(raw[: self.offset_size]) + self.base if dtype.kind == "r" else raw.split(b"\0")[0] if dtype.kind in "sv" else raw)
        return out if shape else out[0]

    def global_object(self, at: int, index: int) -> bytes:
        c = self.cursor(at, 8 + self.length_size).expect(b"GCOL")
        c.take(4)
        c = self.cursor(at, c.length())
        c.take(8 + self.length_size)
        while c.at + 8 + self.length_size <= len(c.raw):
            found = c.number(2)
            c.take(6)
            size = c.length()
            if found == index:
                return c.take(size)
            if not found:
                break
            c.take(-(-size // 8) * 8)
        raise ValueError("a value is missing from the file's heap")

    # Storage.

    def layout(self, body: bytes, node: Node) -> None:
        """Where a dataset's chunks are; one chunk of the whole shape if it is contiguous."""
        c = Cursor(body, self)
        version = c.number(1)
        if version < 3:
            rank, kind = c.number(1), c.number(1)
            c.take(5)
            where = c.address() if kind else None
            dims = [c.number(4) for _ in range(rank)]
            if kind == 2:
                node.chunk_shape = dims[: len(node.shape)]
                node.chunks = list(self.tree_chunks(where, len(node.shape))) if where is not None else []
            elif kind == 1 and where is not None:
                node.chunks = [(where, int(np.prod(node.shape)) * node.dtype.size, [0] * len(node.shape))]
            return
        kind = c.number(1)
        if kind == 1:
            where, size = c.address(), c.length()
            node.chunks = [(where, size, [0] * len(node.shape))] if where is not None else []
        elif kind == 2 and version == 3:
            rank, where = c.number(1) - 1, c.address()
            node.chunk_shape = [c.number(4) for _ in range(rank)]
            node.chunks = list(self.tree_chunks(where, rank)) if where is not None else []
        elif kind == 2:
            flags, rank = c.number(1), c.number(1) - 1
            width = c.number(1)
            node.chunk_shape = [c.number(width) for _ in range(rank)]
            c.take(width)
            node.chunks = list(self.indexed_chunks(c, flags, node))
        elif kind:
            raise Unsupported("virtual datasets")

    def tree_chunks(self, at: int, rank: int) -> Iterator[tuple[int, int, list[int]]]:
        """Chunks of a version 1 B-tree."""
        head = 8 + 2 * self.offset_size
        c = self.cursor(at, head).expect(b"TREE")
        c.take(1)
        level, used = c.number(1), c.number(2)
        c = self.cursor(at + head, used * (8 + 8 * (rank + 1) + self.offset_size))
        for _ in range(used):
            size = c.number(4)
            mask = c.number(4)
            offset = [c.number(8) for _ in range(rank + 1)][:rank]
            child = c.address()
            if level:
                yield from self.tree_chunks(child, rank)
            else:
                yield child, self.unmasked(size, mask), offset

    @staticmethod
    def unmasked(size: int, mask: int) -> int:
        if mask:
            raise Unsupported("chunks that skip filters")
        return size

    def indexed_chunks(self, c: Cursor, flags: int, node: Node) -> Iterator[tuple[int, int, list[int]]]:
        rank, kind = len(node.shape), c.number(1)
        plain = int(np.prod(node.chunk_shape)) * node.dtype.size
        grid = [-(-n // m) for n, m in zip(node.shape, node.chunk_shape, strict=True)]
        number = int(np.prod(grid))
        offset = lambda k: [int(p) * m for p, m in zip(np.unravel_index(k, grid), node.chunk_shape, strict=True)]
        if kind == 1:
            size = self.unmasked(c.length(), c.number(4)) if flags & 2 else plain
            where = c.address()
            if where is not None:
                yield where, size, [0] * rank
        elif kind == 2:
            where = c.address()
            if where is not None:
                yield from ((where + k * plain, plain, offset(k)) for k in range(number))
        elif kind == 3:
            c.take(1)
            where = c.address()
            if where is not None:
                for k, (addr, size) in enumerate(self.fixed_array(where, plain)):
                    if addr is not None and k < number:
                        yield addr, size, offset(k)
        elif kind == 5:
            c.take(6)
            where = c.address()
            for record in self.records(where) if where is not None else ():
                r, filtered = Cursor(record, self), bool(node.filters)
                addr = r.address()
                size = self.unmasked(r.number(len(record) - self.offset_size - 4 - 8 * rank), r.number(4)) if filtered else plain
                yield addr, size, [r.number(8) * m for m in node.chunk_shape]
        else:
            raise Unsupported("chunks in an extensible array")

    def fixed_array(self, at: int, plain: int) -> Iterator[tuple[int | None, int]]:
        c = self.cursor(at, 64).expect(b"FAHD")
        c.take(1)
        filtered, size, bits, n = c.number(1), c.number(1), c.number(1), c.length()
        block = c.address()
        if block is None:
            return
        at = block + 6 + self.offset_size
        page = 1 << bits
        if n > page:
            pages = -(-n // page)
            at += -(-pages // 8) + 4
            spans = [(at + k * (page * size + 4), min(page, n - k * page)) for k in range(pages)]
        else:
            spans = [(at, n)]
        for where, many in spans:
            c = self.cursor(where, many * size)
            for _ in range(many):
                addr = c.address()
                yield addr, self.unmasked(c.number(size - self.offset_size - 4), c.number(4)) if filtered else plain

    # The whole file.

    def datasets(self) -> Iterator[Node]:
        """Every dataset, groups first met first; a group that several links lead to is entered once."""
        todo, seen = [("", self.root)], set()
        while todo:
            path, at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            found = list(self.messages(at))
            kinds = {k for k, _, _ in found}
            if LAYOUT in kinds:
                yield self.dataset(path, at, found)
            else:
                todo += [(f"{path}/{name}".lstrip("/"), child) for name, child in sorted(self.links(at))]

    def dataset(self, path: str, at: int, found: list[tuple[int, int, bytes]]) -> Node:
        body = {k: b for k, _, b in found}
        shape, most = self.dataspace(body[DATASPACE])
        node = Node(path, at, self.datatype(body[DATATYPE]), shape, most)
        node.filters = self.filter_pipeline(body[FILTERS]) if FILTERS in body else []
        for kind, _, raw in found:
            if kind == ATTRIBUTE:
                name, value = self.attribute(raw)
                node.attrs[name] = value
            elif kind == ATTRIBUTE_INFO:
                c = Cursor(raw, self)
                c.take(1)
                c.take(2 if c.number(1) & 1 else 0)
                heap, tree = c.address(), c.address()
                if heap is not None and tree is not None:
                    store = FractalHeap(self, heap)
                    for record in self.records(tree):
                        name, value = self.attribute(store.get(record[:8]))
                        node.attrs[name] = value
        if FILL in body:
            node.fill = self.fill_value(body[FILL])
        elif FILL_OLD in body:
            node.fill = body[FILL_OLD][4 : 4 + whole(body[FILL_OLD][:4])]
        self.layout(body[LAYOUT], node)
        return node

    @staticmethod
    def fill_value(body: bytes) -> bytes | None:
        version = body[0]
        at = 2 if version == 3 else 4
        if (version == 3 and not body[1] & 0x20) or (version == 2 and not body[3]):
            return None
        return body[at + 4 : at + 4 + whole(body[at : at + 4])] or None


class FractalHeap:
    """Objects of a fractal heap by identifier."""

    def __init__(self, file: HDF5File, at: int):
        self.file = file
        c = file.cursor(at, 200).expect(b"FRHP")
        c.take(3)
        filters = c.number(2)
        self.checked = bool(c.number(1) & 2)
        managed = c.number(4)
        c.take(file.length_size + file.offset_size + file.length_size + file.offset_size + 8 * file.length_size)
        self.width, self.start, self.most, bits = c.number(2), c.length(), c.length(), c.number(2)
        c.take(2)
        self.root, self.rows = c.address(), c.number(2)
        if filters:
            raise Unsupported("heaps with filters")
        self.offset_bytes = (bits + 7) // 8
        self.length_bytes = min(self.most.bit_length() - 1 + 7 >> 3, (managed.bit_length() - 1) // 8 + 1)
        self.direct_rows = self.most.bit_length() - self.start.bit_length() + 2

    def get(self, identifier: bytes) -> bytes:
        kind = identifier[0] >> 4 & 3
        if kind == 2:
            return identifier[1 : 2 + (identifier[0] & 15)]
        if kind:
            raise Unsupported("huge objects in a heap")
        at = whole(identifier[1 : 1 + self.offset_bytes])
        size = whole(identifier[1 + self.offset_bytes : 1 + self.offset_bytes + self.length_bytes])
        block, inside = self.find(self.root, self.rows, at)
        return self.file.bytes(block + inside, size)

    def find(self, block: int, rows: int, at: int) -> tuple[int, int]:
        """The direct block that holds heap offset ``at``, and where in it."""
        if not rows:
            return block, at
        f = self.file
        head = 5 + f.offset_size + self.offset_bytes
        row, size, first = 0, self.start, 0
        while at >= first + size * self.width:
            first += size * self.width
            row += 1
            size = self.start << max(0, row - 1)
        column = (at - first) // size
        c = f.cursor(block + head + (row * self.width + column) * f.offset_size, f.offset_size)
        child, inside = c.address(), at - first - column * size
        if row < self.direct_rows:
            return child, inside
        inner, total = 0, 0
        while total < size:  # rows of the inner table that make up this size
            total += (self.start << max(0, inner - 1)) * self.width
            inner += 1
        return self.find(child, inner, inside)
