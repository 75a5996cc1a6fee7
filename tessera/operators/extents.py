"""Selections along dimensions, resolved to start and count and turned into column predicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extent:
    """Indices from ``start``: up to ``stop`` (exclusive; None: the end), or ``count`` of them."""

    start: int = 0
    stop: int | None = None
    count: int | None = None

    def resolve(self, size: int) -> tuple[int, int]:
        """(start, count) in a dimension of ``size``; bounds are checked by :func:`resolve`."""
        if self.start < 0 or (self.stop or 0) < 0 or (self.count or 0) < 0:
            raise IndexError(f"negative bound in {self}")
        if self.count is not None:
            return self.start, self.count
        return self.start, max(0, (size if self.stop is None else self.stop) - self.start)


FULL = Extent()


class All:
    """Every index of every dimension, whatever the rank."""


ALL = All()


def at(k: int) -> Extent:
    """One index; the dimension stays, with length one."""
    return Extent(k, count=1)


def since(a: int) -> Extent:
    return Extent(a)


def between(a: int, b: int) -> Extent:
    """a <= i < b"""
    return Extent(a, b)


def through(a: int, b: int) -> Extent:
    """a <= i <= b"""
    return Extent(a, b + 1)


def until(b: int) -> Extent:
    return Extent(0, b)


def until_inclusive(b: int) -> Extent:
    return Extent(0, b + 1)


def run(start: int, count: int) -> Extent:
    return Extent(start, count=count)


def as_extent(item: object) -> Extent:
    """From an extent, an int, a range or slice of step one, or a (start, count) pair."""
    if isinstance(item, Extent):
        return item
    if isinstance(item, int) and not isinstance(item, bool):
        return at(item)
    if isinstance(item, (slice, range)):
        if item.step not in (None, 1):
            raise ValueError("strides are not supported")
        return Extent(item.start or 0, item.stop)
    if isinstance(item, tuple) and len(item) == 2 and all(isinstance(x, int) for x in item):
        return run(*item)
    raise TypeError(f"not an extent: {item!r}")


def from_vectors(start: Sequence[int], count: Sequence[int]) -> list[Extent]:
    if len(start) != len(count):
        raise ValueError(f"{len(start)} starts and {len(count)} counts")
    return [run(s, c) for s, c in zip(start, count, strict=True)]


def resolve(extents: object, shape: Sequence[int]) -> tuple[list[int], list[int]]:
    """(start, count) by dimension.

    ``extents`` is ALL, a sequence with an extent for each dimension (in a tuple or list, so that
    ``(1, 2)`` is two indices), or one extent for a one-dimensional array. A rank that differs is an
    error; so is a selection that is not empty and leaves the array.
    """
    if extents is ALL or extents is Ellipsis:
        return [0] * len(shape), list(shape)
    items = list(extents) if isinstance(extents, (tuple, list)) else [extents]
    if len(items) != len(shape):
        raise ValueError(f"{len(items)} extents for {len(shape)} dimensions")
    found = [as_extent(x).resolve(n) for x, n in zip(items, shape, strict=True)]
    start, count = [s for s, _ in found], [c for _, c in found]
    if all(count):
        for j, (s, c, n) in enumerate(zip(start, count, shape, strict=True)):
            if s + c > n:
                raise IndexError(f"[{s}, {s + c}) leaves dimension {j} of size {n}")
    return start, count


def normalize_key(key: object, shape: Sequence[int]) -> tuple[list[int], list[int], list[bool]]:
    """(start, count, squeezed) for Python subscripts: slices clamp, negatives count from the end.

    Missing trailing dimensions are full, an Ellipsis fills the rank, ints drop their dimension.
    """
    items = list(key) if isinstance(key, tuple) else [key]
    if Ellipsis in items:
        k = items.index(Ellipsis)
        items[k : k + 1] = [slice(None)] * (len(shape) - len(items) + 1)
    if len(items) > len(shape):
        raise IndexError(f"{len(items)} subscripts for {len(shape)} dimensions")
    items += [slice(None)] * (len(shape) - len(items))
    start, count, squeezed = [], [], []
    for item, n in zip(items, shape, strict=True):
        if isinstance(item, slice):
            a, b, step = item.indices(n)
            if step != 1:
                raise ValueError("strides are not supported")
            start.append(a)
            count.append(max(0, b - a))
            squeezed.append(False)
        elif isinstance(item, int) and not isinstance(item, bool):
            if not -n <= item < n:
                raise IndexError(f"index {item} leaves a dimension of size {n}")
            start.append(item % n)
            count.append(1)
            squeezed.append(True)
        else:
            raise TypeError(f"not a subscript: {item!r}")
    return start, count, squeezed


def box_predicate(start: Sequence[int], count: Sequence[int], shape: Sequence[int], names: Sequence[str]) -> Column:
    """The selection as a condition on index columns: plain comparisons, which sources can take."""
    if not all(count):
        return F.lit(False)
    met = F.lit(True)
    for s, c, n, name in zip(start, count, shape, names, strict=True):
        i = F.col(name)
        if c == 1:
            met = met & (i == s)
        else:
            met = met & (i >= s) if s else met
            met = met & (i < s + c) if s + c < n else met
    return met


def index_names(rank: int) -> list[str]:
    return [f"i{j}" for j in range(rank)]


def select(cells: DataFrame, extents: object, shape: Sequence[int]) -> DataFrame:
    """Cells (i0, ..., value) within a selection."""
    start, count = resolve(extents, shape)
    return cells.filter(box_predicate(start, count, shape, index_names(len(shape))))


def take(cells: DataFrame, dim: int, indices: DataFrame, index_col: str) -> DataFrame:
    """Outer indexing: cells whose index along ``dim`` is listed in another table."""
    wanted = indices.select(F.col(index_col).cast("long").alias(f"i{dim}")).distinct()
    return cells.join(wanted, f"i{dim}", "left_semi")
