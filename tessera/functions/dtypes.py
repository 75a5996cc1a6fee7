"""Element types of arrays: (kind, bytes) and byte order, with their NumPy and Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

_SPARK = {
    ("u", 1): T.ShortType(), ("u", 2): T.IntegerType(), ("u", 4): T.LongType(), ("u", 8): T.DecimalType(20, 0),
    ("i", 1): T.ByteType(), ("i", 2): T.ShortType(), ("i", 4): T.IntegerType(), ("i", 8): T.LongType(),
    ("f", 4): T.FloatType(), ("f", 8): T.DoubleType(),
}


@dataclass(frozen=True)
class ElementType:
    """``kind`` is u, i, f, or c for opaque bytes; ``order`` is BE, LE or NA (as stored, never swapped)."""

    kind: str
    size: int
    order: str = "LE"

    @classmethod
    def parse(cls, text: str) -> ElementType:
        """From a NumPy-like name: ``<f4``, ``>i2``, ``u1``, ``c8``."""
        order = {"<": "LE", ">": "BE", "|": "NA"}.get(text[0])
        body = text[1:] if order else text
        return cls(body[0], int(body[1:]), order or ("NA" if int(body[1:]) == 1 or body[0] == "c" else "LE"))

    @property
    def numpy(self) -> np.dtype:
        if self.kind == "c":
            return np.dtype(f"V{self.size}")
        return np.dtype(f"{ {'BE': '>', 'LE': '<'}.get(self.order, '=') }{self.kind}{self.size}")

    @property
    def spark(self) -> T.DataType:
        """Unsigned types widen, as Spark has none; 64 bits unsigned is decimal(20, 0)."""
        return T.BinaryType() if self.kind == "c" else _SPARK[self.kind, self.size]

    def native(self, raw: bytes) -> np.ndarray:
        """Values in this machine's byte order. Reading is typed by size alone, so bytes can be reinterpreted."""
        if len(raw) % self.size:
            raise ValueError(f"{len(raw)} bytes do not divide into elements of {self.size}")
        found = np.frombuffer(raw, self.numpy)
        return found if self.kind == "c" else found.astype(self.numpy.newbyteorder("="))
