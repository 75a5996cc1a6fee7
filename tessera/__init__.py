"""tessera: chunked n-dimensional array analytics on Spark DataFrames."""

from tessera.api import Dataset, Index, open_mfdataset
from tessera.functions.dtypes import ElementType
from tessera.operators.extents import ALL, FULL, Extent, at, between, from_vectors, run, since, through, until, until_inclusive
from tessera.sources.catalog import ArraySpec, Catalog

__all__ = [
    "ALL", "FULL", "ArraySpec", "Catalog", "Dataset", "ElementType", "Extent", "Index", "at", "between", "from_vectors", "open_mfdataset", "run", "since",
    "through", "until", "until_inclusive",
]
