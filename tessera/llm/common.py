"""What the training-data operators share: column helpers for Arrow batches, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.scratch import map_batches, materialize, release

__all__ = ["id_remainder", "map_batches", "materialize", "read_table", "release", "replace_columns", "replaced_schema", "sample_ids", "slices", "words_column"]

#: Documents handed to a Python operator at a time: bounds a worker's memory when texts are long.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches again, cut into zero-copy slices of ``rows`` rows at most; freed memory is given back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def replaced_schema(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """``df``'s columns, without those named like ``fields``, then ``fields``."""
    names = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + fields)


def replace_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The Arrow counterpart of :func:`replaced_schema`."""
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in columns]
    pairs = kept + list(columns.items())
    return pa.RecordBatch.from_arrays([a for _, a in pairs], names=[n for n, _ in pairs])


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sample_ids(rows: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` distinct ids of each class: those that hash lowest, as (id, class).

    ``rows`` has id (not null) and class (not null); rows that repeat an id and class count once. A hash
    threshold thins each class to about twice the bound before anything is gathered; it is widened where
    repeats left a class with fewer ids than the bound while more are to be had. So some ``2 * bound`` ids a
    class reach the driver, and no task ranks a class. The tables of classes have one row for each class.
    """
    spark, kinds = rows.sparkSession, (rows.schema["id"], rows.schema["class"])
    key = F.xxhash64(F.col("id").cast("string"))
    counts = rows.groupBy("class").agg(F.count("*").alias("n")).collect()
    share = {r["class"]: min(1.0, 2.0 * bound / r["n"]) for r in counts}
    chosen: list[tuple] = []
    while share:
        limits = spark.createDataFrame(list(share.items()), T.StructType([kinds[1], T.StructField("share", T.DoubleType())]))
        thin = rows.join(F.broadcast(limits), "class").filter(key.cast("double") <= (F.col("share") * 2.0 - 1.0) * 2.0**63)
        found: dict = {c: [] for c in share}
        for r in thin.select("class", "id", key.alias("key")).distinct().collect():
            found[r["class"]].append((r["key"], r["id"]))
        for c, ids in found.items():
            if len(ids) >= bound or share[c] >= 1.0:
                chosen += [(i, c) for _, i in sorted(ids)[:bound]]
                del share[c]
            else:
                share[c] = min(1.0, share[c] * min(16.0, max(2.0, 2.0 * bound / max(1, len(ids)))))
    return spark.createDataFrame(chosen, T.StructType(list(kinds)))


def words_column(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
