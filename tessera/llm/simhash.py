"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits, each read as a word of the
perfect binary Golay code of length 23. Decoding maps a segment to the index of the one codeword
within three bits; decoding all words within one bit of a segment gives its fuzzy keys, six at most.

Pigeonhole of three errors over three segments. Either some segment has none; then of the other two one has
at most one: the key is the exact segment with the Golay index of the other, 33 or 34 bits. Or each
segment has just one error; then one half of each is exact, and the parities of all three differ: the key
is three halves and the parities, 34 or 35 bits. Joining exact keys to the keys of the other side yields every
linked pair; the join condition verifies the distance. With 2^33 keys even 10^9 fingerprints meet few
others by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches, materialize, replace_columns, replaced_schema, slices
from tessera.llm.components import components

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 3
#: Shift and width of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Pairs of segments: one without errors, one with at most one.
ORDERS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DIGEST = xxhash.xxh64_intdigest


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text, repeats included."""
    words = text.translate(_LOWER).split()  # bytes split at ASCII white space only: the contract's separators
    if len(words) <= SHINGLE_WORDS:
        return np.array([_DIGEST(b" ".join(words), HASH_SEED)] if words else [], dtype=np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lows, highs = starts[: 1 - SHINGLE_WORDS].tolist(), ends[SHINGLE_WORDS - 1 :].tolist()
    return np.array([_DIGEST(flat[a:b], HASH_SEED) for a, b in zip(lows, highs, strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint_bits") -> DataFrame:
    """Adds the fingerprint of each whole text as a signed 64-bit number; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(text_col).cast(pa.binary()).to_pylist()
            found = [fingerprint(shingle_hashes(t or b"")) for t in texts]
            yield replace_columns(part, {out: pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())})

    return map_batches(docs, run, replaced_schema(docs, [T.StructField(out, T.LongType())]))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of the upper 12 bits of a word modulo the generator; by remainder, the error it stands for."""
    upper = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        upper ^= ((upper >> bit) & 1) * (GENERATOR << (bit - 11))
    single = [1 << i for i in range(23)]
    errors = [0, *single]
    errors += [a | b for i, a in enumerate(single) for b in single[:i]]
    errors += [a | b | c for i, a in enumerate(single) for j, b in enumerate(single[:i]) for c in single[:j]]
    errors = np.array(errors, dtype=np.int64)
    leader = np.zeros(1 << 11, np.int64)
    leader[upper[errors >> 11] ^ (errors & 0x7FF)] = errors  # perfect code: each remainder exactly once
    return upper, leader


REMAINDER, LEADER = _tables()


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (the 12 data bits) of the codeword within three bits of each 23-bit word."""
    return (words ^ LEADER[REMAINDER[words >> 11] ^ (words & 0x7FF)]) >> 11


def golay_keys(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By segment: exact keys (n), and fuzzy keys (n, 1 + bits), of unsigned 64-bit fingerprints."""
    out = []
    for shift, bits in SEGMENTS:
        word = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        near = word[:, None] ^ np.array([0, *(1 << i for i in range(bits))])
        keys = golay_index(near)
        out.append((keys[:, 0], keys))
    return out


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key rows of fingerprints, some 27 each: their exact keys, and those that meet others' exact keys.

    Of two fingerprints with different Golay indices, the one with the smaller index meets the other as a
    fuzzy row, so fuzzy keys below the own index are not needed. Where each segment has an error, the
    fingerprint whose first segment is even is the exact side, and the other one gives the parities that
    it looks for.
    """
    for part in slices(batches, 4096):
        signed = part.column("bits").to_numpy(zero_copy_only=False)
        node = part.column("node").to_numpy(zero_copy_only=False)
        prints = signed.view(np.uint64)
        words = [((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
        golay = golay_keys(prints)
        fuzzy = [np.nonzero((np.arange(k.shape[1]) == _first(k)) & (k > own[:, None])) for own, k in golay]
        for number, (i, j) in enumerate(ORDERS):
            head = (number << 40) | (words[i] << 12)
            row, col = fuzzy[j]
            key = np.concatenate([head | golay[j][0], head[row] | golay[j][1][row, col]])
            yield _key_rows(key, np.arange(len(key)) < len(head), np.concatenate([signed, signed[row]]), np.concatenate([node, node[row]]))
        parity = [np.bitwise_count(w).astype(np.int64) & 1 for w in words]
        wanted = ((parity[1] << 1) | parity[2]) ^ (3 * parity[0])
        for choice in range(8):
            key = ((len(ORDERS) + choice) << 40) | (wanted << 33)
            at = 0
            for k, (word, (_, bits)) in enumerate(zip(words, SEGMENTS, strict=True)):
                low = bits // 2
                upper = choice >> k & 1
                key = key | ((word >> low if upper else word & ((1 << low) - 1)) << at)
                at += bits - low if upper else low
            yield _key_rows(key, parity[0] == 0, signed, node)


def _key_rows(key: np.ndarray, exact: np.ndarray, bits: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(exact, pa.bool_()), pa.array(bits, pa.int64()), pa.array(node, pa.int64())], names=["key", "exact", "bits", "node"])


def _first(keys: np.ndarray) -> np.ndarray:
    """By cell: the first column of its row that holds the same key."""
    order = np.argsort(keys, axis=1, kind="stable")
    ranked = np.take_along_axis(keys, order, axis=1)
    new = np.concatenate([np.ones((len(keys), 1), bool), ranked[:, 1:] != ranked[:, :-1]], axis=1)
    start = np.maximum.accumulate(np.where(new, np.arange(keys.shape[1]), 0), axis=1)
    first = np.empty_like(order)
    np.put_along_axis(first, order, np.take_along_axis(order, start, axis=1), axis=1)
    return first


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) between the nodes of distinct fingerprints that differ in ``MAX_BITS`` bits or fewer.

    ``prints`` has one row for each distinct fingerprint: bits long, node long. A link may be given
    more than once. Fingerprints that are all within three bits of one another are few by nature (a
    ball of that radius has 43,745), so no key gathers an unbounded set of mutually linked rows; rows that
    share a key by chance are one in 2^33, and a key that many share is split by adaptive execution.
    """
    keys = map_batches(prints.select("bits", "node"), _expand, "key long, exact boolean, bits long, node long")
    keys = materialize(keys, "simhash-keys")
    a = keys.filter("exact").select("key", F.col("bits").alias("a"), F.col("node").alias("u"))
    b = keys.select("key", "exact", F.col("bits").alias("b"), F.col("node").alias("v"))
    close = F.expr(f"(NOT exact OR a < b) AND a <> b AND bit_count(a ^ b) <= {MAX_BITS}")
    return a.join(b, "key").filter(close).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of whole texts: one row per input row, (id, fingerprint, component_id).

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest id reachable over links,
    the row's own included. Null, empty and blank texts have fingerprint zero, which links like any
    other; a text of fewer than three words is one shingle. Equal fingerprints are joined once for all
    their documents, so copies cost no pairs. Rows that repeat an id are one document: what their texts
    link to is joined through it. Rows with a null id get the component of their fingerprint, which
    may be null if no row there has an id. Only the id and text columns are read; other columns are
    not carried. An empty table gives an empty result.
    """
    prints = materialize(
        with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "bits").select("id", "bits"),
        "simhash",
    )
    distinct = materialize(prints.groupBy("bits").agg(F.min("id").cast("long").alias("node")), "simhash-distinct")
    links = fingerprint_links(distinct.filter("node IS NOT NULL"))
    # An id with several texts ties their fingerprints together.
    shared = prints.groupBy("id").agg(F.min("bits").alias("low"), F.max("bits").alias("high")).filter("low <> high").select("id")
    ties = prints.join(shared, "id").join(distinct, "bits").select(F.col("id").cast("long").alias("u"), F.col("node").alias("v"))
    found = components(links.union(ties), "u", "v")
    named = distinct.join(found, distinct["node"] == found["node"], "left")
    named = materialize(named.select("bits", F.coalesce(found["component"], distinct["node"]).alias("component_id")), "simhash-named")
    out = prints.join(named, "bits")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each near-duplicate group kept: the one with the smallest id.

    All columns of ``docs`` stay as they are. Of rows that repeat the kept id, the first by text, then by
    the other columns that can be ordered, stays. Rows with a null id cannot be named as copies: they all
    stay. An empty table gives an empty result. The choice is made on ids; texts are shuffled once, to
    meet the chosen ids, and only those of ids that repeat are looked at again.
    """
    groups = near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("component_id").alias("__component"))
    per_id = groups.groupBy("__id").agg(F.min("__component").alias("__component"), F.count("*").alias("__rows"))
    first = F.min(F.struct("__id", "__rows")).alias("__first")
    chosen = per_id.filter("__id IS NOT NULL").groupBy("__component").agg(first).select("__first.*")
    chosen = materialize(chosen, "simhash-kept")
    # Sorted on both sides at every size: the kept ids grow with the documents.
    single = docs.join(chosen.filter("__rows = 1").hint("merge"), F.col(id_col) == F.col("__id"), "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
    repeated = chosen.filter("__rows > 1")
    if not repeated.take(1):
        return single
    ordered = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in (id_col, text_col)]
    rows = docs.join(repeated, F.col(id_col) == F.col("__id"), "left_semi")
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.min_by(F.struct(*docs.columns), F.struct(text_col, *ordered)).alias("__row"))
    return single.unionByName(rows.select("__row.*"))
