"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. Rotating them to their principal axes and dealing
the axes out to blocks keeps distances, so of two vectors within the squared budget 2 - 2c at least
one block is within its proportional share. Each block is range-joined on a grid over its leading
axes, with cells as wide as twice the block's radius: a row lies in its own cell and visits those
neighbours which its ball reaches and which come after its own in order. The union of the blocks'
candidates is verified by exact cosine, each pair in the first block that proposes it.

A cell of many rows is dealt into chunks, and each pair of chunks is a task of bounded size. No pair
leaves a task: it emits each row's number of links and a spanning forest of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, materialize, slices
from tessera.llm.components import components

MIN_COSINE = 0.98
BLOCK_DIMS = 8
#: Rows of a cell's chunk, on average: bounds what one task holds. A cell of n rows is sent n / CHUNK_ROWS times.
CHUNK_ROWS = 16_384
#: Rows of a chunk that are compared at a time.
TILE_ROWS = 1024
#: Added to budgets and radii, so that rounding never loses a pair; the exact check decides.
SLACK = 1e-7


def usable(vector: list | None) -> bool:
    return bool(vector) and None not in vector and all(map(math.isfinite, vector)) and any(vector)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, key and the bytes of vectors that may link (else null key and vector).

    The bytes are those of 32-bit floats where the input has them, else of doubles.
    """
    for part in slices(batches, 2048):
        kind = part.schema.field("embedding").type
        single = pa.types.is_list(kind) and kind.value_type == pa.float32()
        ids, labels, vectors = (part.column(n).to_pylist() for n in ("vec_id", "label", "embedding"))
        keys, raw = [], []
        for i, label, v in zip(ids, labels, vectors, strict=True):
            if i is None or label is None or not usable(v):
                keys.append(None)
                raw.append(None)
                continue
            data = (np.asarray(v, np.float32 if single else np.float64) + 0.0).tobytes()  # + 0.0: no negative zeros
            raw.append(data)
            keys.append(xxhash.xxh3_128_digest(str(label).encode() + b"\0" + data))
        dims = [None if r is None else len(v) for r, v in zip(raw, vectors, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("vec_id").cast(pa.int64()), pa.array(map(str, labels), pa.string()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())],
            names=["vec_id", "label", "dims", "key", "vector"],
        )


def unit(raw: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors, in double precision."""
    x = np.frombuffer(b"".join(raw), np.float32 if len(raw[0]) == 4 * dims else np.float64).reshape(-1, dims).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of very large components
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for part in slices(batches, 4096):
        dims, raw = np.array(part.column("dims").to_pylist()), part.column("vector").to_pylist()
        for d in np.unique(dims).tolist():
            x = unit([raw[k] for k in np.flatnonzero(dims == d)], d)
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, s in sums.items():
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s[i, j])], names=["dims", "i", "j", "s"]
        )


class Rotation:
    """Principal axes of vectors of ``d`` dimensions, dealt to blocks so that each gets strong axes first."""

    def __init__(self, second_moments: np.ndarray, grid: int):
        d = len(second_moments)
        values, axes = np.linalg.eigh(second_moments)
        order = np.argsort(-values, kind="stable")
        n = max(1, math.ceil(d / BLOCK_DIMS))
        self.blocks = [np.ascontiguousarray(axes[:, order[b::n]]) for b in range(n)]
        total = 2 - 2 * MIN_COSINE
        self.budgets = [total * b.shape[1] / d + SLACK for b in self.blocks]
        self.radii = [math.sqrt(b) + SLACK for b in self.budgets]
        self.grids = [min(grid, b.shape[1]) for b in self.blocks]


def cell_rows(y: np.ndarray, radius: float, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cells and visited cells of points: row numbers, whether own, cells (int16 by grid axis).

    Cells are 2 * radius wide, so on each axis a ball reaches the own cell and at most one neighbour;
    cells that only the bounding box of the ball reaches are left out.
    """
    width = 2 * radius
    own = np.floor(y[:, :grid] / width)
    inside = y[:, :grid] - own * width
    step = np.where(inside < radius, -1, 1)
    gap = np.minimum(inside, width - inside) ** 2
    rows, cells = [np.arange(len(y))], [own]
    for mask in range(1, 1 << grid):
        axes = [a for a in range(grid) if mask >> a & 1]
        forward = step[:, axes[0]] > 0  # the first axis that differs decides which cell comes after
        hit = np.flatnonzero(forward & (gap[:, axes].sum(axis=1) <= radius * radius))
        cell = own[hit].copy()
        cell[:, axes] += step[hit][:, axes]
        rows.append(hit)
        cells.append(cell)
    row = np.concatenate(rows)
    mine = np.arange(len(row)) < len(y)
    return row, mine, np.concatenate(cells).astype(np.int16)


def near_vectors(vectors: DataFrame) -> DataFrame:
    """Links of vectors with equal labels and cosine >= ``MIN_COSINE``, in double precision.

    ``vectors`` has vec_id, embedding (array of numbers), label. One row per input row: vec_id, n_links
    long (other rows linked directly), component_id long (smallest vec_id reachable, the own included),
    kept boolean (vec_id = component_id). Vectors that are null, empty, zero, or hold nulls or non-finite
    numbers, and those with a null label or id, link with nothing (a null id has a null component and is kept);
    vectors of different lengths never link. Equal vectors of a label are compared once and count for all their rows, so copies cost no
    comparisons. Rows that repeat a vec_id are vectors of their own and share a component. Extra columns
    are not carried. An empty table gives an empty result.
    """
    rows = map_batches(
        vectors.select("vec_id", "label", "embedding"), _prepare, "vec_id long, label string, dims int, key binary, vector binary"
    )
    rows = materialize(rows, "vectors")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.min("label").alias("label"), F.min("dims").alias("dims"), F.min("vector").alias("vector")
    )
    classes = materialize(classes, "vector-classes")
    rotations = _rotations(classes)
    cells = _cells(classes, rotations)
    found = materialize(_compare(cells, rotations), "vector-links")
    linked = found.groupBy("key").agg(F.sum("n").alias("n"))
    ids = classes.select("key", "node")
    # Ends of forest links are class keys; an id that several classes hold ties them together by itself.
    edges = found.filter("root IS NOT NULL").select("node", "root")
    held = rows.filter("key IS NOT NULL").select("vec_id", "key")
    several = held.groupBy("vec_id").agg(F.min(F.xxhash64("key")).alias("low"), F.max(F.xxhash64("key")).alias("high")).filter("low <> high").select("vec_id")
    ties = held.join(several, "vec_id").join(ids, "key").select(F.col("vec_id").alias("node"), F.col("node").alias("root"))
    group = components(edges.union(ties), "node", "root")
    named = ids.join(linked, "key", "left").join(classes.select("key", "copies"), "key")
    named = named.join(group.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = named.select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    named = materialize(named, "vector-named").withColumnRenamed("key", "_key")
    out = rows.join(named, F.col("key") == F.col("_key"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def _rotations(classes: DataFrame) -> dict[int, Rotation]:
    """By vector length, from sums over all vectors; more grid axes the more vectors there are."""
    sums = map_batches(classes.select("dims", "vector"), _moments, "dims int, i int, j int, s double")
    counts = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    moments: dict[int, np.ndarray] = {d: np.zeros((d, d)) for d in counts}
    # One number for each pair of axes, whatever the number of vectors.
    for r in sums.groupBy("dims", "i", "j").agg(F.sum("s").alias("s")).collect():
        moments[r["dims"]][r["i"], r["j"]] = moments[r["dims"]][r["j"], r["i"]] = r["s"]
    return {d: Rotation(m, max(2, math.ceil(math.log2(counts[d] + 1) / 4) - 1)) for d, m in moments.items()}


def _cells(classes: DataFrame, rotations: dict[int, Rotation]) -> DataFrame:
    """Rows of the grid join, with the chunk pairs of crowded cells as tasks."""
    shared = classes.sparkSession.sparkContext.broadcast(rotations)

    def expand(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            keys, labels, dims, raw = (part.column(n).to_pylist() for n in ("key", "label", "dims", "vector"))
            node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
            dims = np.array(dims)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x, turn = unit([raw[k] for k in at], d), shared.value[d]
                for b, axes in enumerate(turn.blocks):
                    row, own, cell = cell_rows(x @ axes, turn.radii[b], turn.grids[b])
                    src = at[row]
                    head = [f"{d}:{b}:{labels[k]}:".encode() for k in at]
                    names = [head[r] + c.tobytes() for r, c in zip(row.tolist(), cell, strict=True)]
                    columns = {"cell": pa.array(names, pa.binary())}
                    if full:
                        columns |= {
                            "own": pa.array(own),
                            "dims": pa.array(np.full(len(src), d), pa.int32()),
                            "block": pa.array(np.full(len(src), b), pa.int32()),
                            "key": pa.array([keys[k] for k in src], pa.binary()),
                            "node": pa.array(node[src], pa.int64()),
                            "copies": pa.array(copies[src], pa.int64()),
                            "vector": pa.array([raw[k] for k in src], pa.binary()),
                        }
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    source = classes.select("key", "node", "copies", "label", "dims", "vector")
    counted = map_batches(source, lambda b: expand(b, False), "cell binary").groupBy("cell").agg(F.count("*").alias("n"))
    # Only crowded cells are listed: at most one for every CHUNK_ROWS rows of the join.
    crowded = counted.filter(F.col("n") > CHUNK_ROWS).select("cell", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("chunks"))
    crowded = materialize(crowded, "vector-cells")
    rows = map_batches(
        source, lambda b: expand(b, True), "cell binary, own boolean, dims int, block int, key binary, node long, copies long, vector binary"
    )
    rows = rows.join(crowded, "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.expr("pmod(xxhash64(key), chunks)").cast("int"))
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda c: F.struct(F.least(c, F.col("chunk")).alias("low"), F.greatest(c, F.col("chunk")).alias("high")),
    )
    rows = rows.withColumn("task", F.explode(tasks))
    return rows.select("cell", "task.low", "task.high", "chunk", "own", "dims", "block", "key", "node", "copies", "vector")


def _compare(cells: DataFrame, rotations: dict[int, Rotation]) -> DataFrame:
    """(key, node, n, root): by task, rows with links, how many, and their root in a spanning forest."""
    shared = cells.sparkSession.sparkContext.broadcast(rotations)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sorted rows of a partition, one batch for each task of two rows or more."""
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            names = batch.column("cell").to_pylist()
            low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
            new = [i for i in range(1, len(names)) if names[i] != names[i - 1] or low[i] != low[i - 1] or high[i] != high[i - 1]]
            edges = [0, *new]
            for a, b in zip(edges, new, strict=False):
                if b - a > 1:
                    yield batch.slice(a, b - a)
            rest = batch.slice(edges[-1]) if len(names) else None
        if rest is not None and rest.num_rows > 1:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[list, list, list, list]] = []
        for group in groups(batches):
            found = compare_group(group, shared.value)
            if found:
                kept.append(found)
            if kept and (sum(len(k[0]) for k in kept) > 10_000):
                yield emit(kept)
                kept = []
        if kept:
            yield emit(kept)

    def emit(kept: list) -> pa.RecordBatch:
        key, node, n, root = ([x for k in kept for x in k[i]] for i in range(4))
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.binary()), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(root, pa.int64())], names=["key", "node", "n", "root"]
        )

    order = ["cell", "low", "high"]
    dealt = cells.repartition(*order).sortWithinPartitions(*order)
    return map_batches(dealt, run, "key binary, node long, n long, root long")


def compare_group(group: pa.RecordBatch, rotations: dict[int, Rotation]) -> tuple[list, list, list, list] | None:
    """Verified links of one task: its rows of chunk ``low`` against those of chunk ``high``."""
    own = group.column("own").to_numpy(zero_copy_only=False)
    chunk = group.column("chunk").to_numpy()
    low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
    left = np.flatnonzero(chunk == low)
    right = left if low == high else np.flatnonzero(chunk == high)
    if not own.any() or not len(left) or not len(right):
        return None
    d, b = group.column("dims")[0].as_py(), group.column("block")[0].as_py()
    turn = rotations[d]
    x = unit(group.column("vector").to_pylist(), d)
    y = x @ turn.blocks[b]
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for p in range(0, len(left), TILE_ROWS):
        for q in range(p if low == high else 0, len(right), TILE_ROWS):
            ends.append(_tile(x, y, own, left[p : p + TILE_ROWS], right[q : q + TILE_ROWS], low == high and p == q, turn, b))
    i, j = (np.concatenate([e[k] for e in ends]) for k in range(2))
    if not len(i):
        return None
    copies, node = group.column("copies").to_numpy(), group.column("node").to_numpy()
    n = np.bincount(i, copies[j], len(own)) + np.bincount(j, copies[i], len(own))
    root = np.arange(len(own))
    while True:  # smallest reachable row, by pulling labels over links
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    with_links = np.flatnonzero(n)
    keys = group.column("key").to_pylist()
    return [keys[k] for k in with_links], node[with_links].tolist(), n[with_links].astype(np.int64).tolist(), node[root[with_links]].tolist()


def _tile(x: np.ndarray, y: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, turn: Rotation, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between some rows and others; ``same`` if they are the same rows."""
    apart = (y[left] ** 2).sum(axis=1)[:, None] + (y[right] ** 2).sum(axis=1)[None, :] - 2 * (y[left] @ y[right].T)
    near = (apart <= turn.budgets[b] + SLACK) & (own[left][:, None] | own[right][None, :])
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    good = np.zeros(len(i), bool)
    for at in range(0, len(i), 8192):
        p, q = i[at : at + 8192], j[at : at + 8192]
        cosine = np.einsum("ij,ij->i", x[p], x[q])
        linked = np.flatnonzero(cosine >= MIN_COSINE)
        diff = x[p[linked]] - x[q[linked]]
        inside = [((diff @ axes) ** 2).sum(axis=1) <= budget for axes, budget in zip(turn.blocks[: b + 1], turn.budgets, strict=False)]
        first = inside[b]  # and no earlier block within its budget, which has counted the pair
        for earlier in inside[:b]:
            first &= ~earlier
        good[at + linked[first]] = True
    return i[good], j[good]
