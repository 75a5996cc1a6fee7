import numpy as np
import pytest
import xxhash

from tessera.llm import simhash, vector_dedup
from tessera.llm.components import components, forest


def union_find(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    pairs += [(k, k + 1) for k in range(300, 420)] + [(500, k) for k in range(501, 560)] + [(7, 7), (301, 300)]
    want = union_find(600, pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {k: want[k] for k in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    assert forest([1, 2, 5], [2, 3, 5]) == ([2, 3], [1, 1])


def brute_print(text):
    words = (text or "").encode().translate(simhash._LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def test_golay_decoding_is_within_three_bits_of_one_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 20_000)
    index = simhash.golay_index(words)
    code = simhash.golay_index(np.arange(1 << 23).reshape(-1, 1 << 12)[:, 0])
    assert len(np.unique(code)) <= 4096 and index.max() < 4096
    data = np.arange(1 << 12)
    codewords = (data << 11) | simhash.REMAINDER[data]
    assert (np.bitwise_count(codewords[index] ^ words) <= 3).all()
    keys = np.stack([simhash.golay_index(words ^ e) for e in (0, *(1 << i for i in range(23)))])
    assert max(len(np.unique(k)) for k in keys.T) == 6


def test_every_link_is_a_candidate(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
    values = np.unique(np.concatenate([base, near, [np.uint64(0), np.uint64(7), np.uint64(2**64 - 1)]]))
    want = {(a, b) for a in range(len(values)) for b in range(a) if int(values[a] ^ values[b]).bit_count() <= 3}
    df = spark.createDataFrame([(int(v), k) for k, v in enumerate(values.view(np.int64))], "bits long, node long")
    got = {(max(r), min(r)) for r in simhash.fingerprint_links(df).collect()}
    assert {tuple(r) for r in got} == want and len(want) > 100


def test_every_pattern_of_errors_meets_by_a_key(spark):
    """One base and a partner for each way to spread three errors or fewer over the segments."""
    rng, pairs = np.random.default_rng(5), []
    for counts in [(a, b, c) for a in range(4) for b in range(4) for c in range(4) if 0 < a + b + c <= 3]:
        for _ in range(12):
            base = other = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
            for (shift, bits), n in zip(simhash.SEGMENTS, counts, strict=True):
                for bit in rng.choice(bits, n, replace=False).tolist():
                    other ^= 1 << (shift + bit)
            pairs.append((base, other))
    values = [x for p in pairs for x in p]
    nodes = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame(list(zip(nodes, range(len(nodes)), strict=True)), "bits long, node long"))
    got = {(min(r), max(r)) for r in links.collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(len(pairs))}


def test_keep_one_chooses_among_repeated_ids_by_text_then_columns(spark):
    rows = [(1, "b b b", "x", {"k": 1}), (1, "a a a", "z", {"k": 2}), (1, "a a a", "y", {"k": 3}), (2, "q r s t", "w", None), (None, "a a a", "n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>")
    for parts in (1, 5):
        got = sorted((r["doc_id"] or 0, r["text"], r["source"]) for r in simhash.keep_one(docs.repartition(parts)).collect())
        assert got == [(0, "a a a", "n"), (1, "a a a", "y"), (2, "q r s t", "w")]


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{k}é" for k in range(400)]
    texts = [" ".join(rng.choice(vocab, 120)) for _ in range(40)]
    texts += [t.upper() for t in texts[:5]] + [t + " tail" for t in texts[5:25]] + [texts[0]] * 3
    texts += ["", None, " \t\r\n", "one", "one two", "ONE two", "one two three", "nb sp x y", "long " * 20_000]
    rows = [(k + 10, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(t) for t in texts]
    root = union_find(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    for k in range(len(texts)):
        assert got[k + 10]["fingerprint"] == f"{prints[k]:016x}" and got[k + 10]["component_id"] == root[k] + 10
    kept = simhash.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({r + 10 for r in root}) and kept[0]["component_id"] == 0


def test_simhash_ids_that_repeat_or_are_null(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "q r s t u v"), (2, "q r s t u v"), (None, "a b c d e f"), (None, "other words go here")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(2, 2), (5, 2), (5, 2)]
    assert [r["component_id"] for r in got if r["doc_id"] is None].count(2) == 1
    assert sorted(r["doc_id"] or 0 for r in simhash.keep_one(docs).collect()) == [0, 0, 2]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_vectors(rows):
    n, links = len(rows), []

    def ok(v):
        return v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)

    for a in range(n):
        for b in range(a):
            (_, v, la), (_, w, lb) = rows[a], rows[b]
            if la is not None and la == lb and ok(v) and ok(w) and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                    links.append((a, b))
    return links


@pytest.mark.parametrize("chunk_rows", [1024, 7])
def test_vectors_equal_brute_force(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(vector_dedup, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(vector_dedup, "TILE_ROWS", 5)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 20))
    rows = []
    for k in range(120):
        v = centres[k % 6] + rng.normal(size=20) * (0.13 if k % 5 else 0.6)
        rows.append((v.astype(np.float32) * np.float32(1 + k % 3)).tolist())
    rows += [rows[0]] * 3 + [[0.0] * 20, None, [], [1.0, None] * 10, [float("nan")] * 20, [float("inf")] * 20, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [1e30] * 20, [1e-30] * 20]
    rows = [(k, v, None if k == 50 else k % 2) for k, v in enumerate(rows)]
    links = brute_vectors(rows)
    root = union_find(len(rows), links)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")).collect()}
    counts = np.bincount([x for p in links for x in p], minlength=len(rows))
    assert len(links) > 100
    for k in range(len(rows)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (counts[k], root[k], root[k] == k), k


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vector_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (9, [0.0, 2.0], 1), (8, [2.0, 0.0], 1)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"]) == [(3, 1, 3), (3, 1, 3), (8, 1, 3), (9, 1, 3)]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, True)]
