"""The registered query functions on fixtures: folds, brute force, the tokenizers library, planted links."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import licences, queries, vector_dedup
from tests.llm.test_duplicates import brute_print, union_find

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of river stone table lamp house green walk under light paper".split(), "de": "der die das fluss stein tisch lampe haus gehen licht papier und".split()}


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(path)


def documents(n=400):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for k in range(n):
        lang = ("en", "de")[k % 2]
        extra = ["scumlike", "idiotish"][: 2 * (k % 5 == 0)]
        rows.append((k, " ".join([*rng.choice(WORDS[lang], 25), *extra]), lang, f"s{k % 3}", 0))
        labels.append((k, 0, int(k % 5 == 0)))
    rows += [(n, None, "en", None, 0), (n + 1, "", None, None, 0), (n + 2, "12 !", "de", "s1", 0)]
    return rows, labels


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def result(query, spark, folder):
    return {r["doc_id"]: r for r in query(spark, folder).collect()}


def test_op1_learns_from_its_folds_only(spark, tmp_path):
    rows, labels = documents()
    folder = str(tmp_path)
    write(spark, rows, DOCUMENTS, f"{folder}/documents.parquet")
    write(spark, labels, "doc_id long, quality int, toxic int", f"{folder}/labels.parquet")
    got = result(queries.op1_toxicity, spark, folder)
    assert got.keys() == {r[0] for r in rows}
    assert all(r["held_out"] == (fold(k, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for k, r in got.items())
    assert np.mean([got[k]["predicted"] == t for k, _, t in labels if fold(k, 5) == 0]) > 0.98
    # Labels held out, languages, sources and other rows' ids are no inputs.
    write(spark, [(k, q, 1 - t if fold(k, 5) == 0 else t) for k, q, t in labels], "doc_id long, quality int, toxic int", f"{folder}/labels.parquet")
    write(spark, [(k, t, "xx", "yy", 9) for k, t, *_ in rows], DOCUMENTS, f"{folder}/documents.parquet")
    again = result(queries.op1_toxicity, spark, folder)
    assert {k: r["score"] for k, r in again.items()} == {k: r["score"] for k, r in got.items()}


def test_op7_learns_from_its_folds_only(spark, tmp_path):
    rows, _ = documents()
    folder = str(tmp_path)
    write(spark, rows, DOCUMENTS, f"{folder}/documents.parquet")
    got = result(queries.op7_language, spark, folder)
    assert got.keys() == {r[0] for r in rows}
    assert all(r["held_out"] == (fold(k, 4) == 2) and 0 <= r["score"] <= 1 for k, r in got.items())
    assert all(got[k]["lang_pred"] == lang for k, _, lang, *_ in rows[:400]) and [got[k]["lang_pred"] for k in (400, 401, 402)] == ["und"] * 3
    write(spark, [(k, t, "qq" if fold(k, 4) == 2 else lang, "z", 1) for k, t, lang, *_ in rows], DOCUMENTS, f"{folder}/documents.parquet")
    again = result(queries.op7_language, spark, folder)
    assert {k: (r["lang_pred"], r["score"]) for k, r in again.items()} == {k: (r["lang_pred"], r["score"]) for k, r in got.items()}


@needs_tables
def test_op4_equals_brute_force_on_all_documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_print(r["text"]) for r in rows]
    root = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = result(queries.op4_simhash, spark, SF_DIR)
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        assert (got[r["doc_id"]]["fingerprint"], got[r["doc_id"]]["component_id"]) == (f"{prints[k]:016x}", rows[root[k]]["doc_id"])


@needs_tables
def test_op8_equals_the_library_on_all_documents(spark):
    lib = Tokenizer.from_file(queries.VOCABULARY)
    lib.no_truncation()
    lib.no_padding()
    got = result(queries.op8_bpe, spark, SF_DIR)
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert got.keys() == {r["doc_id"] for r in rows}
    for r in rows:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))))
        assert tuple(got[r["doc_id"]][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == want


@needs_tables
def test_op9_equals_a_naive_scan_of_all_documents(spark):
    """All known sentences tried at every place of every line or run of lines, longest first, then single-sentence rules."""
    names = {licences.normalise(s): i for i, found in licences.SENTENCES.items() for s in found}
    alone = {r.sequence[0]: r.licence for r in licences.RULES if len(r.sequence) == 1}
    got = result(queries.op9_licences, spark, SF_DIR)
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    seen = 0
    for r in rows:
        text = r["text"] or ""
        want = [alone[names[k]] for line in text.split("\n") if (k := licences.normalise(line)) in names and names[k] in alone]
        spans = [s.rsplit(":", 2) for s in got[r["doc_id"]]["spans"].split(";") if s]
        assert [s[0] for s in spans] == want and got[r["doc_id"]]["n_licences"] == len(want)
        assert all(licences.normalise(text[int(a) : int(b)]) in names for _, a, b in spans)
        seen += len(want)
    assert seen > 0


@pytest.mark.parametrize("chunk_rows", [16_384, 60])
def test_op2_equals_its_sql_on_planted_links(spark, tmp_path, monkeypatch, chunk_rows):
    """Exact and near copies, pairs about the bound, a crowded cell, several labels, vectors that cannot link."""
    monkeypatch.setattr(vector_dedup, "CHUNK_ROWS", chunk_rows)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [v for v in base] + [v * 3 for v in base[:5]]
    for k in range(120):  # angles about the bound
        side = rng.normal(size=64)
        side -= base[k % 40] * (side @ base[k % 40])
        cosine = 0.98 + rng.choice([-1, 1]) * rng.uniform(1e-4, 0.02)
        rows.append(base[k % 40] * cosine + side / np.linalg.norm(side) * np.sqrt(max(0, 1 - cosine**2)))
    rows += [base[0] + rng.normal(size=64) * 0.01 for _ in range(300)]
    table = [(k, v.astype(np.float32).tolist(), k % 2 if k < 165 else 0) for k, v in enumerate(rows)]
    table += [(1000, None, 0), (1001, [0.0] * 64, 0), (1002, [None] + [1.0] * 63, 0), (1003, [float("nan")] * 64, 0), (1004, base[0].tolist(), None), (1005, [float("inf")] * 64, 1)]
    path = f"{tmp_path}/embeddings.parquet"
    write(spark, table, "vec_id long, embedding array<float>, label int", path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.OP2_SQL)
    columns = [d[0] for d in want.description]
    got = queries.op2_vectors(spark, str(tmp_path)).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert got.agg(F.sum("n_links")).first()[0] > 10_000
