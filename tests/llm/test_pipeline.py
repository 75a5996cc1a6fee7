import hashlib
import os
import random

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tessera.llm import mixing, queries, simhash
from tests.llm.test_duplicates import brute_print, union_find

SF_DIR = "/root/testdata/sf0.001"


def fixture_rows():
    rng = random.Random(8)
    vocab = {"en": [f"the{k} thing{k}" for k in range(60)], "de": [f"der{k}ß lich{k}" for k in range(60)]}
    docs, labels = [], []
    for k in range(240):
        lang = ["en", "de"][k % 2]
        text = " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(20, 60)))
        toxic = k % 6 == 0
        docs.append([k, text + (" idiotish scumlike" * 2 if toxic else ""), lang, f"s{k % 4}"])
        labels.append((k, 0, int(toxic)))
    for k in (1, 1, 2, 3):  # copies, exact and near
        docs.append([len(docs), docs[k][1], docs[k][2], "s9"])
    docs.append([len(docs), docs[5][1].upper(), "en", "s1"])
    docs.append([len(docs), " ".join(rng.choice(vocab["en"]) for _ in range(12)), "en", "tiny"])  # a source that the mix cuts
    docs.append([len(docs), "кот собака дом река стол лампа бумага свет камень зелёный " * 4, None, "s2"])  # in no language that is learned
    for text in ("12 34 !!", "", None):
        docs.append([len(docs), text, "en", None])
    return [(*d, len(d[1] or "")) for d in docs], labels


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = fixture_rows()
    sf_dir = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    kept = [r for r in rows if "idiotish" not in (r[1] or "").lower()]
    kept = [r for r in kept if any(c.isalpha() for c in r[1] or "") and "собака" not in r[1]]
    prints = [brute_print(r[1]) for r in kept]
    root = union_find(len(kept), [(a, b) for a in range(len(kept)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS])
    kept = [r for k, r in enumerate(kept) if root[k] == k]
    size = {}
    for r in kept:
        size[r[3]] = size.get(r[3], 0) + len(r[1].split())
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(size))}
    free, left = set(size), float(sum(size.values()))
    while cut := {s for s in free if left / sum(weight[x] for x in free) * weight[s] > 3 * size[s]}:
        free -= cut
        left -= sum(3 * size[s] for s in cut)
    assert size.keys() - free == {"tiny"}
    level = left / sum(weight[s] for s in free)
    lib, want = Tokenizer.from_file(queries.VOCABULARY), []
    for r in kept:
        rate = level * weight[r[3]] / size[r[3]] if r[3] in free else 3
        draw = int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) / 16**13
        ids = lib.encode(r[1], add_special_tokens=False).ids
        want += [(r[0], tuple(ids), lib.decode(ids, skip_special_tokens=False))] * (int(rate) + (draw < rate - int(rate)))
    assert sorted((r["doc_id"], tuple(r["token_ids"]), r["decoded"]) for r in got) == sorted(want)


def test_stages_keep_the_columns_and_bear_empty_tables(spark, tmp_path):
    sf_dir = f"file://{tmp_path}"
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, copies string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    for rows in ([], [(1, None, None, None, None, "a", "b"), (1, "one two", "en", "s", 7, "a", "b"), (1, "one two", "en", "s", 7, "a", "b")]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert {(r["score"], r["copies"]) for r in out.collect()} <= {("a", "b")}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{table}'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())
