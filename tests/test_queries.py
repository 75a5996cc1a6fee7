import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from tessera.queries import ORACLE_SQL, QUERIES, size_of

SF_DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def plain(rows, order):
    out = [tuple(repr(float(r[k])) if isinstance(r[k], float) and not math.isnan(r[k]) else str(r[k]) for k in order) for r in rows]
    return sorted(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), [got.columns.index(c) for c in sorted(columns)]) == plain(want.fetchall(), [columns.index(c) for c in sorted(columns)])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_bears_what_cannot_be_imported(tmp_path):
    """Once with the pipeline there and both folders gone, once without a package that only the corpus operators need."""
    code = "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and set(e.oracle_sql()) == set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    shutil.copytree(ROOT, tmp_path / "a", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    assert (tmp_path / "a/corpus_pipeline.py").exists() or not os.path.exists(f"{ROOT}/corpus_pipeline.py")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "a", check=True, env=env)
    shutil.copytree(ROOT, tmp_path / "b", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    subprocess.run([sys.executable, "-c", f"import sys; sys.modules['public_tokenizers'] = None; {code}"], cwd=tmp_path / "b", check=True, env=env)


def test_axis_sizes(spark):
    assert [size_of(spark.createDataFrame(rows, "k long"), "k") for rows in ([], [(0,)], [(0,), (4,)])] == [0, 1, 5]


def test_coordinates_are_joined_to_every_cell(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    got = QUERIES["decode_coords_join"](spark, SF_DIR)
    assert got.count() == orders
    assert got.filter("n_name IS NULL").count() == 0


def test_whole_arrays_are_concatenated_read_and_planned(spark):
    cells = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count() * 64
    assert QUERIES["open_mfdataset_concat_whole"](spark, SF_DIR).count() == 2 * cells
    assert QUERIES["datasource_parallel"](spark, SF_DIR).count() == cells
    assert QUERIES["chunk_slices_whole"](spark, SF_DIR).selectExpr("sum(src_end - src_start)").first()[0] == cells
