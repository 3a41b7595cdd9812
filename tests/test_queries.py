"""Registered graph queries against their SQL, and the entry without the corpus part."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from codeloom import queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(str(tuple("" if v is None else str(v) for v in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert normal(tuple(r) for r in df.select(cols).collect()) == normal(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["callee_file", "projectFilePath"]


def test_entry_without_the_corpus_part(tmp_path):
    for name in ("codeloom", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q and 'who_calls_me' in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
