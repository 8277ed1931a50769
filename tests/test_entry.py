"""The driver contract: queries run, and give what their SQL gives."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from orrery.plans import catalog_queries, engine_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog_queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert rows
    if name in catalog_queries.ORACLE_SQL:
        found = duck.execute(catalog_queries.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted(str(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in found.fetchall())


def test_contract_without_the_corpus_folders(tmp_path):
    """queries() and oracle_sql() work where orrery/llm is deleted, with and without corpus_pipeline.py."""
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "orrery", tmp_path / "orrery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    told = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    counts = f"{len(catalog_queries.QUERIES)} {len(catalog_queries.ORACLE_SQL)}"
    alone = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", told], cwd=tmp_path, env=alone, capture_output=True, text=True, check=True).stdout.strip() == counts
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert subprocess.run([sys.executable, "-c", told], cwd=tmp_path, env=alone, capture_output=True, text=True, check=True).stdout.strip() == counts
