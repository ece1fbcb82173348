"""Every registered query of the library against its SQL, on the smallest driver tables, where they exist."""

from __future__ import annotations

import math
import os

import pytest

from tracelake.plans import oracle

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


def same(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(oracle.SQL) == set(oracle.QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.QUERIES))
def test_query(spark, duck, name):
    df = oracle.QUERIES[name](spark, SF)
    found = duck.execute(oracle.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert same([tuple(r) for r in df.collect()], df.columns) == same(found.fetchall(), columns)


def test_entry_without_the_corpus_operators(spark):
    """The entry and the other queries work where llm and the pipeline are gone."""
    import subprocess
    import sys

    code = "import sys; sys.modules['tracelake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'timeline_page' in q and not any(k.startswith('op1') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
