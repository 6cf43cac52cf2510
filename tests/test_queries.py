"""Every query that has SQL gives the same rows and values as the SQL."""

import subprocess
import sys
from pathlib import Path

import pytest
from harness import compare, connect

from firnline.catalog import oracle_sql, queries

SQL = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf_dir, name):
    r = compare(spark, con, name, QUERIES[name], SQL[name], sf_dir)
    assert r["ok"], r["why"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_query_has_a_stable_name():
    assert all(n == n.lower() and n[0] in "abcdefghi" for n in QUERIES)


def test_entry_works_where_a_library_of_the_subpackage_is_missing():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(SQL))], done.stderr
