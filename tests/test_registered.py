"""Registered queries: against their SQL, streams against batches, and the entry module."""

import numbers
import os
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows_of(frame):
    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        is_number = isinstance(v, (numbers.Number, np.number)) and not isinstance(v, (bool, np.bool_))
        return f"{float(v) + 0.0:.6f}" if is_number else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(QUERIES)))
def test_equals_its_sql(spark, db, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_streams_equal_batches(spark):
    q = entry.queries()
    pairs = [("t6_stream_arbiter", "j9_arbitrate", ["symbol", "arrival", "accepted", "selected", "selected_sequence"]), ("t4_book_owner", "w4_running_levels", ["sequence", "level_qty"])]
    for stream, batch, columns in pairs:
        a, b = (q[n](spark, DATA).select(*columns).toPandas() for n in (stream, batch))
        assert rows_of(a) == rows_of(b), stream


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_imports_without_the_llm_folders(tmp_path):
    """As after their removal, with everything else in place."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    (tmp_path / "tidemark").mkdir()
    for x in os.listdir(f"{root}/tidemark"):
        if x not in ("llm", "__pycache__"):
            os.symlink(f"{root}/tidemark/{x}", tmp_path / "tidemark" / x)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a24_bars' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
