"""The entry points, with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone(tmp_path):
    shutil.copytree(ROOT / "rulesieve", tmp_path / "rulesieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(x.startswith('op') for x in q); print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout
    done = subprocess.run([sys.executable, "-m", "pytest", "tests/test_parser.py", "tests/test_dag.py", "tests/test_console.py", "-q"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stdout


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_queries_agree_with_sql(spark):
    """A few queries over the smallest tables; the whole comparison is the driver's."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{base}/events.parquet'")
    for name in ("match_many_compiled", "match_many_relational", "xor_chain", "json_ingest", "deliver_catch_all", "nan_undefined"):
        got = entry.queries()[name](spark, base)
        columns = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(want), name
    assert entry.entry(spark).count() > 0
