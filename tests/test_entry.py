import importlib
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_contract(spark):
    mod = importlib.import_module("__spark_entry__")
    df = mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["orig_reg", "orig_cnty_name", "dest_cnty_name", "tons"]
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


def test_queries_without_the_optional_part(tmp_path):
    """A package that only the training-data operators need is absent: all other queries stay."""
    from freightcube.plans.catalog import QUERIES
    (tmp_path / "xxhash.py").write_text("raise ImportError('blocked')")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), ROOT, os.environ.get("PYTHONPATH", "")])}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, check=True)
    assert [int(x) for x in out.stdout.split()] == [len(QUERIES), len(QUERIES)]
