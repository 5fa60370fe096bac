"""Every query of the library that has SQL gives the rows of that SQL in DuckDB."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from scriptloom import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(normal(r[i])) for i in order) for r in rows))


def compare(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = base.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())
    assert len(a) == len(b)
    assert a == b
    return len(a)


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, own.queries()[name], own.oracle_sql()[name]) > 0


def test_sql_is_text_alone(tmp_path):
    """queries() and oracle_sql() work where PySpark has no jars beside it, open no file and start no JVM."""
    code = f"""
import builtins, subprocess, pyspark, __spark_entry__ as e
pyspark.__file__ = {str(tmp_path / "pyspark" / "__init__.py")!r}
def refuse(*a, **b): raise AssertionError(a)
builtins.open = subprocess.Popen = refuse
names, sql = e.queries(), e.oracle_sql()
assert set(sql) <= set(names) and all(isinstance(x, str) and x.strip() for x in sql.values())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
