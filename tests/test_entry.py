"""Every registered query against its SQL on the smallest tables, and the library without its optional parts."""

from __future__ import annotations

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from loomlake.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_and_sql_agree(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    if name not in catalogue.oracle_sql():
        assert rows
        return
    said = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in said.description]
    order = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(got.columns)
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in said.fetchall()), key=repr)


def test_every_image_asks(spark):
    assert catalogue.queries()["q34_family_hit_at_k"](spark, SF).first().n == catalogue.grids(spark, SF).count()


def test_entry(spark):
    assert entry.entry(spark).count() == 10 * 5  # ids that 100 divides
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_parts(tmp_path):
    for p in ("loomlake", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    (tmp_path / "loomlake").mkdir()
    for p in (ROOT / "loomlake").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "loomlake" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(catalogue.queries())), "False"]
