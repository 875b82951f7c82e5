"""Every query with SQL against DuckDB on the smallest tables, and the driver's contract."""

from __future__ import annotations

import datetime
import math
import os
import subprocess
import sys

import duckdb
import pytest
from tidewatch.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes)):
        return x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, float) and math.isnan(x):
        return None
    return float(f"{float(x):.9g}")


def same(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert same(df.columns, df.collect()) == same(names, want.fetchall())


def test_long_addresses_are_recorded_in_one_line(spark, tmp_path):
    urls = [None, "", "https://a.example/" + "x" * 39, "https://a.example/" + "x" * 40, "https://a.example/" + "頁" * 500]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = c.execute(registry.ORACLE_SQL["recording_codec"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["recording_codec"](spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    # the smallest stream is too thin for an alert; test_operators.py holds the detector's cases
    assert registry.QUERIES[name](spark, SMALL).count() > 0 or name == "heat_alerts"


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "tidewatch"):
        (tmp_path / name).symlink_to(os.path.join(ROOT, name)) if name.endswith(".py") else None
    copy = tmp_path / "tidewatch"
    copy.mkdir()
    for name in os.listdir(os.path.join(ROOT, "tidewatch")):
        if name not in ("llm", "__pycache__"):
            (copy / name).symlink_to(os.path.join(ROOT, "tidewatch", name))
    (tmp_path / "__spark_entry__.py").unlink()
    with open(os.path.join(ROOT, "__spark_entry__.py")) as f:
        (tmp_path / "__spark_entry__.py").write_text(f.read())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'panel_hot_posts' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "tidewatch")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "tidewatch.llm" not in text.read(), f
