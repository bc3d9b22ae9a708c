from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import compare
import duckdb
import pytest

import __spark_entry__
from sparkloom.catalog import ORACLES, QUERIES
from sparkloom.sources.files import list_files


@pytest.fixture(scope="module")
def duck(sf):
    return compare.views(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got.columns) and len(got)
    if name in ORACLES:
        compare.same(got, duck.sql(ORACLES[name]).df())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["c_custkey", "label", "n_orders", "largest"] and df.count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_reads_the_columns_that_are_used(spark, sf):
    plan = QUERIES["flagship"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan and "o_orderdate" not in plan


def test_core_queries_load_without_what_the_others_import():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__spark_entry__.__file__).parent, timeout=120, check=True)
    assert got.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]


def test_single_flight_rounds_halves_as_sql_does(spark, tmp_path):
    # calls of each key start together, or half a second or more apart; one start, one value and a key are null
    values = "12.5, 0, 0.5, 1.5, 2.5, 2.5, 3.5, -0.5, -1.5, -2.5, NULL, 499.5, 500.5, 1e15, 0.49999999999999994, 20.5"
    events = f"""SELECT row_number() OVER () AS event_id, v AS value, CASE WHEN t <> 25 THEN 'k' || t END AS event_type, t AS user_id, '{{}}' AS props,
        CASE WHEN i <> 9 THEN TIMESTAMP '1970-01-01' + to_milliseconds((i - 3) * t * 500) END AS ts FROM (SELECT unnest([{values}]::DOUBLE[]) AS v, unnest(range(16)) AS i), (SELECT unnest([0, 1, 2, 3, 4, 5, 25, 41]) AS t)"""
    duckdb.sql(f"COPY ({events}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    compare.same(QUERIES["single_flight"](spark, str(tmp_path)).toPandas(), duck.sql(ORACLES["single_flight"]).df())


def test_scan_files_counts_a_table_in_parts_as_one(spark, sf, tmp_path):
    top = tmp_path / "a b%20é"
    shutil.copytree(sf, top, copy_function=shutil.copyfile)
    top.chmod(0o755)
    for name, parts in {"documents": ["part-0000.parquet", "part-0001.parquet"], "labels": ["k=1/part-0000", "k=2/x.parquet/part-0000", "_SUCCESS"], "pages": ["pages.parquet"]}.items():
        (whole := top / f"{name}.parquet").rename(top / "whole")
        for p in parts:
            (whole / p).parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(top / "whole", whole / p)
        (top / "whole").unlink()
    (top / "old").mkdir()
    shutil.copyfile(top / "nation.parquet", top / "old/nation.parquet")
    (top / "notes.md").write_text("x")
    want = duckdb.sql(ORACLES["scan_files"]).df()
    for d in (str(top), f"{top}/", f"file://{tmp_path}/../{tmp_path.name}/{top.name}"):
        compare.same(QUERIES["scan_files"](spark, d).toPandas(), want)
    size = lambda n: Path(sf, n).stat().st_size
    got = {r.name: r.bytes for r in list_files(spark, str(top)).collect()}
    assert len(got) == 16 and got["old"] == got["nation.parquet"] == size("nation.parquet") and got["notes.md"] == 1
    assert got["documents.parquet"] == 2 * size("documents.parquet") and got["labels.parquet"] == 2 * size("labels.parquet")
    assert list_files(spark, str(top), "*.txt").count() == 0
