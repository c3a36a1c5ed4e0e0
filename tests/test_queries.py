"""Registered queries against their SQL in DuckDB, over the smallest driver tables."""

from __future__ import annotations

import json
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ruleframe.queries import operators, rules

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables")
NAMES = sorted((rules.SQL | operators.SQL).keys())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v).replace(" 00:00:00", "")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_dirty_numbers_tells_nan_from_null(spark, tmp_path):
    """Against its SQL over readings that are not finite or no number, which the smallest tables do not hold."""
    texts = ["NaN", " nan", "inf", "-Infinity", "1e999", "106", "-3", "5d", "98.6F", "0x1p3", "1e1", "", None]
    readings = [(e, (texts[e % 13], texts[e // 13], "90")[i], i) for e in range(169) for i in range(3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE eadv (eid BIGINT, att VARCHAR, dt TIMESTAMP, val VARCHAR, loc BIGINT)")
    con.executemany("INSERT INTO eadv VALUES (?, 'lab_bld_creat', TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * ?, ?, NULL)", [(e, i, v) for e, v, i in readings])
    con.execute(f"COPY eadv TO '{tmp_path}/eadv.parquet' (FORMAT parquet)")
    df = entry.queries()["dirty_numbers"](spark, str(tmp_path))
    cursor = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['dirty_numbers']})")
    exact = lambda data: sorted(tuple(repr(round(x, 6)) if isinstance(x, float) and abs(x) < 1e300 else repr(x) for x in r) for r in data)
    assert exact(df.collect()) == exact(cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "eid" and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p1_wide", "p4_features", "p5_found", "p5_kinds"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_all_programs_run(spark, duck):
    """Every active block that the manifest lists has one row per entity."""
    df = entry.queries()["program_all"](spark, FOLDER)
    found = {r.name.lower(): r for r in df.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("eid").alias("eids"), F.first("row").alias("row")).collect()}
    manifest = {name for (name,) in duck.execute("SELECT lower(ruleblockId) FROM manifest_entries").fetchall()}
    entities = duck.execute("SELECT count(DISTINCT eid) FROM eadv").fetchone()[0]
    assert set(found) == manifest
    assert {(r.n, r.eids) for r in found.values()} == {(entities, entities)}
    assert all("eid" in json.loads(r.row) for r in found.values())
