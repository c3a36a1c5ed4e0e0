from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


EADV = "rid long, eid long, att string, dt timestamp_ntz, val string, loc long, loaded_ts timestamp_ntz"
CATALOG = "att string, data_type string, unit string, phys_low double, phys_high double, since_dt date"


@pytest.fixture(scope="session")
def catalog(spark):
    rows = [
        ("lab_k", "NUMERIC", "mmol/L", 0.5, 30.0, None), ("lab_free", "NUMERIC", "U/L", None, None, None), ("enc_n", "NUMERIC", None, None, None, None),
        ("set_x", "NUMERIC", "s", None, None, None), ("dx_a", "BOOLEAN", None, None, None, None), ("dmg_d", "DATE", None, None, None, None), ("note", "TEXT", None, None, None, None),
    ]
    return spark.createDataFrame(rows, CATALOG)
