import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


SMALL = "/root/testdata/sf0.001"


def plain(value):
    """A value in a form in which Spark's and DuckDB's results compare."""
    if hasattr(value, "asDict"):
        value = list(value.asDict().values())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return [plain(v) for v in value.values()]
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if type(value).__name__ == "Decimal":
        return round(float(value), 9)
    return str(value)[:26] if hasattr(value, "isoformat") else value


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())


def duck_rows(sql, folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    found = con.sql(sql)
    cols = sorted(found.columns)
    at = [found.columns.index(c) for c in cols]
    return cols, sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
