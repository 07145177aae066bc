import glob
import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

REPO = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query's rows against its SQL's, as multisets of rows with columns by name."""

    def check(query, sql):
        df = query(spark, SMALL)
        names = sorted(df.columns)
        cursor = duck.execute(sql)
        at = [d[0] for d in cursor.description]
        assert sorted(at) == names
        ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
        theirs = sorted((tuple(plain(r[at.index(n)]) for n in names) for r in cursor.fetchall()), key=repr)
        assert ours == theirs

    return check
