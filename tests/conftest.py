import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a registered query and its SQL over the smallest tables and compares the rows."""
    import decimal
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SMALL}/{f}')")

    def plain(v):
        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 9)
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    def check(query, sql):
        df = query(spark, SMALL)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
        want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=str)
        assert got == want

    return check
