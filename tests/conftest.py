import os
import tempfile

import pytest

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}").config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return os.path.join(DATA, "sf0.001")


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def plain(rows):
    """Rows as sorted texts, doubles to nine digits."""
    return sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def same():
    def check(con, sql, df):
        cols = sorted(df.columns)
        found = con.sql(sql)
        assert sorted(found.columns) == cols
        assert plain(df.select(*cols).collect()) == plain(found.select(*(f'"{c}"' for c in cols)).fetchall())

    return check
