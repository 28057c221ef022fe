"""One small Spark session for all tests, and the comparison of a query with its DuckDB equivalent."""

import datetime
import math
import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    at = tempfile.mkdtemp(prefix="spark-")
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g",
        "spark.local.dir": at,
        "spark.sql.warehouse.dir": f"{at}/warehouse",
        "spark.checkpoint.dir": f"{at}/checkpoints",
    }
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(map(_plain, x))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def _sorted(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compare a query's rows with those of its SQL over the tables of a folder, by column name and value."""

    def compare(query, sql, sf_dir=f"{DATA}/sf0.001"):
        db = duckdb.connect()
        db.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                at = f"{sf_dir}/{t}.parquet"
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
        want = db.execute(sql)
        names = [c[0] for c in want.description]
        expected = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
        out = query(spark, sf_dir)
        assert sorted(out.columns) == sorted(names)
        columns = sorted(names)
        got = [tuple(_plain(r[c]) for c in columns) for r in out.collect()]
        expected = [tuple(_plain(r[c]) for c in columns) for r in expected]
        assert len(got) == len(expected)
        diff = [(a, b) for a, b in zip(_sorted(got), _sorted(expected), strict=True) if a != b]
        assert not diff, f"{len(diff)} of {len(got)} rows differ, such as {diff[0]} ({columns})"
        return got

    return compare
