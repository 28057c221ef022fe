"""Real deletes and ids of the history table: files, failures, replays and restarts."""

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytemill.functions import ranking
from bytemill.operators import retention
from bytemill.operators.retention import HistoryTable

DAY = datetime.datetime(2024, 5, 1)


def rows(spark, n, days=4, first=0):
    made = [(DAY + datetime.timedelta(hours=(24 * days * i) // n), f"f{first + i}") for i in range(n)]
    return spark.createDataFrame(made, "ts timestamp_ntz, family string")


def files(table):
    return {os.path.join(d, f) for d, _, names in os.walk(table.path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    made = HistoryTable(spark, str(tmp_path / "history"))
    assert made.append(rows(spark, 40)) == 40 and made.append(rows(spark, 8, first=40)) == 8
    return made


def test_whole_days_go_without_reading(table, spark):
    before = files(table)
    assert table.plan_before(DAY + datetime.timedelta(days=2)) == (24, 24)
    table_rows = table._rows
    table._rows = lambda *a: pytest.fail("no row needs to be read")
    assert table.delete_before(DAY + datetime.timedelta(days=2)) == 24
    table._rows = table_rows
    assert files(table) < before and {r.id for r in table.read().collect()} == {*range(21, 41), *range(45, 49)}


def test_only_the_border_day_is_rewritten(table, spark):
    before = files(table)
    cutoff = DAY + datetime.timedelta(days=1, hours=12)
    want = sorted(r.id for r in table.read().collect() if r.ts >= cutoff)
    assert table.plan_before(cutoff) == (48 - len(want), len(want))
    table.delete_before(cutoff)
    kept = {f for f in before if "day=2024-05-03" in f or "day=2024-05-04" in f}
    assert kept < files(table) and not files(table) & (before - kept)
    assert sorted(r.id for r in table.read().collect()) == want


def test_newest_and_all(table, spark):
    assert table.keep_newest(100) == 0 and table.keep_newest(10) == 38
    assert sorted(r.id for r in table.read().collect()) == list(range(39, 49))
    assert table.clear() == 10 and table.read().count() == 0 and not files(table)
    assert table.append(rows(spark, 2)) == 2 and sorted(r.id for r in table.read().collect()) == [49, 50]
    with pytest.raises(ValueError):
        table.keep_newest(-1)
    with pytest.raises(ValueError, match="other columns"):
        table.append(rows(spark, 2).withColumn("more", F.lit(1)))


def test_a_failed_run_leaves_the_old_state(table, spark, monkeypatch):
    want = sorted(map(tuple, table.read().collect()))

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(retention, "write_report", fails)
    for change in (lambda: table.delete_before(DAY + datetime.timedelta(hours=30)), lambda: table.append(rows(spark, 5)), table.clear):
        with pytest.raises(RuntimeError):
            change()
        assert sorted(map(tuple, table.read().collect())) == want


def test_rows_without_a_time(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "t"))
    assert table.read().count() == 0 if table.state()["schema"] else table.append(rows(spark, 3, 1).limit(0)) == 0
    table.append(rows(spark, 3, 1).unionByName(spark.createDataFrame([(None, "none")], "ts timestamp_ntz, family string")))
    assert table.delete_before(DAY + datetime.timedelta(days=9)) == 3
    assert [r.family for r in table.read().collect()] == ["none"]


def test_restarts_between_write_and_commit(spark, tmp_path, monkeypatch):
    """A stream that fails after writing a batch, and one that is replayed after its commit: no gap, no repeat."""
    table, source, checkpoint = HistoryTable(spark, str(tmp_path / "h")), str(tmp_path / "in"), str(tmp_path / "c")
    rows(spark, 20).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("ts timestamp_ntz, family string").parquet(source)
    report, failures = retention.write_report, [1, 1]

    def sometimes(*a):
        if failures:
            failures.pop()
            raise RuntimeError("lost")
        report(*a)

    monkeypatch.setattr(retention, "write_report", sometimes)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            table.follow(stream(), checkpoint).awaitTermination()
    table.follow(stream(), checkpoint).awaitTermination()
    rows(spark, 10, first=20).coalesce(1).write.mode("append").parquet(source)
    table.follow(stream(), checkpoint).awaitTermination()
    assert sorted(r.id for r in table.read().collect()) == list(range(1, 31))
    name, last = next(iter(table.state()["batches"].items()))
    assert table.append(rows(spark, 10), name, last) == 0 and table.read().count() == 30
    table.follow(stream(), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.id for r in table.read().collect()) == list(range(1, 61)), "another stream has its own numbers"


def test_numbers_under_skew(spark):
    """An outlier, half of the rows equal, rows equal in all columns: ranks are exact, and no task is much larger than others."""
    values = [10**12] + [7] * 5000 + list(range(5000))
    made = spark.createDataFrame([(v,) for v in values], "v long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        out = ranking.numbered(made, ["v"])
        sizes = [r["count"] for r in spark.read.parquet(*out.inputFiles()).groupBy("part_").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.v for r in out.orderBy("rank").collect()] == sorted(values)
    assert sorted(r.rank for r in out.collect()) == list(range(1, len(values) + 1))
    assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]
    assert ranking.numbered(made.limit(0), ["v"]).count() == 0


def test_kth_largest(spark):
    values = [-(2**62), *range(100), 5, 5, 10**15, 2**62]
    made = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 3, 50, 97, 98, 99, len(values)):
        assert ranking.kth_largest(made, "v", k, ranges=10) == sorted(values, reverse=True)[k - 1]


def test_percentiles_under_skew(spark):
    """Outliers, half of the values equal, groups of one: what sorting gives."""
    rng = np.random.default_rng(6)
    data = {"a": [1e12, *rng.normal(size=3000)], "b": [7.0] * 3000 + list(rng.normal(size=3000)), "c": [-5.0], "d": list(rng.permutation(5000) ** 3.0), None: [1.0, 2.0]}
    made = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("a", None)], "k string, v double").repartition(8)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    out = ranking.percentiles(made, "k", "v", shares)
    got = {r.k: r for r in out.collect()}
    for k, x in data.items():
        assert got[k].n == len(x)
        for name, q in shares.items():
            assert np.isclose(got[k][name], np.percentile(x, 100 * q), rtol=1e-12), (k, name)
    assert ranking.percentiles(made.limit(0), "k", "v", shares).count() == 0
