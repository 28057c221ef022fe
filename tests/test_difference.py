"""Differences of tables by range fingerprints, against a plain comparison of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from bytemill.operators import difference as d

SCHEMA = "id string, x double, t string"


def plain(a, b, tolerance):
    """The same by a loop over all ids."""
    out = []
    group = lambda rows: {i: [r for r in rows if r[0] == i] for i in {r[0] for r in rows}}
    x, y = group(a), group(b)
    nulls = len(x.pop(None, [])), len(y.pop(None, []))
    if sum(nulls):
        out.append((None, "null_id"))
    for i in x.keys() | y.keys():
        if max(len(x.get(i, [])), len(y.get(i, []))) > 1:
            out.append((i, "repeated_id"))
        elif i not in x:
            out.append((i, "missing_id"))
        elif i not in y:
            out.append((i, "extra_id"))
        else:
            (_, u, s), (_, v, t) = x[i][0], y[i][0]
            if u is None or v is None or u != u or v != v or abs(u - v) > tolerance:
                out.append((i, "x"))
            if (s or "") != (t or ""):
                out.append((i, "t"))
    return sorted(out, key=str)


@pytest.mark.parametrize("few_rows, most_ranges", [(100_000, 1 << 16), (3, 1 << 22), (3, 1)])
def test_against_a_loop(spark, monkeypatch, few_rows, most_ranges):
    """Nulls, NaN, tolerances, repeated and missing ids; with one level of ranges, several, and too many to hold."""
    monkeypatch.setattr(d, "FEW_ROWS", few_rows)
    monkeypatch.setattr(d, "MOST_RANGES", most_ranges)
    draw = random.Random(5)
    a = [(f"k{i}", i / 8, draw.choice(["", "one", None, "é"])) for i in range(4000)]
    b = [list(r) for r in a if draw.random() > 0.002]
    for r in draw.sample(b, 60):
        place = draw.choice([0, 1, 1, 2])
        r[place] = [draw.choice([None, "k7", "new"]), draw.choice([None, float("nan"), r[1] + 1e-9, r[1] + 1]), "other"][place]
    b = [tuple(r) for r in b]
    got = d.table_difference(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "id", {"x": 1e-6}, ("t",))
    assert sorted(((r.id, r.column) for r in got.collect()), key=str) == plain(a, b, 1e-6) != []


def test_equal_tables_are_not_joined(spark, monkeypatch):
    """One comparison of fingerprints, no rows of the tables, also in another order and of other types."""
    calls = []
    monkeypatch.setattr(d, "_by_id", lambda *a: calls.append(a))
    unlike = d._unlike
    monkeypatch.setattr(d, "_unlike", lambda *a: (calls.append("fingerprints"), unlike(*a))[1])
    a = spark.range(5000).select(F.col("id"), (F.col("id") / 4).alias("x"), F.lit(None).cast("string").alias("t"))
    b = a.orderBy(F.desc("id")).select(F.col("id").cast("string").alias("id"), "x", F.lit("").alias("t"))
    assert d.table_difference(a, b, "id", {"x": 0.0}, ("t",)).count() == 0 and calls == ["fingerprints"]
    assert d.table_difference(a.limit(0), b.limit(0), "id", {"x": 0.0}).count() == 0


def test_fingerprints_combine_before_the_shuffle(spark):
    rows = d._comparable(spark.range(10).withColumn("x", F.lit(1.0)), "id", {"x": 0.0}, (), "a")
    plan = d.fingerprints(rows, 12)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_dataset_verification_raises_on_other_columns(spark):
    sources = {name: spark.createDataFrame([], ", ".join(f"{c} string" for c in columns)) for name, columns in d.SOURCES.items()}
    good = spark.createDataFrame([], ", ".join(f"{c} string" for c in d.DATASET))
    assert d.verify_dataset(good, sources).count() == 0
    with pytest.raises(ValueError, match="columns must be"):
        d.verify_dataset(good.drop("mask"), sources)
    with pytest.raises(ValueError, match="quality lacks"):
        d.verify_dataset(good, sources | {"quality": good.select("id")})


def test_sources_must_hold_the_same_ids(spark):
    base = spark.createDataFrame([(str(i), i % 9 + 1, "train", "h", "i", "m", 0.5, "normal") for i in range(5)], "id string, class int, split string, head_image string, image string, mask string, unknown_ratio double, quality string")
    sources = {name: base.select(*columns) for name, columns in d.SOURCES.items()}
    sources["quality"] = sources["quality"].filter("id <> '3'")
    rows = d.verify_dataset(base.select(*d.DATASET), sources).collect()
    assert sorted((r.source, r.id, r.column) for r in rows) == [("dataset", "3", "extra_id"), ("quality", "3", "missing_id")]
