"""Pluggable measures against numpy, and nested reports leaf by leaf."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytemill.functions.measures import IMAGES, MOMENTS, RANGE, Measure, measure
from bytemill.operators import collection as c


def test_measures_in_one_pass(spark):
    """Built-in measures and one of the test's own, over random, empty and missing samples, in any number of tasks."""
    rng = np.random.default_rng(2)
    raw = [rng.integers(3, 250, n).astype(np.uint8).tobytes() for n in rng.integers(0, 60, 300)] + [b"", None, b"\x00" * 9, b"\x07" * 5]
    rows = spark.createDataFrame([(x,) for x in raw], "data binary").repartition(7)
    longest = Measure(lambda d, k, o: [int(np.diff(o).max())], lambda a, b: [max(a[0], b[0])], lambda s: {"longest": s and s[0]})
    got = measure(c.binary_samples(rows, "data"), {"moments": MOMENTS, "range": RANGE, "images": IMAGES, "longest": longest})
    every = np.frombuffer(b"".join(x or b"" for x in raw), np.uint8).astype(float)
    assert np.isclose(got["pixel_mean"], every.mean()) and np.isclose(got["pixel_std"], every.std()) and got["zero_pixel_ratio"] == (every == 0).mean()
    assert (got["pixel_min"], got["pixel_max"], got["longest"]) == (0, every.max(), max(len(x or b"") for x in raw))
    assert got["images"] == len(raw) and got["constant_images"] == sum(len(set(x or b"")) == 1 for x in raw) and got["all_black_images"] == sum(set(x or b"") == {0} for x in raw)
    none = measure(c.binary_samples(rows.limit(0), "data"), {"moments": MOMENTS, "range": RANGE, "images": IMAGES})
    assert none == {"pixel_mean": None, "pixel_std": None, "zero_pixel_ratio": None, "pixel_min": None, "pixel_max": None, "images": 0, "constant_images": 0, "all_black_images": 0}


def leaves(x, path=""):
    if isinstance(x, dict) and x:
        return [leaf for k, v in x.items() for leaf in leaves(v, f"{path}.{k}" if path else k)]
    if isinstance(x, list) and x:
        return [leaf for i, v in enumerate(x) for leaf in leaves(v, f"{path}[{i}]")]
    return [path]


def test_leaves_of_nested_reports(spark):
    report = {"a": 1, "b": {"c": [1, 2.5, {"d": None}], "e": {}, "f": []}, "g": True, "h": "é", "i": {"j": {"k": {"l": [[["deep"]]]}}}}
    rows = spark.createDataFrame([(json.dumps(report),)], "json string").select(F.parse_json("json").alias("v"))
    got = {r.path: r.value for r in c.flattened(rows, "v").collect()}
    assert sorted(got) == sorted(leaves(report))
    assert got["b.c[1]"] == "2.5" and got["b.e"] == "{}" and got["b.f"] == "[]" and got["g"] == "true" and got["h"] == "é" and got["i.j.k.l[0][0][0]"] == "deep"


def same(spark, stored, computed, tolerances=None):
    sides = [spark.createDataFrame([(json.dumps(x),)], "json string") for x in (stored, computed)]
    return {r.pair: r.same for r in c.compare_reports(*sides, tolerances or {"q.x": 0.5}).collect()}


def test_pairs_of_reports(spark):
    """Numbers by value, other leaves by kind; tolerances for single pairs; whole blocks as one pair."""
    a = {"n": 1, "t": "1", "q": {"x": 1.0, "y": 1.0, "gone": 1, "list": [1, 2], "block": {"u": 1, "v": {"w": 2}}}, "z": None}
    b = {"n": 1.0, "t": 1, "q": {"x": 1.4, "y": 1.4, "list": [2, 1], "block": {"u": 1, "v": {"w": 3}}}, "z": None, "new": 0}
    assert same(spark, a, b) == {"n": True, "t": False, "q.x": True, "q.y": False, "q.gone": False, "q.list": False, "q.block": False, "z": True, "new": False}
    assert set(same(spark, a, a).values()) == {True}


def test_nesting_has_a_limit(spark):
    deep = 1
    for _ in range(c.DEPTH + 2):
        deep = {"x": deep}
    rows = spark.createDataFrame([(json.dumps(deep),)], "json string").select(F.parse_json("json").alias("v"))
    with pytest.raises(Exception, match="nested too deeply"):
        c.flattened(rows, "v").collect()
