"""Epoch permutations, row numbers, batches without a seed, and split sizes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from bytemill.functions.apportion import split_sizes
from bytemill.operators import datasets


def test_every_epoch_is_a_permutation(spark):
    """All sizes up to 200, some larger ones: every place once, other orders for other epochs and seeds."""
    for n in [*range(1, 201, 7), 2, 3, 4, 997, 2000]:
        out = spark.range(n).select(*(datasets.epoch_place(F.col("id"), n, s, e).alias(f"p{s}{e}") for s, e in ((1, 0), (1, 1), (2, 0)))).collect()
        orders = [[r[i] for r in out] for i in range(3)]
        assert all(sorted(o) == list(range(n)) for o in orders), n
        assert n < 30 or len({tuple(o) for o in orders}) == 3
    spread = [r[0] for r in spark.range(2000).select(datasets.epoch_place(F.col("id"), 2000, 5, 3)).collect()]
    assert abs(sum(a < b for a, b in zip(spread, spread[1:], strict=False)) / 1999 - 0.5) < 0.1
    big = 10**15
    assert all(0 <= r[0] < big for r in spark.range(big - 50, big).select(datasets.epoch_place(F.col("id"), big, 5, 3)).collect())
    with pytest.raises(Exception, match="row number"):
        spark.range(5).select(datasets.epoch_place(F.col("id"), 4, 1, 0)).collect()


def test_epochs_need_no_shuffle(spark):
    plan = datasets.epoch_batches(spark.range(100), "id", 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_row_numbers(spark, tmp_path):
    """Dense numbers over several files, one of them empty, however the files are cut into tasks."""
    spark.range(1000).repartition(5).write.parquet(str(tmp_path / "t"))
    spark.range(0).write.mode("append").parquet(str(tmp_path / "t"))
    rows, n = datasets.row_numbers(spark.read.parquet(str(tmp_path / "t")))
    assert n == 1000 and sorted(r.number for r in rows.collect()) == list(range(1000))
    again = {r.id: r.number for r in datasets.row_numbers(spark.read.parquet(str(tmp_path / "t")))[0].collect()}
    assert again == {r.id: r.number for r in rows.collect()}


def test_batches_without_a_seed(spark):
    """Ids with one beginning: in the order of their texts, in batches of equal size."""
    ids = [f"sample_{i:06d}" for i in range(300)]
    rows = spark.createDataFrame([(i, 3) for i in random.Random(1).sample(ids, len(ids))], "id string, class int")
    out = {r.id: r.batch for r in datasets.batches(rows, "id", "class", 32).collect()}
    assert out == {i: k // 32 for k, i in enumerate(ids)}


def remainders(counts, draws):
    """Shares of ``draws`` by largest remainders, in fractions."""
    total = sum(counts)
    whole = [c * draws // total for c in counts]
    order = sorted(range(len(counts)), key=lambda i: (-(counts[i] * draws % total), i))
    for i in order[: draws - sum(whole)]:
        whole[i] += 1
    return whole


def test_split_sizes(spark):
    """Random class counts: both steps' totals, and each class within one of its share."""
    draw = random.Random(9)
    for _ in range(12):
        counts = [draw.randint(2, 60) for _ in range(draw.randint(1, 9))]
        got = sorted(map(tuple, split_sizes(spark.createDataFrame(list(enumerate(counts)), "class int, n long")).select("class", "n_train", "n_val").collect()))
        held = math.ceil(0.3 * sum(counts))
        train = remainders(counts, sum(counts) - held)
        rest = [c - t for c, t in zip(counts, train, strict=True)]
        assert [r[1] for r in got] == train and [r[2] for r in got] == remainders(rest, held - math.ceil(0.5 * held))
    assert split_sizes(spark.createDataFrame([], "class int, n long")).count() == 0
