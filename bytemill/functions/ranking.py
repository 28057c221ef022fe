"""Exact ranks without one task for a whole group: count by ranges first, then rank within a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import shared_path


def ranked(rows: DataFrame, group: list[str], bucket: Column, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``rank`` (from 1) and ``n_group`` in each group by ``order``.

    ``bucket`` must not fall as ``order`` rises. The rows of a bucket meet in one task, the buckets' counts of a group
    in another; bounded numbers of buckets keep both small.
    """
    placed = rows.withColumn("bucket_", bucket)
    counts = placed.groupBy(*group, "bucket_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy(*group).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"), F.sum("n_").over(Window.partitionBy(*group)).alias("n_group"))
    local = F.row_number().over(Window.partitionBy(*group, "bucket_").orderBy(*order))
    return placed.join(offsets, [*group, "bucket_"]).withColumn("rank", F.col("before_") + local).drop("bucket_", "before_")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 1) by the columns of ``order``, whatever their values are.

    Spark deals the rows to tasks by sampled splitters, so outliers make no task larger; rows that are equal in ``order``
    are dealt on by a hash of the row. Each task's rows are written with their places, once, and ranks are places after
    the sums of the tasks before. Rows that are equal in all columns are spread by their place in the scan.
    """
    spark = rows.sparkSession
    salts = [F.xxhash64(*rows.columns).alias("salt1_"), F.xxhash64(F.monotonically_increasing_id()).alias("salt2_")]
    dealt = rows.select("*", *salts).repartitionByRange(*order, "salt1_", "salt2_").sortWithinPartitions(*order, "salt1_", "salt2_").drop("salt1_", "salt2_")
    placed = dealt.withColumn("place_", F.monotonically_increasing_id())
    at = shared_path(spark, "numbered")
    placed.withColumns({"part_": F.shiftright("place_", 33), "place_": F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(at)
    placed = spark.read.parquet(at)
    counts = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    offsets = counts.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    return placed.join(F.broadcast(offsets), "part_").withColumn("rank", F.col("before_") + F.col("place_") + 1).drop("part_", "place_", "before_")


def kth_largest(rows: DataFrame, column: str, k: int, ranges: int = 1024) -> int:
    """The ``k``-th largest value of an integer column with ``k`` rows at least: counts of ranges, again and again within the one that holds it."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = -(-(high - low + 1) // ranges)
        inside = rows.filter(F.col(column).between(low, high))
        counts = inside.groupBy(F.expr(f"(CAST(`{column}` AS DECIMAL(38, 0)) - {low}) div {width}").alias("b")).agg(F.count("*").alias("n")).collect()
        for b, n in sorted(((r.b, r.n) for r in counts), reverse=True):
            if k <= n:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            k -= n
    return low


#: A quantile sketch's error is the rows over this at most; a percentile is looked for within MARGIN times that, both ways.
ACCURACY, MARGIN = 10_000, 4


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles by linear interpolation: key, n, mean and a column for each of ``shares``.

    A mergeable sketch of each key gives bounds around each percentile, whatever the values are. A second pass counts
    what lies below the bounds and puts only the distinct values between them in order. Nulls don't count.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    off = MARGIN / ACCURACY
    around = [x for q in shares.values() for x in (max(0.0, q - off), min(1.0, q + off))]
    total = rows.groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile_approx("v", around, ACCURACY).alias("bounds"))
    total = total.withColumnRenamed("k", "key_")
    near = rows.join(total.select("key_", "bounds"), F.col("k").eqNullSafe(F.col("key_"))).drop("key_")
    bound = lambda i: (F.col("bounds")[2 * i], F.col("bounds")[2 * i + 1])
    # A sketch counts in whole rows, so the place may lie one row outside the bounds: the next values are kept too.
    v, each_share = F.col("v"), range(len(shares))
    below = {f"below{i}": F.count_if(v < bound(i)[0]) for i in each_share}
    beside = {f"under{i}": F.max(F.when(v < bound(i)[0], v)) for i in each_share} | {f"over{i}": F.min(F.when(v > bound(i)[1], v)) for i in each_share}
    inside = [v.between(*bound(i)) for i in each_share]
    any_of = inside[0]
    for x in inside[1:]:
        any_of = any_of | x
    # Values outside all bounds are counted at once, others by value: both combine before the shuffle.
    at = F.when(any_of, F.col("v"))
    counts = near.groupBy("k", at.alias("v")).agg(F.count("*").alias("c"), *(x.alias(name) for name, x in (below | beside).items()), F.first("bounds").alias("bounds"))
    merged = {**{c: F.sum(c) for c in below}, **{c: (F.max if c.startswith("under") else F.min)(c) for c in beside}}
    sums = counts.groupBy("k").agg(*(x.alias(c) for c, x in merged.items())).withColumnRenamed("k", "key1_")
    values = counts.filter("v IS NOT NULL").select("k", "v", "c", "bounds")
    each = values.select("k", "v", "c", F.explode(F.array_compact(F.array(*(F.when(x, F.lit(i)) for i, x in enumerate(inside))))).alias("i"))
    running = Window.partitionBy("k", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("upto", F.sum("c").over(running)).groupBy("k", "i").agg(F.array_sort(F.collect_list(F.struct("upto", "v"))).alias("found"))
    wide = each.groupBy("k").pivot("i", list(each_share)).agg(F.first("found")).withColumnRenamed("k", "key2_")
    out = total.join(sums, F.col("key_").eqNullSafe(F.col("key1_"))).join(wide, F.col("key_").eqNullSafe(F.col("key2_")))

    def exact(i: int, q: float) -> Column:
        place = F.lit(q) * (F.col("n") - 1)
        pick = lambda p: F.get(F.filter(F.col(str(i)), lambda x: x["upto"] + F.col(f"below{i}") > p), F.lit(0))["v"]
        first, last = F.floor(place), F.ceil(place)
        n_below, n_upto = F.col(f"below{i}"), F.col(f"below{i}") + F.element_at(F.col(str(i)), -1)["upto"]
        low = F.when(first < n_below, F.col(f"under{i}")).otherwise(pick(first))
        high = F.when(last < n_below, F.col(f"under{i}")).when(last >= n_upto, F.col(f"over{i}")).otherwise(pick(last))
        sure = (first >= n_below - 1) & (first < n_upto) & (last <= n_upto)
        return F.when(sure, low + (high - low) * (place - F.floor(place))).otherwise(F.raise_error(F.lit("a quantile sketch missed its error bound")).cast("double"))

    return out.select(F.col("key_").alias(key), "n", "mean", *(exact(i, q).alias(name) for i, (name, q) in enumerate(shares.items())))
