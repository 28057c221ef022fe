"""Whole sizes in proportion to counts, by largest remainders, in integers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_remainders(counts: DataFrame, key: str, count: str, total: Column, draws: Column, out: str) -> DataFrame:
    """``counts`` (one row a class) with ``out``: ``draws`` of ``total`` shared by count; what floors leave goes to the largest
    remainders, ties to the smaller key. Both columns must be the same in all rows; the windows run over classes only."""
    every = Window.partitionBy()
    places = counts.withColumns({"whole_": F.try_divide(F.col(count) * draws - (F.col(count) * draws) % total, total).cast("long"), "rest_": (F.col(count) * draws) % total, "draws_": draws})
    places = places.withColumn("left_", F.col("draws_") - F.sum("whole_").over(every)).withColumn("rank_", F.row_number().over(Window.orderBy(F.desc("rest_"), key)))
    more = (F.col("rank_") <= F.col("left_")).cast("long")
    return places.withColumn(out, F.coalesce(F.col("whole_") + more, F.lit(0)).cast("long")).drop("whole_", "rest_", "draws_", "left_", "rank_")


def split_sizes(counts: DataFrame, key: str = "class", count: str = "n", held: float = 0.3, test: float = 0.5) -> DataFrame:
    """``counts`` with n_train and n_val of each class; the rest is for testing.

    A share ``held`` of all rows, rounded up, is held out of training; a share ``test`` of these, rounded up, is for
    testing. Both steps share by the class counts that they find.
    """
    every = Window.partitionBy()
    total = counts.withColumn("n_", F.sum(count).over(every)).withColumn("held_", F.ceil(F.lit(held) * F.col("n_")))
    train = largest_remainders(total, key, count, F.greatest(F.col("n_"), F.lit(1)), F.col("n_") - F.col("held_"), "n_train")
    rest = train.withColumn("rest", F.col(count) - F.col("n_train"))
    val = largest_remainders(rest, key, "rest", F.greatest(F.col("held_"), F.lit(1)), F.col("held_") - F.ceil(F.lit(test) * F.col("held_")), "n_val")
    return val.drop("n_", "held_", "rest")
