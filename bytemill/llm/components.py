"""Connected components, and pairs of bounded tiles of rows for all-pairs comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component's id is its smallest node.

    Alternates large-star and small-star steps (each a min per node and a join, so hot nodes are combined map-side and
    split by AQE) until the edges are stars. A node without edges has no row.
    """
    spark = edges.sparkSession
    at, step, seen = scratch(spark, "components"), 0, None
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, f"{at}/0")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step += 1
        e = written(down.unionByName(low.withColumnRenamed("m", "v")).distinct(), f"{at}/{step}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, f"{at}/{step - 1}")
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def local_components(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest row number that each row reaches."""
    n = len(linked)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        reached = np.zeros(n, bool)
        reached[i] = True
        frontier = np.array([i])
        while len(frontier):
            new = linked[frontier].any(axis=0) & ~reached
            reached |= new
            frontier = np.flatnonzero(new)
        label[reached] = i
    return label


def tile_pairs(rows: DataFrame, key: str, tile: int, weight: tuple[str, int] | None = None, boxes: tuple[str, ...] = ()) -> DataFrame:
    """Deal rows to pairs of tiles, so that all rows of equal ``key`` whose cells differ by 1 at most meet once.

    ``rows`` have columns ``key``, cell (long), open (boolean) and id (long). Rows of one key and cell are cut into tiles
    of about ``tile`` rows by a hash of their id, or of a sum of about so much of a column (``weight``: its name and the
    sum); two tiles are paired unless both hold rows that are not open. With ``boxes``, columns that differ by 1 at most
    in rows that must meet, tiles take rows in the order of these, and tiles whose ranges lie further apart aren't paired. The result has ``key``, the pair's ``pair`` struct, ``side`` (0 or 1; a tile paired with itself comes once,
    with side 0) and the columns of ``rows``. Only the table of tiles is joined with itself, on equal keys.
    """
    group = [key, "cell", "open", *boxes]
    parts = F.count("*") / tile if weight is None else F.greatest(F.count("*") / tile, F.sum(weight[0]) / weight[1])
    counts = rows.groupBy(*group).agg(parts.alias("parts"))
    # Groups of equal boxes, in their order, fill tiles; the window runs over their counts only.
    before = Window.partitionBy(*group[:3]).orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.withColumns({"bin": F.floor(F.coalesce(F.sum("parts").over(before), F.lit(0.0))), "tiles": F.ceil("parts")}).drop("parts")
    rows = rows.join(bins, group).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles"))).drop("tiles")
    tiles = bins.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    place = ["cell", "open", "bin", "t"]
    tiles = tiles.groupBy(key, *place).agg(*(f(b).alias(f"{b}_{n}") for b in boxes for n, f in (("lo", F.min), ("hi", F.max))), F.lit(0).alias("_"))
    inside = [f"{b}_{n}" for b in boxes for n in ("lo", "hi")]
    left = tiles.select(key, F.struct(*place).alias("x"), *(F.col(c).alias(f"x_{c}") for c in inside), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("near"))
    right = tiles.select(key, F.col("cell").alias("near"), F.struct(*place).alias("y"), *(F.col(c).alias(f"y_{c}") for c in inside))
    pairs = left.join(right, [key, "near"]).filter("x.open OR y.open")
    pairs = pairs.filter((F.col("x.cell") < F.col("y.cell")) | (F.col("x") <= F.col("y")))
    for b in boxes:
        pairs = pairs.filter((F.col(f"x_{b}_lo") <= F.col(f"y_{b}_hi") + 1) & (F.col(f"y_{b}_lo") <= F.col(f"x_{b}_hi") + 1))
    pairs = pairs.withColumn("side", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    at = F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("y"))
    pairs = pairs.select(key, F.struct("x", "y").alias("pair"), "side", *(at[c].alias(c) for c in place))
    return pairs.join(rows, [key, *place]).drop(*place)
