"""Mixing sources to target weights by pivotal dependent rounding.

A source's target, divided by its words, is the number of copies that each of its documents should get on average. The
whole part is given to all; the fractional rest becomes whole by pivotal steps: two documents exchange expected words,
at random but without changing their sum, until the copies of one are whole and the other meets the next. Documents are dealt by hash to leaves of
bounded size; what a leaf leaves over (one document at most) meets the rest of other leaves one level up, until one
document of each source remains, which is rounded to the nearest whole. A source's taken words therefore differ from
its target by half of one document at most, and each document's expected copies stay as they were.

Null and empty texts have size 0 and are taken 0 times. A null source is a source of its own, ranked last. Rows that
repeat a doc_id are mixed each by itself. An empty table gives an empty result. Reruns agree, however rows are
partitioned, since the random numbers come from doc_ids and a seed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, mix

#: Documents of a leaf, about; children of an inner node.
LEAF, FANOUT = 4096, 64


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row for each source: rank, number of documents, size and target in words.

    The sources share ``share`` times all words by weight; a target over ``most`` times its source's size stops there
    and the excess is shared again by weight, until none is above: targets are min(most * size, level * weight), and
    each round raises the level by what the sources that stop leave over. Sources are ranked by ranges, so no task holds
    them all, however many there are.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).withColumn("last", F.col("source").isNull())
    ordered = by_source.repartitionByRange("last", "source").sortWithinPartitions("last", "source").withColumn("part", F.spark_partition_id())
    ordered = checkpointed(ordered)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    ranked = ordered.join(parts, "part").withColumn("rank", F.col("before") + local)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = checkpointed(ranked.select("source", "rank", "n_docs", "source_size", weight.alias("w"), (most * F.col("source_size").cast("double")).alias("cap")))
    words, open_ = rows.agg(F.sum("source_size"), F.sum("w")).first()
    total, stopped, level = share * (words or 0), -1, None
    left = total
    while open_:
        level = left / open_
        stops = F.col("cap") <= level * F.col("w")
        n, filled, open_ = rows.agg(F.count_if(stops), F.sum(F.when(stops, F.col("cap"))), F.sum(F.when(~stops, F.col("w")))).first()
        if n == stopped:
            break
        stopped, left = n, total - (filled or 0.0)
    target = F.least("cap", F.lit(level) * F.col("w")) if open_ else F.col("cap")
    return rows.select("source", "rank", "n_docs", "source_size", target.alias("target"))


def _units(order: np.ndarray, seed: int) -> np.ndarray:
    """Random numbers in [0, 1) that depend on the rows' hashes, their places among equal ones and the seed only."""
    place = np.zeros(len(order), np.int64)
    same = np.flatnonzero(np.append(False, order[1:] == order[:-1]))
    for i in same:
        place[i] = place[i - 1] + 1
    x = mix(order.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & 0xFFFFFFFF))
    return (mix(x + place.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(size: list[float], part: list[float], unit: list[float]) -> list[float]:
    """Pivotal steps: the open document meets the next one until the copies of one of the two are whole.

    The two exchange expected words, so that their sum stays; which of the two outcomes comes is drawn so that each
    one's expected copies stay. One document at most is left with a fractional part.
    """
    part, open_ = list(part), -1
    for b, (n, p) in enumerate(zip(size, part, strict=True)):
        if p <= 0 or p >= 1:
            continue
        if open_ < 0:
            open_ = b
            continue
        a = open_
        m, q = size[a], part[a]
        full_a, full_b, has_a, has_b = (1 - q) * m, (1 - p) * n, q * m, p * n
        to_a, to_b = min(full_a, has_b), min(has_a, full_b)
        if unit[b] * (to_a + to_b) < to_b:
            first, second = (1.0, p - to_a / n) if full_a <= has_b else (q + to_a / m, 0.0)
        else:
            first, second = (0.0, p + to_b / n) if has_a <= full_b else (q - to_b / m, 1.0)
        part[a], part[b] = min(max(first, 0.0), 1.0), min(max(second, 0.0), 1.0)
        open_ = a if 0 < part[a] < 1 else b if 0 < part[b] < 1 else -1
    return part


def _settle(group: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Pivotal steps along one node's documents, largest first, so that what is left over is a small one."""
    group = group.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
    units = _units(group["order"].to_numpy(np.int64), seed)
    group["part"] = pivot(group["size"].astype(float).tolist(), group["part"].tolist(), units.tolist())
    return group


def _settler(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda group: _settle(group, seed)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken (size times copies)."""
    sized = checkpointed(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")))
    targets = checkpointed(source_targets(sized, weights, share, most))
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    rows = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    want = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    order = F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("long")), F.lit(seed), "size")
    leaves = F.ceil(F.col("n_docs") / LEAF)
    rows = rows.withColumns({"whole": F.floor(want), "part": F.when(F.col("size") > 0, want - F.floor(want)).otherwise(0.0), "order": order})
    rows = rows.withColumn("node", F.pmod(F.col("order"), leaves)).drop("n_docs")
    levels = 1 + (math.ceil(math.log(max(1, math.ceil(largest / LEAF)), FANOUT) - 1e-9) if largest > LEAF else 0)
    settled, left = rows.filter("part <= 0 OR part >= 1"), rows.filter("part > 0 AND part < 1")
    for level in range(levels):
        step = checkpointed(left.groupBy("rank", "node").applyInPandas(_settler(seed + level), left.schema))
        settled = settled.unionByName(step.filter("part <= 0 OR part >= 1"))
        left = step.filter("part > 0 AND part < 1").withColumn("node", F.floor(F.col("node") / FANOUT))
    done = settled.unionByName(left)
    copies = (F.col("whole") + F.round("part")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeat_to_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it; their columns stay, whatever their names.

    Rows that agree in doc_id, source and size are numbered, and each takes the copies of its number.
    """
    key = ["id", "source", "words"]
    taken = mix_sources(docs, **options).select(F.col("doc_id").alias("id"), "source", F.col("size").alias("words"), "copies")
    taken = taken.groupBy(*key).agg(F.count("*").alias("rows"), F.min("copies").alias("least"), F.sum("copies").alias("all")).filter("all > 0")
    # The copies of equal rows differ by one at most: ``all - rows * least`` of them take one more.
    taken = taken.select(*(F.col(c).alias(f"{c}_") for c in key), "rows", "least", (F.col("all") - F.col("rows") * F.col("least")).alias("more"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "source", words.alias("words"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key[:2]] + [F.col("words") == F.col("words_")]
    rows = rows.join(taken, same[0] & same[1] & same[2])
    single = rows.filter("rows = 1").withColumn("n", F.col("least") + F.col("more"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row")))
    repeated = rows.filter("rows > 1").withColumn("n", F.col("least") + F.when(number <= F.col("more"), 1).otherwise(0))
    return single.unionByName(repeated).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")
