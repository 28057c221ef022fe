"""Feature groups: normalising by column, weighing groups by variance, and fusing them into one vector."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import query, table
from ..sources.files import publish, published_facts, read_published

#: Stand-in groups: places (from, to) in the embedding.
GROUPS = {"byte_seq": (0, 40), "entropy": (40, 41), "ngram": (41, 64)}
METHODS = ("none", "minmax", "standard", "scale")
#: What every variance score is raised by.
EPS = 1e-6


@dataclass(frozen=True)
class ColumnStats:
    low: tuple[float, ...]
    high: tuple[float, ...]
    mean: tuple[float, ...]
    variance: tuple[float, ...]


def variance_score(variance: Sequence[float], eps: float = EPS) -> float:
    """Of a group's columns: log1p of the mean over all cells of the squared, column-centred value, and ``eps``."""
    return math.log1p(max(sum(variance) / len(variance), 0.0)) + eps


def _place_sums(vector: str):
    """Each task's n, least, largest, mean and sum of squared deviations of every place of an array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            column = batch.column(vector)
            lengths = pc.list_value_length(column).fill_null(0).to_numpy()
            cells = column.flatten().cast(pa.float64())
            j = np.arange(len(cells)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            here = cells.is_valid().to_numpy(zero_copy_only=False)
            j, x = j[here], cells.fill_null(0).to_numpy()[here]
            size = int(lengths.max(initial=0))
            n = np.bincount(j, minlength=size)
            mean = np.bincount(j, x, size) / np.maximum(n, 1)
            low, high = np.full(size, np.inf), np.full(size, -np.inf)
            np.minimum.at(low, j, x)
            np.maximum.at(high, j, x)
            new = np.stack([n, low, high, mean, np.bincount(j, (x - mean[j]) ** 2, size)])
            state = new if state is None else _together(state, new)
        if state is not None and state.shape[1]:
            yield pa.RecordBatch.from_pydict({"size": [state.shape[1]], "state": [state.ravel().tolist()]})

    return run


def _together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of both parts' rows; a place that one lacks has no rows there."""
    none = np.array([[0.0], [np.inf], [-np.inf], [0.0], [0.0]])
    a, b = (np.concatenate([x, np.repeat(none, max(a.shape[1], b.shape[1]) - x.shape[1], axis=1)], axis=1) for x in (a, b))
    n, gap = a[0] + b[0], b[3] - a[3]
    share = b[0] / np.maximum(n, 1)
    return np.stack([n, np.minimum(a[1], b[1]), np.maximum(a[2], b[2]), a[3] + gap * share, a[4] + b[4] + gap * gap * a[0] * share])


def _merge_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        for row in batch.to_pylist():
            new = np.array(row["state"]).reshape(5, row["size"])
            state = new if state is None else _together(state, new)
    if state is not None:
        yield pa.RecordBatch.from_pydict({"size": [state.shape[1]], "state": [state.ravel().tolist()]})


def column_stats(rows: DataFrame, vector: str, parts: int = 16) -> ColumnStats:
    """Statistics of each place of an array column, nulls left out: one row a task, merged in two levels; numbers for each place come to the driver."""
    schema = "size long, state array<double>"
    tasks = rows.select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(_place_sums(vector), schema)
    got = tasks.repartition(parts).mapInArrow(_merge_places, schema).repartition(1).mapInArrow(_merge_places, schema).first()
    if not got:
        raise ValueError(f"{vector} has no values")
    n, low, high, mean, squares = np.array(got.state).reshape(5, got.size)
    return ColumnStats(*(tuple(x.tolist()) for x in (low, high, mean, squares / np.maximum(n, 1))))


def normalize(vector: Column, method: str = "none", stats: ColumnStats | None = None, expected: tuple[float, float] | None = None, scale: float | None = None) -> Column:
    """An array column normalised; a zero range or deviation counts as 1. ``expected`` bounds clip to 0..1."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: choose from {METHODS}")
    if method == "none":
        return vector
    if method == "scale":
        if not scale:
            raise ValueError("scale must not be 0")
        return F.transform(vector, lambda x: x / scale)
    if expected is not None:
        low, high = expected
        if high <= low:
            raise ValueError("the upper bound must be over the lower one")
        return F.transform(vector, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low))))
    if stats is None:
        raise ValueError(f"{method} needs column statistics")
    if method == "minmax":
        shift, width = stats.low, [(h - lo) or 1.0 for lo, h in zip(stats.low, stats.high, strict=True)]
    else:
        shift, width = stats.mean, [math.sqrt(v) or 1.0 for v in stats.variance]
    pairs = F.array(*(F.struct(F.lit(float(s)).alias("s"), F.lit(float(w)).alias("w")) for s, w in zip(shift, width, strict=True)))
    return F.zip_with(vector, pairs, lambda x, p: (x - p["s"]) / p["w"])


def adaptive_weights(scores: Mapping[str, float], method: str = "variance_softmax", temperature: float = 1.0) -> dict[str, float]:
    """Weights of the groups that add up to 1."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    if not scores:
        raise ValueError("at least one group is needed")
    if method == "uniform":
        return dict.fromkeys(scores, 1.0 / len(scores))
    if method == "variance_softmax":
        top = max(scores.values())
        mass = {k: math.exp((s - top) / temperature) for k, s in scores.items()}
    elif method == "variance_proportional":
        mass = dict(scores)
    else:
        raise ValueError(f"unknown method {method!r}")
    total = sum(mass.values())
    return {k: m / total for k, m in mass.items()} if total > 0 else dict.fromkeys(scores, 1.0 / len(scores))


def fuse(rows: DataFrame, groups: Mapping[str, str], weights: Mapping[str, float], out: str = "fused") -> DataFrame:
    """The groups' array columns times their weights, end to end in the order given."""
    parts = [_times(c, weights[g]) for g, c in groups.items()]
    return rows.withColumn(out, F.concat(*parts))


def publish_fused(rows: DataFrame, groups: Mapping[str, str], sizes: Mapping[str, int], weights: Mapping[str, float], path: str, keep: Sequence[str] = ("id",)) -> int:
    """Fused vectors with where each group stands in them and what it weighs, as one published set: readers see all of it or nothing."""
    whole = fuse(rows, groups, weights).select(*keep, "fused")
    facts = {"weights": dict(weights), "slices": {g: list(s) for g, s in slices(sizes).items()}, "size": sum(sizes.values())}
    return publish(whole, path, check=lambda t: t.filter(F.size("fused") != facts["size"]).isEmpty(), facts=facts)


def read_fused(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The fused vectors, and weights, slices and size."""
    return read_published(spark, path), published_facts(spark, path)


def _times(column: str, weight: float) -> Column:
    return F.transform(column, lambda x: x * weight)


def slices(sizes: Mapping[str, int]) -> dict[str, tuple[int, int]]:
    """Where each group stands in the fused vector."""
    out, at = {}, 0
    for g, n in sizes.items():
        out[g] = (at, at + n)
        at += n
    return out


def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.slice(v, a + 1, b - a).alias(g) for g, (a, b) in GROUPS.items()))


SQL_CELLS = """
c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS j FROM embeddings),
st AS (SELECT j, min(x) AS lo, max(x) AS hi, avg(x) AS m, var_pop(x) AS v FROM c GROUP BY j)
"""


def _long(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("vec_id", F.posexplode(column).alias("j", "x")).select("vec_id", "j", F.round("x", 6).alias("x"))


@query("minmax_normalize", f"WITH {SQL_CELLS} SELECT vec_id, j, round((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS x FROM c JOIN st USING (j) WHERE j < 40")
def minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_groups(spark, sf_dir)
    return _long(rows.withColumn("x", normalize(F.col("byte_seq"), "minmax", column_stats(rows, "byte_seq"))), "x")


@query("standard_normalize", f"WITH {SQL_CELLS} SELECT vec_id, j - 41 AS j, round((x - m) / CASE WHEN v > 0 THEN sqrt(v) ELSE 1 END, 6) AS x FROM c JOIN st USING (j) WHERE j >= 41")
def standard_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_groups(spark, sf_dir)
    return _long(rows.withColumn("x", normalize(F.col("ngram"), "standard", column_stats(rows, "ngram"))), "x")


@query("bounded_normalize", f"WITH {SQL_CELLS} SELECT vec_id, 0 AS j, round(least(1, greatest(0, (x + 0.1) / 0.2)), 6) AS x FROM c WHERE j = 40")
def bounded_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By expected bounds, clipped: no statistics, no shuffle."""
    return _long(feature_groups(spark, sf_dir).withColumn("x", normalize(F.col("entropy"), "minmax", expected=(-0.1, 0.1))), "x")


@query("scale_normalize", f"WITH {SQL_CELLS} SELECT vec_id, j, round(x / 255, 6) AS x FROM c WHERE j < 40")
def scale_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(feature_groups(spark, sf_dir).withColumn("x", normalize(F.col("byte_seq"), "scale", scale=255.0)), "x")


SQL_SCORES = f"""{SQL_CELLS},
g AS (SELECT CASE WHEN j < 40 THEN 'byte_seq' WHEN j = 40 THEN 'entropy' ELSE 'ngram' END AS name, ln(1 + avg(v)) + 1e-6 AS score FROM st GROUP BY 1),
w AS (SELECT name, score, exp(score - max(score) OVER ()) / sum(exp(score)) OVER () * exp(max(score) OVER ()) AS weight FROM g)"""


def group_scores(rows: DataFrame, groups: Mapping[str, tuple[int, int]] = GROUPS) -> dict[str, float]:
    """Variance scores of all groups from one pass over their values set end to end."""
    every = column_stats(rows.select(F.concat(*groups).alias("all")), "all").variance
    return {g: variance_score(every[a:b]) for g, (a, b) in slices({g: b - a for g, (a, b) in groups.items()}).items()}


@query("group_variance", f"WITH {SQL_SCORES} SELECT name, round(score, 6) AS score FROM w")
def group_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = group_scores(feature_groups(spark, sf_dir))
    return spark.createDataFrame([(g, round(s, 6)) for g, s in scores.items()], "name string, score double")


@query("adaptive_weights", f"WITH {SQL_SCORES} SELECT name, round(weight, 6) AS weight FROM w")
def adaptive_weights_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = adaptive_weights(group_scores(feature_groups(spark, sf_dir)))
    return spark.createDataFrame([(g, round(w, 6)) for g, w in weights.items()], "name string, weight double")


@query("fused_vector", f"""WITH {SQL_SCORES} SELECT vec_id, j, round(x * weight, 6) AS x FROM c
JOIN w ON w.name = CASE WHEN j < 40 THEN 'byte_seq' WHEN j = 40 THEN 'entropy' ELSE 'ngram' END""")
def fused_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_groups(spark, sf_dir)
    return _long(fuse(rows, {g: g for g in GROUPS}, adaptive_weights(group_scores(rows))), "fused")
