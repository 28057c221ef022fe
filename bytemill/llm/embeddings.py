"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors of equal label (not null) and length link when their cosine, in double precision, is 0.98 or more. Exactly equal
vectors fall into one class first. All vectors are divided by their largest component, so that no norm over- or
underflows. The classes' vectors are rotated to principal axes, so that few leading dimensions
hold most of a product. Unit vectors with such a cosine differ by sqrt(2 - 2 * 0.98) at most in every coordinate, so
cells of that width on the first axis are compared with themselves and the next one only, in tiles of bounded size,
whose boxes on the next axes must come as near. In
a tile pair the product grows by a few dimensions at a time; a pair is dropped once the product so far and the norms of
what is left (Cauchy-Schwarz) cannot reach the threshold. What survives is computed again from the given components.

Vectors that are null or zero, or hold null or non-finite components, and rows with a null label link with nothing.
Rows that repeat a vec_id are compared as rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected_components, local_components, tile_pairs

THRESHOLD = 0.98
#: Rows of a tile; vectors that the axes are fitted on (any axes give the same result, good ones give it sooner); dimensions of a step.
TILE, FIT_ROWS, STEP = 1024, 4096, 8


def principal_axes(vectors: DataFrame, fit_rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """Orthonormal axes by vector length, by falling variance, from ``fit_rows`` vectors at most, chosen by hash."""
    sample = vectors.select("vector", "id").orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vector").collect()
    by_size: dict[int, list] = {}
    for row in sample:
        by_size.setdefault(len(row.vector), []).append(row.vector)
    axes = {}
    for size, rows in by_size.items():
        x = scaled(np.array(rows, np.float64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x -= x.mean(axis=0)
        axes[size] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return axes


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component, which changes no cosine."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _rotated(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit @ axes[x.shape[1]] if x.shape[1] in axes else unit


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: dict[int, np.ndarray], threshold: float = THRESHOLD, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs whose cosine reaches the threshold."""
    a, b = scaled(a), scaled(b)
    x, y = _rotated(a, axes), _rotated(b, axes)
    rest = [np.sqrt(np.maximum(0, np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1])) for z in (x, y)]
    size, floor = x.shape[1], threshold - 1e-9
    product = x[:, :step] @ y[:, :step].T
    if size > step:
        i, j = np.nonzero(product + rest[0][:, step, None] * rest[1][None, :, step] >= floor)
    else:
        i, j = np.nonzero(product >= floor)
    product = product[i, j]
    for at in range(step, size, step):
        product = product + np.einsum("ij,ij->i", x[i, at : at + step], y[j, at : at + step])
        left = rest[0][i, at + step] * rest[1][j, at + step] if at + step < size else 0.0
        ok = product + left >= floor
        i, j, product = i[ok], j[ok], product[ok]
    norms = [np.linalg.norm(z, axis=1) for z in (a, b)]
    ok = np.einsum("ij,ij->i", a[i], b[j]) / (norms[0][i] * norms[1][j]) >= threshold
    return i[ok], j[ok]


def _tile_links(axes: dict[int, np.ndarray]):
    """For each row of a tile pair that links: the smallest row it reaches, and how many vectors it links with here."""

    def run(table: pa.Table) -> pa.Table:
        ids, side, copies = (table.column(c).to_numpy() for c in ("id", "side", "copies"))
        column = table.column("vector").combine_chunks()
        x = np.asarray(column.flatten(), np.float64).reshape(len(ids), -1)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        linked = np.zeros((len(ids), len(ids)), bool)
        if len(left) and len(right):
            i, j = linked_pairs(x[left], x[right], axes)
            linked[left[i], right[j]] = True
        linked |= linked.T
        np.fill_diagonal(linked, False)
        label, n = local_components(linked), linked @ copies
        far = np.flatnonzero(n > 0)
        return pa.table({"a": ids[far], "b": ids[label[far]], "n": n[far]})

    return run


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id (smallest vec_id that links reach), kept."""
    vectors = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    signed = vectors.withColumn("valid", F.coalesce(valid, F.lit(False)))
    signed = signed.withColumns({"s1": F.xxhash64("label", "vector"), "s2": F.xxhash64(F.lit(7), "vector", "label")})
    classes = signed.filter("valid").groupBy("s1", "s2").agg(F.count("*").alias("copies"), F.min_by(F.struct("vec_id", "label", "vector"), "vec_id").alias("x"))
    classes = checkpointed(classes.select("s1", "s2", "copies", F.col("x.vec_id").alias("id"), "x.label", "x.vector"))
    axes = principal_axes(classes)
    width = float(np.sqrt(2 - 2 * THRESHOLD)) + 1e-6

    def with_cells(batches):
        for batch in batches:
            column = batch.column("vector")
            lengths = np.diff(column.offsets.to_numpy())
            flat, begin = column.flatten().to_numpy(), np.cumsum(lengths) - lengths
            at = np.zeros((3, len(lengths)), np.int64)
            for size in np.unique(lengths):
                rows = np.flatnonzero(lengths == size)
                x = scaled(flat[begin[rows][:, None] + np.arange(size)])
                # Lengths that the axes were not fitted on keep their coordinates.
                places = np.floor(_rotated(x, axes)[:, :3] / width).astype(np.int64).T
                at[: len(places), rows] = places
            cells = {"cell": pa.array(at[0]), "box": pa.array(at[1]), "box2": pa.array(at[2])}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("key", "id", "copies")} | {"vector": column} | cells | {"open": pa.array(np.ones(len(lengths), bool))})

    keyed = classes.select(F.struct("label", F.size("vector").alias("size")).alias("key"), "id", "copies", "vector")
    kind = keyed.schema["key"].dataType.simpleString()
    rows = keyed.mapInArrow(with_cells, f"key {kind}, id long, copies long, vector array<double>, cell long, box long, box2 long, open boolean")
    tiled = tile_pairs(checkpointed(rows), "key", TILE, boxes=("box", "box2")).groupBy("key", "pair").applyInArrow(_tile_links(axes), "a long, b long, n long")
    tiled = checkpointed(tiled)
    found = connected_components(tiled.select("a", "b")).withColumnsRenamed({"node": "rep"})
    counts = tiled.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    known = classes.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("id").alias("rep"), "copies")
    out = signed.drop("vector", "label").join(known, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & F.col("valid"), "left")
    out = out.join(counts, "rep", "left").join(found, "rep", "left")
    links = F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
