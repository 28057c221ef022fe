"""Byte-level kernels: numpy over slices of a binary column, one pass and no shuffle for what one sample needs.

Built-in expressions make an object of every byte; here a slice of samples is one array of bytes, and a sample costs
its bytes and a fixed number of counters. ``read`` turns an Arrow batch into bytes, a mask of known ones, and offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Bytes = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Bytes of a slice, about.
SLICE = 1 << 20


@dataclass(frozen=True)
class Samples:
    """Rows whose bytes ``read`` gives, ``column`` being where they come from; ``keys`` are kept by name."""

    rows: DataFrame
    read: Callable[[pa.RecordBatch], Bytes]
    column: str
    keys: tuple[str, ...]

    def map(self, kernel: Callable[..., dict[str, pa.Array]], schema: str) -> DataFrame:
        """A row for each sample: its keys and what ``kernel(data, known, offs)`` makes of a slice."""
        read, column, keys = self.read, self.column, self.keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, *arrays in slices(batches, read, column):
                yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in keys} | kernel(*arrays))

        own = "".join(f"{k} {self.rows.schema[k].dataType.simpleString()}, " for k in keys)
        return self.rows.mapInArrow(run, own + schema)


def slices(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], Bytes], column: str, most: int = SLICE) -> Iterator[tuple]:
    """Batches cut into rows of about ``most`` bytes (one row at least), with their bytes."""
    for batch in batches:
        values = batch.column(column)
        lengths = (pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length)(values).fill_null(0).to_numpy()
        upto, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, upto[at] - lengths[at] + most, side="right")))
            part = batch.slice(at, to - at)
            yield part, *read(part)
            at = to


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def plain_text(batch: pa.RecordBatch) -> Bytes:
    """The bytes of a text column, all of them known."""
    data, offs = binary_column(batch.column("text"))
    return data, np.ones(len(data), bool), offs


def from_values(name: str = "values") -> Callable[[pa.RecordBatch], Bytes]:
    """Reads an array-of-int column whose null elements are unknown bytes."""

    def read(batch: pa.RecordBatch) -> Bytes:
        column = batch.column(name)
        if column.null_count:
            column = pa.array([x if x is not None else [] for x in column.to_pylist()], column.type)
        flat = column.flatten()
        offs = column.offsets.to_numpy().astype(np.int64)
        return flat.fill_null(0).to_numpy().astype(np.uint8), flat.is_valid().to_numpy(zero_copy_only=False), offs - offs[0]

    return read


def owners(offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def histograms(data: np.ndarray, known: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """256 counts of known bytes for each sample."""
    n = len(offs) - 1
    return np.bincount((owners(offs) * 256 + data)[known], minlength=n * 256).reshape(n, 256)


PROFILE = "n_total long, n_known long, entropy double, mean double, std double, zero_ratio double, printable_ratio double, high_ratio double, counts array<long>"


def profile(data: np.ndarray, known: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
    """Counts, entropy in bits, mean, population deviation and class ratios of the known bytes; all 0 without any."""
    counts = histograms(data, known, offs)
    n = counts.sum(axis=1)
    safe = np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        weighted = np.where(counts > 0, counts * np.log2(np.maximum(counts, 1)), 0.0).sum(axis=1)
    value = np.arange(256)
    mean = counts @ value / safe
    spread = (counts @ value**2) * n - (counts @ value) ** 2
    shares = {"zero_ratio": counts[:, 0], "printable_ratio": counts[:, 32:127].sum(axis=1), "high_ratio": counts[:, 128:].sum(axis=1)}
    out = {"n_total": np.diff(offs), "n_known": n, "entropy": np.where(n > 0, np.log2(safe) - weighted / safe, 0.0), "mean": mean, "std": np.sqrt(spread) / safe}
    out |= {k: v / safe for k, v in shares.items()}
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, 256), pa.int32()), pa.array(counts.ravel()))
    return {k: pa.array(v) for k, v in out.items()} | {"counts": lists}


GRID = "n array<int>, n_known array<int>, pixel binary, mask binary, sum_pixel long, sum_mask long, sum_square long, n_zero long"


def grid(side: int = 32):
    """Equal-position bins: bin j takes the positions from floor(j N / bins) on.

    A pixel is the half-up mean of its known bytes (0 without any), a mask the half-up share of unknown ones in 255ths
    (255 for an empty bin).
    """
    bins = side * side

    def run(data: np.ndarray, known: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
        edges = offs[:-1, None] + np.arange(bins + 1) * np.diff(offs)[:, None] // bins
        n = np.diff(edges, axis=1)
        sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (known, np.where(known, data, 0))]
        k, total = (s[edges[:, 1:]] - s[edges[:, :-1]] for s in sums)
        pixel = np.where(k > 0, (total + k // 2) // np.maximum(k, 1), 0)
        mask = np.where(n > 0, (255 * (n - k) + n // 2) // np.maximum(n, 1), 255)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, bins), pa.int32()), pa.array(x.ravel().astype(np.int32)))
        raw = lambda x: pa.array([r.tobytes() for r in x.astype(np.uint8)], pa.binary())
        totals = {"sum_pixel": pixel.sum(axis=1), "sum_mask": mask.sum(axis=1), "sum_square": (pixel * pixel).sum(axis=1), "n_zero": (pixel == 0).sum(axis=1)}
        return {"n": lists(n), "n_known": lists(k), "pixel": raw(pixel), "mask": raw(mask)} | {c: pa.array(x.astype(np.int64)) for c, x in totals.items()}

    return run


def head_image(side: int = 32):
    """The first bins' bytes as they are, 0 where unknown or past the end, and how many of those tokens are unknown."""
    bins = side * side

    def run(data: np.ndarray, known: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
        at = offs[:-1, None] + np.arange(bins)
        inside = at < offs[1:, None]
        at = np.minimum(at, max(len(data) - 1, 0))
        ok = inside & (known[at] if len(data) else False)
        pixel = np.where(ok, data[at] if len(data) else 0, 0).astype(np.uint8)
        return {"pixel": pa.array([r.tobytes() for r in pixel], pa.binary()), "n_unknown": pa.array((inside & ~ok).sum(axis=1))}

    return run


def sequence(length: int, keep: str, pad: int = 0):
    """The first or last ``length`` values, padded at the other side, and a mask of known ones."""

    def run(data: np.ndarray, known: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
        size = np.diff(offs)[:, None]
        at = np.arange(length)[None, :] + (0 if keep == "head" else size - length)
        inside = (at >= 0) & (at < size)
        at = np.clip(offs[:-1, None] + at, 0, max(len(data) - 1, 0))
        ok = inside & (known[at] if len(data) else False)
        values = np.where(ok, data[at] if len(data) else pad, pad).astype(np.int16)
        step = pa.array(np.arange(0, values.size + 1, length), pa.int32())
        return {
            "values": pa.ListArray.from_arrays(step, pa.array(values.ravel())), "n_known": pa.array(ok.sum(axis=1).astype(np.int32)),
            "n_truncated": pa.array(np.maximum(0, size[:, 0] - length).astype(np.int32)), "n_padded": pa.array(np.maximum(0, length - size[:, 0]).astype(np.int32)),
        }

    return run


def gram_codes(data: np.ndarray, known: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed big-endian codes of all windows of ``n`` known bytes of one sample, and their samples."""
    m = max(0, len(data) - n + 1)
    row = owners(offs)
    ok, code = row[:m] == row[n - 1 :][:m], np.zeros(m, np.int64)
    for j in range(n):
        ok &= known[j : j + m]
        code = code * 256 + data[j : j + m]
    return code[ok], row[:m][ok]


def count_grams(samples: Samples, n: int) -> DataFrame:
    """gram, global_count over all samples; each slice counts its own first."""
    read, column = samples.read, samples.column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, *arrays in slices(batches, read, column, 8 * SLICE):
            gram, count = np.unique(gram_codes(*arrays, n)[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(gram), "global_count": pa.array(count)})

    return samples.rows.mapInArrow(run, "gram long, global_count long").groupBy("gram").agg(F.sum("global_count").alias("global_count"))


def selected_grams(grams: np.ndarray, n: int):
    """Counts of the chosen grams, in ascending order of the grams, and the number of all valid windows."""
    chosen = np.unique(np.asarray(grams, np.int64))

    def run(data: np.ndarray, known: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
        rows = len(offs) - 1
        code, row = gram_codes(data, known, offs, n)
        total = np.bincount(row, minlength=rows)
        counts = np.zeros((rows, len(chosen)), np.int64)
        if len(chosen):
            at = np.minimum(np.searchsorted(chosen, code), len(chosen) - 1)
            hit = chosen[at] == code
            counts = np.bincount(row[hit] * len(chosen) + at[hit], minlength=counts.size).reshape(counts.shape)
        step = pa.array(np.arange(rows + 1) * len(chosen), pa.int32())
        return {"total": pa.array(total), "counts": pa.ListArray.from_arrays(step, pa.array(counts.ravel()))}

    return run
