"""Helpers shared by the operators: shared-folder checkpoints and byte-level tokenising in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# The six separators of words.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a regular expression, for Spark and for Python alike.
WORD = r"[^\x20\x09-\x0D]+"

IS_SEP = np.zeros(256, bool)
IS_SEP[list(SEPARATORS)] = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only on a local master (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp("bytemill"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The table written to ``path`` and read again with its own schema (also where it has no rows)."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folded(rows: DataFrame, merge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], parts: int = 16) -> DataFrame:
    """One row from the partial results of all tasks: ``merge`` makes one of many, in ``parts`` tasks first, then in one."""
    return rows.repartition(parts).mapInArrow(merge, rows.schema).repartition(1).mapInArrow(merge, rows.schema)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    sc = spark.sparkContext
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def large_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into slices of about ``most_bytes`` of text (one row at least), whatever the row sizes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = large_text(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most_bytes, side="right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def word_spans(data: np.ndarray, offs: np.ndarray, is_sep: np.ndarray = IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row number of every word of the texts ``data[offs[i]:offs[i + 1]]``, between bytes that ``is_sep`` marks."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~is_sep[data]
    edge = offs[(offs > 0) & (offs < n)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edge] = inside[edge]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offs, starts, side="right") - 1


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), np.uint64(base), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
        if len(have) > 1 << 23:
            _POWERS.pop(base)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lowered."""
    return _LOWER[data]


def block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes at a time, each block mixed into the hash of those before it."""
    n = ends - starts
    h = mix(n.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    if not len(n):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, at, left = np.arange(len(n)), starts, n
    while len(live):
        ok = left > 0
        if not ok.all():
            live, at, left = live[ok], at[ok], left[ok]
        block = words[at] & _MASKS[np.minimum(left, 8)]
        h[live] = mix(h[live] * np.uint64(0x9E3779B97F4A7C15) + mix(block ^ np.uint64(0xD6E8FEB86659FD93)))
        at, left = at + 8, left - 8
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: element i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand.

    The sums are polynomials modulo 2 ** 64, which certain structured strings of many hundred bytes share: only for
    spans of 300 bytes at most. Longer spans need ``block_hashes``.
    """
    back = _powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
