"""Removal of repeated substrings over levelled, hash-sorted fingerprints of sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Each such string (window) picks the
smallest hash among its substrings of K bytes: equal windows pick the same one, at the same place, so only suffixes that
start at picked places (2 % of all) need an index. A level holds the hashes of the first K bytes of these suffixes with
their counts, in the order of the hash: no positions and no suffix order, so this is no suffix array. A new batch is
joined with every level for equal hashes, then becomes a level itself; levels of equal size merge, so an entry is
rewritten a logarithmic number of times. The suffixes with matched hashes are then joined from the table of all of them.

Matched suffixes are then settled exactly. A suffix stands for the run of windows that picked it. If the bytes under the
whole run are found twice, all its windows are repeated. Else the hashes of its windows are compared with those of the
other suffixes with the same K bytes; where too many share them, window by window over the whole cluster. Windows are
told apart by 64-bit hashes, texts by a 64-bit hash of doc_id and text.

Matches never cross documents. Null and empty texts lose nothing. Rows that repeat a document count as documents of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, pieces, prefix_sums, scratch, span_hashes, written

LENGTH, K = 200, 100
#: Bytes of a document looked at together; window hashes of one suffix that are compared in a task.
SEGMENT, MOST_WINDOWS = 8 << 20, 2 << 20
#: A key is hot from so many rows on, and from this share of all rows: 1,000 keys at most are.
LEAST_HOT, HOT_SHARE = 5_000, 1_000


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from running minima within blocks of ``w``."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def picked(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """The picked places of texts: row, hash of the K bytes, first and last window start (in the text), hash of the bytes under them."""
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < LENGTH:
        return none
    n = len(data) - LENGTH + 1
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    starts = np.flatnonzero(np.arange(n) + LENGTH <= offs[1:][row])
    if not len(starts):
        return none
    sums = prefix_sums(data)
    at = np.arange(len(data) - K + 1)
    grams = span_hashes(sums, at, at + K)
    place = (_sliding_min((grams >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64), LENGTH - K + 1) & np.uint64(0xFFFFFF)).astype(np.int64)[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(fresh)
    first, last = starts[head], starts[np.append(head[1:], len(starts)) - 1]
    row = row[first]
    return row, grams[place[head]].view(np.int64), first - offs[row], last - offs[row], span_hashes(sums, first, last + LENGTH).view(np.int64)


def _segments(data: np.ndarray, offs: np.ndarray, segment: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Very long texts in overlapping segments, so that each window lies in one."""
    if len(offs) > 2 or len(data) <= segment:
        yield 0, data, offs
        return
    for base in range(0, len(data), segment):
        part = data[base : base + segment + LENGTH - 1]
        yield base, part, np.array([0, len(part)])


def _suffixes(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "key", "first", "last", "under"]
        for batch, data, offs in pieces(batches, min(segment, 1 << 20)):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for base, part, bounds in _segments(data, offs, segment):
                row, gram, first, last, under = picked(part, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, keys[row], first + base, last + base, under)], names)

    return run


class SuffixLevels:
    """Levels of sorted (gram, n) runs in the shared folder, and the grams that were matched, with how often they were seen."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.path = path or scratch(spark, "suffix-levels")
        self.levels: list[list[str]] = []
        self._made = 0

    def _write(self, rows: DataFrame) -> str:
        out = f"{self.path}/run{self._made}"
        self._made += 1
        rows.sortWithinPartitions("gram").write.parquet(out)
        return out

    def add(self, suffixes: DataFrame) -> None:
        """Scan a batch against itself and all levels, keep what matched, make it a level and merge full levels."""
        at, level = self._write(suffixes.groupBy("gram").agg(F.count("*").alias("n"))), 0
        run = self.spark.read.parquet(at)
        found = run.filter("n > 1")
        for old in (r for runs in self.levels for r in runs):
            both = run.join(self.spark.read.parquet(old).withColumnRenamed("n", "m"), "gram")
            found = found.unionByName(both.select("gram", (F.col("n") + F.col("m")).alias("n")))
        found.write.mode("append").parquet(f"{self.path}/matched")
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(at)
            if len(self.levels[level]) < self.fanout:
                return
            at = self._write(self.spark.read.parquet(*self.levels[level]).groupBy("gram").agg(F.sum("n").alias("n")))
            discard(self.spark, *self.levels[level])
            self.levels[level] = []
            level += 1

    def matched(self) -> DataFrame:
        """gram and n, about how many suffixes have it."""
        return self.spark.read.schema("gram long, n long").parquet(f"{self.path}/matched").groupBy("gram").agg(F.sum("n").alias("n"))


def _salted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose key is among ``keys`` (with n, about how many rows have it); rows of hot keys meet in many tasks.

    Only hot keys are sent to all tasks: those with more than one of HOT_SHARE parts of all rows.
    """
    most = max(LEAST_HOT, (keys.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    salts = F.ceil(F.col("n") / most).cast("long")
    hot = F.broadcast(keys.filter(F.col("n") > most).select(*on, salts.alias("salts")))
    dealt = keys.select(*on, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    rows = rows.join(hot, on, "left").withColumn("salt", F.pmod(F.xxhash64("key", "first"), F.coalesce("salts", F.lit(1).cast("long")))).drop("salts")
    return rows.join(dealt, [*on, "salt"]).drop("salt")


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of all windows of the suffixes that are asked for."""
    for batch, data, offs in pieces(batches):
        asked = batch.column("asked")
        counts = np.diff(asked.offsets.to_numpy())
        flat = asked.flatten()
        row = np.repeat(np.arange(batch.num_rows), counts)
        gram, first, last, many = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        sums = prefix_sums(data)
        n = last - first + 1
        start = np.repeat(offs[row] + first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hashes = span_hashes(sums, start, start + LENGTH)
        ends = np.cumsum(n)
        blobs = pa.array([hashes[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())
        keys = batch.column("key").to_numpy(zero_copy_only=False)[row]
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(keys), pa.array(first), pa.array(many), blobs], ["gram", "key", "first", "many", "hashes"])


def _flat(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Hash, key, start and many of each window."""
    blobs = table.column("hashes").to_pylist()
    n = np.array([len(b) // 8 for b in blobs], np.int64)
    hashes = np.frombuffer(b"".join(blobs), np.uint64)
    key, first, many = (np.repeat(table.column(c).to_numpy(), n) for c in ("key", "first", "many"))
    return hashes, key, first + np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n), many


def _repeated(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    _, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return (counts[at] > 1) | many


def _spans(key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Window starts as runs (key, from, to)."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
    head = np.flatnonzero(fresh)
    last = start[np.append(head[1:], len(key)) - 1] if len(key) else start
    nulls = pa.nulls(len(head), pa.bool_()), pa.nulls(len(head), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key[head]), pa.array(start[head]), pa.array(last), *nulls], ["key", "from", "to", "many", "hashes"])


def _settle(most_windows: int):
    """Of suffixes sorted by gram: runs of repeated windows; suffixes of too common grams come back with their hashes."""

    def too_common(table: pa.Table) -> pa.RecordBatch:
        t = table.combine_chunks()
        cols = [t.column(c).combine_chunks() for c in ("key", "first", "many", "hashes")]
        return pa.RecordBatch.from_arrays([cols[0], cols[1], pa.nulls(t.num_rows, pa.int64()), cols[2], cols[3]], ["key", "from", "to", "many", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, flooded = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if kept is not None:
                table = pa.concat_tables([kept, table])
            if not table.num_rows:
                continue
            gram = table.column("gram").to_numpy()
            if flooded is not None:
                n = int(np.searchsorted(gram != flooded, True)) if (gram != flooded).any() else len(gram)
                if n:
                    yield too_common(table.slice(0, n))
                table, gram = table.slice(n), gram[n:]
                if not len(gram):
                    kept = None
                    continue
                flooded = None
            cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if (gram != gram[-1]).any() else 0
            if cut:
                hashes, key, start, many = _flat(table.slice(0, cut))
                ok = _repeated(hashes, many)
                yield _spans(key[ok], start[ok])
            kept = table.slice(cut)
            if kept.num_rows * (LENGTH - K) > most_windows:
                yield too_common(kept)
                kept, flooded = None, gram[-1]
        if kept is not None and kept.num_rows:
            hashes, key, start, many = _flat(kept)
            ok = _repeated(hashes, many)
            yield _spans(key[ok], start[ok])

    return run


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows as rows; those repeated within a batch of suffixes are told so and sent on once more, by the first of them."""
    for batch in batches:
        hashes, key, start, many = _flat(pa.Table.from_batches([batch.rename_columns(["key", "first", "to", "many", "hashes"])]))
        ok = _repeated(hashes, many)
        _, first = np.unique(hashes, return_index=True)
        send = np.zeros(len(hashes), bool)
        send[first] = True
        told = ok & ~send
        h = np.concatenate([hashes[send], hashes[told]]).view(np.int64)
        key, start = np.concatenate([key[send], key[told]]), np.concatenate([start[send], start[told]])
        flags = np.concatenate([ok[send], np.ones(told.sum(), bool)])
        sent = np.concatenate([np.ones(send.sum(), bool), np.zeros(told.sum(), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, key, start, flags, sent)], ["hash", "key", "start", "many", "sent"])


def _runs_of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _spans(batch.column("key").to_numpy(), batch.column("start").to_numpy())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes under repeated windows."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch, data, offs in pieces(batches):
        spans = batch.column("spans")
        counts = np.diff(spans.offsets.to_numpy())
        flat = spans.flatten()
        row = np.repeat(np.arange(batch.num_rows), counts)
        begin, end = (flat.field(i).to_numpy(zero_copy_only=False) + offs[row] for i in range(2))
        # Texts are set one byte apart, so that spans that end and begin at a text's edge stay two.
        shift = row
        change = np.zeros(len(data) + batch.num_rows + 1, np.int32)
        np.add.at(change, begin + shift, 1)
        np.add.at(change, end + shift + LENGTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        place = offs[:-1] + np.arange(batch.num_rows)
        total, n_open = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens))
        until = offs[1:] + np.arange(batch.num_rows)
        separators = np.zeros(len(gone), bool)
        separators[until] = True
        keep = ~gone[~separators]
        kept = [data[a:b][keep[a:b]].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(total[until] - total[place]), pa.array(n_open[until] - n_open[place]), pa.array(kept, pa.binary())], names)


def drop_repeats(docs: DataFrame, batches: int = 4, most_windows: int = MOST_WINDOWS, segment: int = SEGMENT) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes."""
    spark = docs.sparkSession
    at = scratch(spark, "suffixes")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    suffixes = docs.select("key", "text").mapInArrow(_suffixes(segment), "gram long, key long, first long, last long, under long")
    suffixes = written(suffixes, f"{at}/all")
    levels = SuffixLevels(spark)
    for b in range(batches):
        levels.add(suffixes.filter(F.pmod("key", F.lit(batches)) == b))
    grams = written(levels.matched(), f"{at}/grams")
    matched = written(_salted(suffixes, grams, ["gram"]), f"{at}/matched")
    discard(spark, f"{at}/all", levels.path)

    runs = matched.groupBy("gram", "under").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last")).alias("x"))
    runs = written(runs.select("gram", "under", "n", "x.key", "x.first", "x.last"), f"{at}/runs")
    several = runs.filter("n > 1").select("gram", "under", "n")
    whole = _salted(matched, several, ["gram", "under"]).select("key", F.col("first").alias("from"), F.col("last").alias("to"))
    unlike = runs.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram")
    asked = runs.join(unlike, "gram").groupBy("key").agg(F.collect_list(F.struct("gram", "first", "last", (F.col("n") > 1).alias("many"))).alias("asked"))
    hashed = docs.select("key", "text").join(asked, "key").dropDuplicates(["key"]).select("key", "text", "asked")
    hashed = hashed.mapInArrow(_window_hashes, "gram long, key long, first long, many boolean, hashes binary")
    settled = hashed.repartition("gram").sortWithinPartitions("gram").mapInArrow(_settle(most_windows), "key long, from long, to long, many boolean, hashes binary")
    settled = written(settled, f"{at}/settled")

    single = settled.filter("hashes IS NOT NULL").mapInArrow(_single_windows, "hash long, key long, start long, many boolean, sent boolean")
    often = single.filter("sent").groupBy("hash").agg((F.count("*") > 1).alias("twice"), F.max("many").alias("many")).filter("twice OR many").select("hash")
    flooded = single.join(often, "hash").select("key", "start").mapInArrow(_runs_of_windows, "key long, from long, to long, many boolean, hashes binary")
    spans = whole.unionByName(settled.filter("hashes IS NULL").select("key", "from", "to")).unionByName(flooded.select("key", "from", "to"))
    spans = written(spans.groupBy("key").agg(F.collect_set(F.struct("from", "to")).alias("spans")), f"{at}-spans")
    discard(spark, at)
    kind = "array<struct<from:bigint,to:bigint>>"
    # One plan at every size: a small table of spans would be sent to all tasks, a large one not.
    rows = docs.join(spans.hint("merge"), "key", "left").select("doc_id", "text", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    return rows.mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
