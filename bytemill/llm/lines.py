"""Line dedup over levelled sorted runs of line hashes.

A run is a table sorted by line hash: one row for each key with the number of documents that hold it and the largest of
their ids. Each batch of documents is anti-joined with the runs: the keys never seen before become a run of level 0, so
a key stands in one run only, and what the batch says of known keys is kept as updates, since counts need all of them.
Once a level has ``fanout`` runs they are merged into one run of the next level, so a key is rewritten a logarithmic
number of times.

A key is the line without white space at both ends and with A-Z lowered; it is told apart by two 64-bit hashes. Null and
empty texts are one empty line. Rows that repeat a doc_id count as one document. Documents with a null doc_id neither
count nor lose lines. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, discard, scratch, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = "".join(map(chr, SEPARATORS))
KEY = ("h1", "h2")
#: Frequent keys (24 bytes each) that are sent to all tasks at most; parts of a key's documents beyond that.
MOST_SENT, SALTS = 500_000, 32
#: Parts of a document's lost keys.
PARTS = 1024


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashed(line: Column, least_chars: int) -> Column:
    """The hashes of a line's key; null where the key is shorter than ``least_chars`` code points."""
    key = line_key(line)
    long_enough = (F.octet_length(line) >= least_chars) & (F.char_length(key) >= least_chars)
    return F.when(long_enough, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")))


def line_hashes(docs: DataFrame, least_chars: int = 40) -> DataFrame:
    """The distinct (doc_id, h1, h2) of all lines that are long enough."""
    keys = F.filter(F.transform(_lines(F.col("text")), lambda x: _hashed(x, least_chars)), lambda k: k.isNotNull())
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.explode(keys).alias("k"))
    return rows.select("doc_id", "k.h1", "k.h2").distinct()


def _part(h1: Column) -> Column:
    return F.pmod(h1, F.lit(PARTS).cast("long"))


def _holds(lost: Column, key: Column) -> Column:
    return F.array_contains(F.element_at(lost, _part(key["h1"])), key)


class LineRuns:
    """Levels of sorted runs in the shared folder, no key in two of them, and later batches' updates of their keys."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.path = path or scratch(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.updates: list[str] = []
        self._made = 0

    def _write(self, rows: DataFrame, kind: str) -> str:
        out = f"{self.path}/{kind}-run{self._made}"
        self._made += 1
        rows.repartition(*KEY).sortWithinPartitions(*KEY).write.parquet(out)
        return out

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The keys of a batch that no run holds: an anti-join with each run in turn."""
        for run in (r for level in self.levels for r in level):
            hashes = hashes.join(self.spark.read.parquet(run), list(KEY), "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> None:
        """Add a batch of distinct (doc_id, h1, h2): new keys as a run, known ones as updates; merge levels that are full. Batches hold different documents."""
        batch = hashes.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if any(self.levels):
            made = [self._write(batch, "batch")]
            batch = self.spark.read.parquet(*made)
            at = self._write(self.unseen(batch), "level0")
            self.updates.append(self._write(batch.join(self.spark.read.parquet(at), list(KEY), "left_anti"), "updates"))
            discard(self.spark, *made)
        else:
            at = self._write(batch, "level0")
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(at)
            if len(self.levels[level]) < self.fanout:
                return
            at = self._write(self.spark.read.parquet(*self.levels[level]), f"level{level + 1}")
            discard(self.spark, *self.levels[level])
            self.levels[level] = []
            level += 1

    def frequent(self, least_docs: int) -> DataFrame:
        """The keys that at least so many documents hold, over all runs and updates."""
        runs = [r for level in self.levels for r in level] + self.updates
        return self._merged(self.spark.read.parquet(*runs)).filter(F.col("n_docs") >= least_docs)


def found_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 4) -> DataFrame:
    """Each document (``row``) with the text that is left, n_lines and n_dropped.

    A frequent line stays in the largest doc_id that holds it. The hashes are written once and dealt to ``batches``
    batches by doc_id; texts are read twice and never grouped by line.
    """
    spark = docs.sparkSession
    at = scratch(spark, "line-hashes")
    line_hashes(docs, least_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))).write.partitionBy("batch").parquet(at)
    schema = "doc_id long, h1 long, h2 long, batch long"
    hashes = spark.read.schema(schema).parquet(at)
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(hashes.filter(F.col("batch") == b).drop("batch"))
    frequent = written(runs.frequent(least_docs), f"{at}-frequent")
    lost = _with_hot_keys(hashes.drop("batch"), frequent).filter("doc_id <> max_doc")
    # A document's lost keys by PARTS parts of their hash, so that a line is compared with few of them.
    parts = lost.repartition("doc_id").groupBy("doc_id", _part(F.col("h1")).alias("part")).agg(F.collect_list(F.struct(*KEY)).alias("keys"))
    lost = written(parts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "keys"))).alias("lost")), f"{at}-lost")
    discard(spark, at, runs.path, f"{at}-frequent")
    # One plan at every size: a small table of losses would be sent to all tasks, a large one not.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id")).join(lost.hint("merge"), F.col("id") == F.col("doc_id"), "left")
    lines = _lines(F.col("row.text"))
    kept = F.filter(lines, lambda x: ~F.coalesce(_holds(F.col("lost"), _hashed(x, least_chars)), F.lit(False)))
    rows = rows.withColumn("kept", F.when(F.col("lost").isNull(), lines).otherwise(kept))
    counts = F.size(lines).cast("long"), (F.size(lines) - F.size("kept")).cast("long")
    return rows.select("row", F.array_join("kept", "\n").alias("text"), counts[0].alias("n_lines"), counts[1].alias("n_dropped"))


def _with_hot_keys(hashes: DataFrame, frequent: DataFrame) -> DataFrame:
    """Each document's frequent keys with their largest document.

    Frequent keys are few as a rule: they are sent to all tasks where MOST_SENT rows hold them. More of them are joined
    by key and one of SALTS numbers of the document, so that a key that most documents hold meets many tasks.
    """
    if frequent.count() <= MOST_SENT:
        return hashes.join(F.broadcast(frequent), list(KEY))
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return hashes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS).cast("long"))).join(salted, [*KEY, "salt"])


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with text without the lines that too many documents hold, and n_lines and n_dropped (in place of such columns)."""
    found = found_lines(docs, **options)
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return found.select(*own, "text", "n_lines", "n_dropped")


def without_lines(docs: DataFrame, **options) -> DataFrame:
    """``drop_lines`` with the input's own columns; n_chars, where there is one, is counted again; null texts stay null."""
    found = found_lines(docs, **options)
    text = F.when(F.col("row.text").isNotNull(), F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("row.text").isNull(), F.col("row.n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
