"""Stand-ins that make the test tables look like collections of binary samples.

A document's UTF-8 bytes are a sample's bytes; deterministic positions are unknown or invalid; class and split follow
from the id. Each has a DuckDB twin below, for the oracles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .apportion import split_sizes
from .bytestats import Bytes, Samples, binary_column, owners, plain_text
from .ranking import ranked

CLASSES = 9


def sample_class(doc_id: str = "doc_id") -> Column:
    return (F.pmod(F.col(doc_id), F.lit(CLASSES)) + 1).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _hidden(batch: pa.RecordBatch) -> Bytes:
    """A text's bytes; the known ones are those at positions that are neither unknown nor invalid."""
    data, offs = binary_column(batch.column("text"))
    row = owners(offs)
    place = batch.column("doc_id").to_numpy()[row] * 31 + np.arange(len(data)) - offs[row]
    known = (place % 17 != 0) & (place % 97 != 1)
    return np.where(known, data, 0).astype(np.uint8), known, offs


def samples(spark: SparkSession, sf_dir: str, hidden: bool = True) -> Samples:
    """The documents' bytes by doc_id and class; ``hidden`` ones are unknown."""
    rows = documents(spark, sf_dir).select("doc_id", sample_class().alias("class"), "text")
    return Samples(rows, _hidden if hidden else plain_text, "text", ("doc_id", "class"))


def _split_key(seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)


def splits(spark: SparkSession, sf_dir: str, seed: str = "42") -> DataFrame:
    """doc_id, class, split: by the order of a seeded hash within each class, 70 % train, 15 % val, 15 % test, in sizes that
    add up over the classes (see ``split_sizes``).

    Ranks come from the counts of 4,096 hash prefixes a class, so no task holds a class.
    """
    d = documents(spark, sf_dir).select("doc_id", sample_class().alias("class"), _split_key(seed).alias("key"))
    r = ranked(d, ["class"], F.substring("key", 1, 3), ["key", "doc_id"])
    sizes = split_sizes(d.groupBy("class").agg(F.count("*").alias("n"))).drop("n")
    r = r.join(F.broadcast(sizes), "class")  # CLASSES rows
    split = F.when(F.col("rank") <= F.col("n_train"), "train").when(F.col("rank") <= F.col("n_train") + F.col("n_val"), "val").otherwise("test")
    return r.select("doc_id", "class", split.alias("split"))


def with_split(rows: DataFrame, spark: SparkSession, sf_dir: str, seed: str = "42") -> DataFrame:
    """Rows of doc_id and class, of any width, with their split: ``splits`` cuts each class's order at two places, and these
    (CLASSES rows) are sent to the rows. Rows without an id have no class and are dropped, as by a join."""
    at = F.struct(_split_key(seed).alias("key"), "doc_id")
    last = lambda split: F.max(F.when(F.col("split") == split, at)).alias(f"last_{split}")
    cuts = splits(spark, sf_dir, seed).groupBy("class").agg(last("train"), last("val"))
    split = F.when(at <= F.col("last_train"), "train").when(at <= F.col("last_val"), "val").otherwise("test")
    return rows.join(F.broadcast(cuts), "class").select(*rows.columns, split.alias("split"))


#: b: one row for each byte (doc_id, p, v); v is null where unknown or invalid.
SQL_BYTES = """
x AS (SELECT doc_id, regexp_extract_all(hex(coalesce(text, '')), '..') AS x FROM documents),
raw AS (SELECT doc_id, unnest(x) AS h, generate_subscripts(x, 1) - 1 AS p FROM x),
b AS (SELECT doc_id, p, h, CASE WHEN (doc_id * 31 + p) % 17 = 0 OR (doc_id * 31 + p) % 97 = 1 THEN NULL ELSE ('0x' || h)::INT END AS v FROM raw)
"""
SQL_SPLITS = """
s0 AS (SELECT doc_id, (doc_id % 9 + 1)::INT AS class, sha256('42:' || doc_id) AS k FROM documents),
z0 AS (SELECT class, count(*) AS c, sum(count(*)) OVER ()::BIGINT AS n, ceil(0.3 * sum(count(*)) OVER ())::BIGINT AS h FROM s0 GROUP BY class),
z1 AS (SELECT *, c * (n - h) // n + (row_number() OVER (ORDER BY c * (n - h) % n DESC, class) <= n - h - sum(c * (n - h) // n) OVER ())::INT AS tr FROM z0),
z2 AS (SELECT *, c - tr AS r, h - ceil(0.5 * h)::BIGINT AS v FROM z1),
z AS (SELECT class, tr, r * v // h + (row_number() OVER (ORDER BY r * v % h DESC, class) <= v - sum(r * v // h) OVER ())::INT AS va FROM z2),
s1 AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY k, doc_id) AS r FROM s0),
s AS (SELECT doc_id, class, CASE WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'val' ELSE 'test' END AS split FROM s1 JOIN z USING (class))
"""
