"""CSV rows with everything that is wrong with them, row by row and cell by cell, in place of nulls and exceptions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import query, table
from .workspace import shared_path

ERRORS = "file string, row string, column string, reason string"


@dataclass(frozen=True)
class Checked:
    """``rows``: file and typed columns of the rows with as many values as there are columns (null for a wrong cell).
    ``errors``: file, row (its text), column (null for a whole row) and reason."""

    rows: DataFrame
    errors: DataFrame


def wrong_cell(text: Column, kind: str, required: bool) -> Column:
    """What is wrong with a text cell that should be of a type; null if nothing. A blank one is missing if it is required."""
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    value = F.trim(text).try_cast(kind)
    reason = F.when(blank, F.lit("missing") if required else F.lit(None).cast("string")).when(value.isNull(), f"not {kind}")
    return reason.when(F.abs(value) == float("inf"), "infinite") if kind in ("double", "float") else reason


def cell_errors(rows: DataFrame, key: str, columns: Mapping[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """key, column, text and reason of every wrong cell of text columns; ``columns`` says their types."""
    cell = lambda c, kind: F.struct(F.lit(c).alias("column"), F.col(c).alias("text"), wrong_cell(F.col(c), kind, c in required).alias("reason"))
    found = F.filter(F.array(*(cell(c, kind) for c, kind in columns.items())), lambda x: x["reason"].isNotNull())
    return rows.select(key, F.explode(found).alias("x")).select(key, "x.*")


def read_checked_rows(spark: SparkSession, path: str, columns: Mapping[str, str], required: tuple[str, ...] = (), sep: str = ",") -> Checked:
    """CSV files with a header, a record a line, values quoted by ``"`` (doubled inside).

    ``columns`` names the wanted columns and their types; others are left out, and a wanted one that the header lacks is
    an error of its own with null values. Lines equal to the header are headers, wherever they stand; blank lines are
    no rows. An odd number of quotes, or another number of values than the header has, makes a whole row wrong.
    """
    head = spark.read.option("header", True).option("sep", sep).csv(path).columns
    names = [c.lstrip("﻿").strip() for c in head]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.ltrim(F.rtrim("value", F.lit("\r")), F.lit("﻿")).alias("row"))
    plain = lambda x: F.replace(F.regexp_replace(x, r"\s", ""), F.lit('"'), F.lit(""))
    lines = lines.filter((F.trim("row") != "") & (plain(F.col("row")) != plain(F.lit(sep.join(names)))))
    outside = F.regexp_replace("row", '"(?:[^"]|"")*"', "")
    count = lambda x, what: F.char_length(x) - F.char_length(F.replace(x, F.lit(what), F.lit("")))
    quotes, values = count(F.col("row"), '"'), count(outside, sep) + 1
    reason = F.when(quotes % 2 == 1, "broken quotes").when(values < len(names), "too few values").when(values > len(names), "too many values")
    parsed = F.from_csv("row", ", ".join(f"c{i} string" for i in range(len(names))), {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    rows = lines.withColumn("bad", reason).withColumn("x", F.when(F.col("bad").isNull(), parsed))
    text = {c: F.col(f"x.c{names.index(c)}") if c in names else F.lit(None).cast("string") for c in columns}
    cell = lambda c, why: F.struct(F.lit(c).cast("string").alias("column"), why.alias("reason"))
    cells = [cell(c, wrong_cell(text[c], kind, c in required)) for c, kind in columns.items() if c in names]
    told = F.filter(F.array(cell(None, F.col("bad")), *(F.when(F.col("bad").isNull(), c) for c in cells)), lambda x: x["reason"].isNotNull())
    errors = rows.select("file", "row", F.explode(told).alias("e")).select("file", "row", "e.column", "e.reason")
    lacking = [(path, None, c, "missing column") for c in columns if c not in names]
    good = rows.filter("bad IS NULL").select("file", *(F.when(F.trim(text[c]) != "", F.trim(text[c]).try_cast(kind)).alias(c) for c, kind in columns.items()))
    return Checked(good, errors.unionByName(spark.createDataFrame(lacking, ERRORS)) if lacking else errors)


def _with_header(header: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [header]})
        yield from batches

    return run


CUSTOMERS = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int"}


def careless_customers(spark: SparkSession, sf_dir: str) -> Checked:
    """Customers written as CSV by a careless writer, and read back."""
    i, start = F.col("c_custkey"), F.concat(F.col("c_custkey"), F.lit(',"'), F.col("c_name"))
    line = (
        F.when(i % 11 == 0, F.concat(start, F.lit('"')))
        .when(i % 13 == 0, F.concat(start, F.lit('",'), "c_nationkey", F.lit(",x")))
        .when(i % 17 == 0, F.concat(start, F.lit('",n/a')))
        .when(i % 19 == 0, F.concat(start, F.lit(","), "c_nationkey"))
        .when(i % 23 == 0, F.concat(start, F.lit(', ""quoted"" and all", ')))
        .otherwise(F.concat(start, F.lit('",'), "c_nationkey"))
    )
    at = shared_path(spark, "careless")
    table(spark, sf_dir, "customer").select(line.alias("value")).mapInArrow(_with_header(",".join(CUSTOMERS)), "value string").write.text(at)
    return read_checked_rows(spark, at, CUSTOMERS, required=("c_nationkey",))


_LINE = """l AS (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN 0 WHEN c_custkey % 13 = 0 THEN 1 WHEN c_custkey % 17 = 0 THEN 2 WHEN c_custkey % 19 = 0 THEN 3 WHEN c_custkey % 23 = 0 THEN 4 ELSE 5 END AS k, c_custkey || ',"' || c_name AS s FROM customer)"""


@query("csv_errors", f"""WITH {_LINE} SELECT CASE k WHEN 0 THEN s || '"' WHEN 1 THEN s || '",' || c_nationkey || ',x' WHEN 2 THEN s || '",n/a' WHEN 3 THEN s || ',' || c_nationkey WHEN 4 THEN s || ', ""quoted"" and all", ' END AS row,
CASE WHEN k IN (2, 4) THEN 'c_nationkey' END AS "column", ['too few values', 'too many values', 'not int', 'broken quotes', 'missing'][k + 1] AS reason FROM l WHERE k < 5""")
def csv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each row of a careless CSV."""
    return careless_customers(spark, sf_dir).errors.drop("file")


@query("csv_rows", f"WITH {_LINE} SELECT c_custkey, CASE WHEN k = 4 THEN c_name || ', \"quoted\" and all' ELSE c_name END AS c_name, CASE WHEN k = 5 THEN c_nationkey::INT END AS c_nationkey FROM l WHERE k NOT IN (0, 1, 3)")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a careless CSV that have all their values, wrong cells null."""
    return careless_customers(spark, sf_dir).rows.drop("file")


@query("cell_errors", """WITH t AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN 'Infinity' WHEN 3 THEN '' ELSE value::VARCHAR END AS x FROM events)
SELECT event_id, 'x' AS "column", x AS text, CASE event_id % 9 WHEN 1 THEN 'not double' WHEN 2 THEN 'infinite' ELSE 'missing' END AS reason FROM t WHERE event_id % 9 < 4""")
def cell_errors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.expr("CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN 'Infinity' WHEN 3 THEN '' ELSE CAST(value AS STRING) END")
    return cell_errors(table(spark, sf_dir, "events").select("event_id", x.alias("x")), "event_id", {"x": "double"}, ("x",))
