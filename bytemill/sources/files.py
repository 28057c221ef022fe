"""Files in and out: tables, dumps, reports and published tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..functions.hexdump import with_parsed
from .workspace import shared_path


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Id (trimmed) and Class of a CSV; a blank Id or a missing Class raises when the rows are read."""
    rows = spark.read.schema("Id string, Class int").option("header", True).csv(path)
    name = F.trim("Id")
    bad = name.isNull() | (name == "") | F.col("Class").isNull()
    return rows.select(F.when(bad, F.raise_error(F.lit("labels need an Id and a Class"))).otherwise(name).alias("Id"), "Class")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV as trimmed text, null as empty; a byte-order mark is dropped."""
    rows = spark.read.option("header", True).csv(path)
    clean = {c: c.lstrip("﻿").strip() for c in rows.columns}
    return rows.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in clean.items()))


def read_json_object(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with one object, as one row; an array, a bare value or broken text raises."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value", F.lit(" \t\r\n\ufeff")).alias("t"))
    checked = F.when(F.col("t").startswith("{"), F.col("t")).otherwise(F.raise_error(F.lit("a JSON object is expected")))
    schema = spark.read.option("multiLine", True).json(path).schema
    return text.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_checked(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> tuple[DataFrame | None, list[str]]:
    """A CSV (Id as text, other columns inferred) and what is wrong with it, in place of an exception."""
    try:
        rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
        named = rows.withColumnsRenamed({c: c.lstrip("\ufeff").strip() for c in rows.columns})
    except AnalysisException as e:
        return None, [f"{path} can't be read: {str(e).splitlines()[0]}"]
    missing = sorted(set(required) - set(named.columns))
    if "Id" in named.columns:
        named = named.withColumn("Id", F.col("Id").cast("string"))
    return named, [f"{path} lacks {missing}"] if missing else []


def read_dumps(spark: SparkSession, path: str, dialect: str = "extract", pattern: str = "*.bytes") -> DataFrame:
    """sample_id (file name without suffix), path, file_size and ``parsed`` of every dump file under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    rows = files.select(name.alias("sample_id"), "path", F.col("length").alias("file_size"), "content")
    return with_parsed(rows, "content", {"parsed": dialect}).drop("content")


def write_samples(rows: DataFrame, path: str) -> None:
    """Samples by split and class, as folders that later reads prune by; an existing result is an error."""
    rows.write.mode("errorifexists").partitionBy("split", "class").parquet(path)


def write_csv(rows: DataFrame, path: str, bom: bool = False, order: tuple[str, ...] = ()) -> None:
    """CSV with a header; with ``bom`` every file begins with a byte-order mark; with ``order`` files follow each other in that order."""
    if order:
        rows = rows.orderBy(*order)
    if bom and rows.columns:
        rows = rows.withColumnRenamed(rows.columns[0], f"\ufeff{rows.columns[0]}")
    rows.write.mode("errorifexists").option("header", True).csv(path)


def inventory(spark: SparkSession, path: str, suffix: str) -> tuple[DataFrame, int]:
    """The paths below a folder (relative to it) of files with a suffix, and how many other files there are; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    root = _path(spark, path)[1].makeQualified(_path(spark, path)[0]).toString().rstrip("/")
    rows = files.select(F.substring("path", len(root) + 2, 1 << 20).alias("path"))
    good = F.lower("path").endswith(suffix)
    return rows.filter(good), rows.filter(~good).count()


def write_run(path: str, config: Mapping[str, object], history: DataFrame, metrics: Mapping[str, object]) -> None:
    """A run's settings, history (Parquet and CSV) and metrics in a new folder; one that is there raises."""
    spark = history.sparkSession
    target, fs = _path(spark, path)
    if fs.exists(target):
        raise ValueError(f"{path} is there already")
    write_report(spark, config, f"{path}/config.json")
    history.write.parquet(f"{path}/history")
    write_csv(history, f"{path}/history_csv", order=("epoch",))
    write_report(spark, metrics, f"{path}/metrics.json")


def _digest(columns: list[str]) -> list[Column]:
    """A digest of rows in any order, as aggregates that add up over files: counts and sums of halves of row hashes."""
    cells = [F.col(f"`{c}`") for c in columns]
    h = F.xxhash64(*cells, *(c.isNull() for c in cells)) if cells else F.lit(0).cast("long")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    add = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return [F.count(F.lit(1)).alias("n"), add(low).alias("low"), add(high).alias("high")]


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def _stage(rows: DataFrame, at: str) -> None:
    rows.write.mode("errorifexists").parquet(at)


def _file_digests(rows: DataFrame, columns: list[str]) -> DataFrame:
    """file (its name), n, low and high of each file of a table."""
    return rows.groupBy(F.regexp_extract("_metadata.file_path", "([^/]+)$", 1).alias("file")).agg(*_digest(columns))


def publish(rows: DataFrame, path: str, least_rows: int = 1, check: Callable[[DataFrame], bool] | None = None, facts: Mapping[str, object] | None = None) -> int:
    """A new version of a published table, in two phases.

    First the rows are written beside the other versions; their count and a digest of their contents are observed while
    they are. Then the files are read back: what they hold must be what was written, there must be enough rows, and
    ``check`` must agree; else they are deleted and ValueError raised. Only then the version is named the current one, by
    replacing a small file at once, together with a table of its files' counts and digests; ``facts`` about the version
    stand in that file, and so change with it. Readers of ``read_published`` see the old version or the new one.
    """
    spark = rows.sparkSession
    version = uuid.uuid4().hex
    at = f"{path}/versions/{version}"
    columns = [f.name for f in rows.schema if _hashable(f.dataType)]
    seen = Observation()
    _stage(rows.observe(seen, *_digest(columns)), at)
    staged = spark.read.schema(rows.schema).parquet(at)
    _file_digests(staged, columns).write.parquet(f"{path}/files/{version}")
    found = spark.read.parquet(f"{path}/files/{version}").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "low", "high"))).first()
    n = found.n
    if found.asDict() != seen.get or n < least_rows or (check is not None and not check(staged)):
        for where, fs in (_path(spark, at), _path(spark, f"{path}/files/{version}")):
            fs.delete(where, True)
        raise ValueError(f"{n} rows read back of {seen.get['n']} written (at least {least_rows} expected), or their contents or the check differ")
    write_report(spark, {"version": version, "rows": n, "columns": columns, "facts": dict(facts or {})}, f"{path}/current.json")
    return n


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table."""
    return spark.read.parquet(f"{path}/versions/{read_report(spark, f'{path}/current.json')['version']}")


def published_facts(spark: SparkSession, path: str) -> dict:
    """What was said about the current version of a published table."""
    return read_report(spark, f"{path}/current.json")["facts"]


def verify_published(spark: SparkSession, path: str) -> DataFrame:
    """(file, fault) of the current version's files that are missing, extra, or changed since they were published."""
    now = read_report(spark, f"{path}/current.json")
    known = spark.read.parquet(f"{path}/files/{now['version']}")
    found = _file_digests(read_published(spark, path), now["columns"]).select(F.col("file").alias("file_"), F.struct("n", "low", "high").alias("now"))
    # Files without rows are in neither.
    both = known.select("file", F.struct("n", "low", "high").alias("then")).join(found, F.col("file") == F.col("file_"), "full_outer")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "extra").when(F.col("now") != F.col("then"), "changed")
    return both.select(F.coalesce("file", "file_").alias("file"), fault.alias("fault")).filter("fault IS NOT NULL")


def stored(rows: DataFrame, name: str, least_rows: int = 0) -> DataFrame:
    """``rows`` published in the shared folder and read back: computed once, whatever reads them."""
    at = shared_path(rows.sparkSession, name)
    publish(rows, at, least_rows)
    return read_published(rows.sparkSession, at)


def write_features(path: str, tables: Mapping[str, DataFrame], summary: Mapping[str, object]) -> None:
    """A feature set: one Parquet table for each part (samples, sequences, entropy, ngram_1 ..., vocabularies) and its summary."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
    first = next(iter(tables.values()))
    write_report(first.sparkSession, summary, f"{path}/summary.json")


def read_features(spark: SparkSession, path: str, parts: tuple[str, ...], ngrams: tuple[int, ...] | None = None) -> tuple[DataFrame, dict]:
    """A feature set's parts joined by sample id, one row each, and the summary; the n-gram parts follow from it (1 and 2 without)."""
    summary = read_report(spark, f"{path}/summary.json")
    chosen = ngrams or tuple(summary.get("ngrams", (1, 2)))
    names = (*parts, *(f"ngram_{n}" for n in chosen))
    rows = spark.read.parquet(f"{path}/{names[0]}")
    for name in names[1:]:
        rows = rows.join(spark.read.parquet(f"{path}/{name}"), "id")
    return rows, summary


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_report(spark: SparkSession, report: Mapping[str, object], path: str) -> None:
    """A small JSON report, written beside its place and moved there at once."""
    text = json.dumps(report, ensure_ascii=False, indent=1)
    staged, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    sc = spark.sparkContext
    options = sc._jvm.org.apache.hadoop.fs.Options.Rename
    over = sc._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), sc._jsc.hadoopConfiguration()).rename(staged, _path(spark, path)[0], over)


def read_report(spark: SparkSession, path: str) -> dict:
    """The report at ``path``; an empty one where there is none."""
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return {}
    text = spark.read.text(path, wholetext=True).first()
    return json.loads(text.value) if text else {}


def update_report(spark: SparkSession, path: str, changes: Mapping[str, object], drop: tuple[str, ...] = ()) -> dict:
    """The report with blocks replaced and keys dropped, written in its place."""
    report = {k: v for k, v in read_report(spark, path).items() if k not in drop} | dict(changes)
    write_report(spark, report, path)
    return report
