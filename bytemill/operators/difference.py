"""Differences of two whole tables, found by a tree of range fingerprints.

The ids' hashes are cut into ranges. A range's fingerprint (rows, sums and an exclusive or of row hashes) combines
map-side, so comparing two tables costs an aggregate of each to 2 ** BITS rows, whatever their size. Ranges that differ
are split again, and only the rows of those that still differ are shuffled, joined by id and compared column by column.
Equal tables are never joined.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.standins import SQL_SPLITS, splits
from ..plans.catalog import query
from ..sources.files import stored
from .tables import SQL_QUALITY, quality_table

#: Bits of the first ranges and of each split; ranges held at most; rows that are joined without splitting further.
BITS, MORE_BITS, MOST_RANGES, FEW_ROWS = 12, 6, 1 << 16, 100_000
SCHEMA = "id string, column string, stored string, expected string"


def _comparable(rows: DataFrame, key: str, numeric: Mapping[str, float], text: tuple[str, ...], side: str) -> DataFrame:
    """id, place, the columns and two row hashes. Numbers that are null or NaN equal nothing, so they hash by side; null texts are empty."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    out = rows.select(F.col(key).cast("string").alias("id"), *map(number, numeric), *map(word, text))
    cells = ["id", *(F.coalesce(F.col(c).cast("string"), F.lit(side)) for c in numeric), *text]
    return out.withColumns({"place": F.xxhash64("id"), "h1": F.xxhash64(*cells), "h2": F.xxhash64(F.lit(1), *cells)})


def _range(bits: int) -> Column:
    return F.shiftrightunsigned("place", 64 - bits).alias("range")


def fingerprints(rows: DataFrame, bits: int) -> DataFrame:
    """range, n and three digests; the sums take halves of a hash, so that no sum overflows."""
    low, high = F.col("h1").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h1", 32)
    return rows.groupBy(_range(bits)).agg(F.count("*").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.bit_xor("h2").alias("xor"))


def _unlike(a: DataFrame, b: DataFrame, bits: int) -> list[tuple[int, int]]:
    """The ranges whose fingerprints differ, and how many rows they hold."""
    digest = lambda rows, side: fingerprints(rows, bits).select("range", F.col("n").alias(f"n_{side}"), F.struct("n", "low", "high", "xor").alias(side))
    both = digest(a, "a").join(digest(b, "b"), "range", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    rows = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
    return [(r[0], r[1]) for r in both.select("range", rows).limit(MOST_RANGES + 1).collect()]


def _within(rows: DataFrame, ranges: list[int], bits: int) -> DataFrame:
    """Rows of the ranges, MOST_RANGES of them (8 bytes each) at most."""
    wanted = rows.sparkSession.createDataFrame([(r,) for r in ranges], "range long")
    return rows.withColumn("range", _range(bits)).join(F.broadcast(wanted), "range", "left_semi").drop("range")


def unlike_rows(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The rows of both tables in ranges that differ; None where the tables are equal."""
    bits, found = BITS, _unlike(a, b, BITS)
    if not found:
        return None
    while sum(n for _, n in found) > FEW_ROWS and len(found) << MORE_BITS <= MOST_RANGES and bits + MORE_BITS <= 60:
        held = [r for r, _ in found]
        finer = _unlike(_within(a, held, bits), _within(b, held, bits), bits + MORE_BITS)
        if 2 * sum(n for _, n in finer) > sum(n for _, n in found):
            break
        bits, found = bits + MORE_BITS, finer
    if len(found) > MOST_RANGES:
        return a, b
    held = [r for r, _ in found]
    return _within(a, held, bits), _within(b, held, bits)


def _by_id(rows: DataFrame, columns: list[str], side: str) -> DataFrame:
    """One row for each id, with how often it comes; equal ids combine map-side."""
    return rows.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias(f"n_{side}"), F.min(F.struct(*columns, "h1")).alias(side))


def table_difference(found: DataFrame, expected: DataFrame, key: str, numeric: Mapping[str, float] | None = None, text: tuple[str, ...] = ()) -> DataFrame:
    """(id, column, stored, expected) of all cells in which a stored table differs from the expected one.

    Numbers agree within a tolerance; null and NaN agree with nothing. Null texts are empty ones. An id that only one
    table has is a row with column ``missing_id`` or ``extra_id``; one that comes more than once in either is not compared
    and a row with ``repeated_id`` and both counts. Rows without an id give one row ``null_id`` with both counts.
    """
    numeric = numeric or {}
    columns = [*numeric, *text]
    sides = {side: _comparable(rows, key, numeric, text, side) for side, rows in (("a", found), ("b", expected))}
    unlike = unlike_rows(sides["a"], sides["b"])
    if unlike is None:
        return found.sparkSession.createDataFrame([], SCHEMA)
    a, b = unlike
    both = _by_id(a, columns, "a").join(_by_id(b, columns, "b"), "id", "full_outer")
    x, y = F.col("a"), F.col("b")
    same = {c: F.coalesce(F.abs(x[c] - y[c]) <= numeric[c], F.lit(False)) if c in numeric else x[c] == y[c] for c in columns}
    cell = lambda name, s, e: F.struct(F.lit(name).alias("column"), s.cast("string").alias("stored"), e.cast("string").alias("expected"))
    none, counts = F.lit(None), (F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))
    cells = F.array_compact(F.array(*(F.when(~ok, cell(c, x[c], y[c])) for c, ok in same.items()), F.when(F.lit(False), cell("", none, none))))
    told = (
        F.when((F.greatest(*counts)) > 1, F.array(cell("repeated_id", *counts)))
        .when(x.isNull(), F.array(cell("missing_id", none, none)))
        .when(y.isNull(), F.array(cell("extra_id", none, none)))
        .otherwise(cells)
    )
    rows = both.select("id", F.explode(told).alias("c")).select("id", "c.*")
    nulls = a.filter("id IS NULL").select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.filter("id IS NULL").select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    nulls = nulls.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a + b > 0")
    return rows.unionByName(nulls.select(none.cast("string").alias("id"), F.lit("null_id").alias("column"), F.col("a").cast("string").alias("stored"), F.col("b").cast("string").alias("expected")))


def difference_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(check, n) of ``table_difference``: for each column and fault of ids how many rows, 0 included."""
    names = ["missing_id", "extra_id", "repeated_id", "null_id", *columns]
    counts = rows.agg(*(F.count_if(F.col("column") == n).alias(n) for n in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in names))).alias("x")).select("x.*")


DATASET_NUMBERS, DATASET_TEXTS = {"class": 0.0, "unknown_ratio": 1e-12}, ("split", "image", "head_image", "mask", "quality")
DATASET = ("id", "class", "split", "image", "head_image", "mask", "unknown_ratio", "quality")
SOURCES = {"samples": ("id", "class", "split", "head_image"), "records": ("id", "image", "mask"), "quality": ("id", "unknown_ratio", "quality")}


def expected_dataset(sources: Mapping[str, DataFrame]) -> DataFrame:
    """The dataset as its three sources (see SOURCES) give it: one row for each id that all of them hold."""
    return reduce(lambda a, b: a.join(b, "id"), (sources[name].select(*columns) for name, columns in SOURCES.items())).select(*DATASET)


def verify_dataset(dataset: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """(source, id, column, stored, expected): where the sources' ids disagree, and each cell of the stored dataset that
    differs from a recomputation. Columns other than DATASET, or in another order, raise."""
    if tuple(dataset.columns) != DATASET:
        raise ValueError(f"the dataset's columns must be {DATASET}, not {tuple(dataset.columns)}")
    for name, columns in SOURCES.items():
        if missing := sorted(set(columns) - set(sources[name].columns)):
            raise ValueError(f"{name} lacks {missing}")
    parts = [table_difference(sources[name], sources["samples"], "id").withColumn("source", F.lit(name)) for name in ("records", "quality")]
    cells = table_difference(dataset, expected_dataset(sources), "id", DATASET_NUMBERS, DATASET_TEXTS).withColumn("source", F.lit("dataset"))
    return reduce(DataFrame.unionByName, [*parts, cells]).select("source", "id", "column", "stored", "expected")


def dataset_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stand-ins' three sources."""
    s = splits(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "class", "split")
    path = lambda root, end: F.concat_ws("/", F.lit(root), "split", F.concat(F.lit("class_"), F.col("class")), F.concat("id", F.lit(end)))
    q = quality_table(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "unknown_ratio", "quality")
    return {"samples": s.withColumn("head_image", path("heads", ".png")), "records": s.select("id", path("images", ".png").alias("image"), path("masks", ".png").alias("mask")), "quality": q}


def damaged_dataset(rows: DataFrame) -> DataFrame:
    """The dataset with faults planted by id: wrong cells, lost, repeated, renamed and missing ids."""
    i = F.col("id").cast("long")
    bad = rows.withColumns({
        "class": F.when(i % 97 == 3, F.lit(None)).otherwise(F.col("class")), "split": F.when(i % 89 == 5, "trial").otherwise(F.col("split")),
        "unknown_ratio": F.col("unknown_ratio") + F.when(i % 83 == 7, 1e-6).when(i % 83 == 8, 1e-14).otherwise(0.0), "quality": F.when(i % 79 == 1, F.lit(None)).otherwise(F.col("quality")),
        "mask": F.when(i % 73 == 2, F.concat(F.lit("../"), "mask")).otherwise(F.col("mask")),
    }).filter(i % 71 != 0)
    bad = bad.withColumn("copy", F.explode(F.when(i % 67 == 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    return bad.withColumn("id", F.when(i % 61 == 6, F.concat(F.lit("x-"), "id")).when(i % 59 == 9, F.lit(None)).otherwise(F.col("id")))


SQL_DATASET = f"""{SQL_SPLITS}, {SQL_QUALITY},
ex AS (SELECT s.doc_id, s.doc_id::VARCHAR AS id, class, split, concat_ws('/', 'images', split, 'class_' || class, s.doc_id || '.png') AS image, concat_ws('/', 'heads', split, 'class_' || class, s.doc_id || '.png') AS head_image,
       concat_ws('/', 'masks', split, 'class_' || class, s.doc_id || '.png') AS mask, unknown_ratio, quality FROM s JOIN q ON q.doc_id = s.doc_id),
sd AS (SELECT CASE WHEN doc_id % 61 = 6 THEN 'x-' || id WHEN doc_id % 59 = 9 THEN NULL ELSE id END AS id, CASE WHEN doc_id % 97 = 3 THEN NULL ELSE class END AS class, CASE WHEN doc_id % 89 = 5 THEN 'trial' ELSE split END AS split, image, head_image,
       CASE WHEN doc_id % 73 = 2 THEN '../' || mask ELSE mask END AS mask, unknown_ratio + CASE WHEN doc_id % 83 = 7 THEN 1e-6 ELSE 0 END AS unknown_ratio, CASE WHEN doc_id % 79 = 1 THEN NULL ELSE quality END AS quality,
       unnest(CASE WHEN doc_id % 67 = 4 THEN [1, 2] ELSE [1] END) AS copy FROM ex WHERE doc_id % 71 <> 0),
da AS (SELECT id, count(*) AS n, any_value(class) AS class, any_value(split) AS split, any_value(image) AS image, any_value(head_image) AS head_image, any_value(mask) AS mask, any_value(unknown_ratio) AS unknown_ratio, any_value(quality) AS quality FROM sd WHERE id IS NOT NULL GROUP BY id),
bo AS (SELECT coalesce(ex.id, da.id) AS k, da.n, ex.id AS e, da.id AS d, ex.* RENAME (id AS eid), da.class AS class2, da.split AS split2, da.mask AS mask2, da.unknown_ratio AS ratio2, da.quality AS quality2 FROM ex FULL JOIN da USING (id)),
dv AS (SELECT k AS id, 'repeated_id' AS col, n::VARCHAR AS stored, (e IS NOT NULL)::INT::VARCHAR AS expected FROM bo WHERE n > 1 UNION ALL SELECT k, 'missing_id', NULL, NULL FROM bo WHERE d IS NULL UNION ALL SELECT k, 'extra_id', NULL, NULL FROM bo WHERE e IS NULL AND n = 1
UNION ALL SELECT NULL, 'null_id', n::VARCHAR, '0' FROM (SELECT count(*) AS n FROM sd WHERE id IS NULL) WHERE n > 0
UNION ALL SELECT k, 'class', class2::VARCHAR, class::DOUBLE::VARCHAR FROM bo WHERE n = 1 AND e IS NOT NULL AND class2 IS NULL UNION ALL SELECT k, 'split', split2, split FROM bo WHERE n = 1 AND e IS NOT NULL AND split <> split2
UNION ALL SELECT k, 'mask', mask2, mask FROM bo WHERE n = 1 AND e IS NOT NULL AND mask <> mask2 UNION ALL SELECT k, 'quality', coalesce(quality2, ''), quality FROM bo WHERE n = 1 AND e IS NOT NULL AND quality <> coalesce(quality2, '')
UNION ALL SELECT k, 'unknown_ratio', round(ratio2, 7)::VARCHAR, round(unknown_ratio, 7)::VARCHAR FROM bo WHERE n = 1 AND e IS NOT NULL AND abs(ratio2 - unknown_ratio) > 1e-12)"""


@query("dataset_verify", f"""WITH {SQL_DATASET} SELECT 'dataset' AS source, id, col AS "column", CASE WHEN col = 'unknown_ratio' THEN (stored::DOUBLE * 1e7)::BIGINT::VARCHAR ELSE stored END AS stored, CASE WHEN col = 'unknown_ratio' THEN (expected::DOUBLE * 1e7)::BIGINT::VARCHAR ELSE expected END AS expected FROM dv""")
def dataset_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset written with faults, read back and compared with its sources. Ratios are told in units of 1e-7, which both engines write alike."""
    sources = dataset_sources(spark, sf_dir)
    rows = verify_dataset(stored(damaged_dataset(expected_dataset(sources)), "dataset"), sources)
    units = lambda c: F.when(F.col("column") == "unknown_ratio", F.round(F.col(c).try_cast("double") * 1e7).cast("long").cast("string")).otherwise(F.col(c)).alias(c)
    return rows.select("source", "id", "column", units("stored"), units("expected"))


_CHECKS = ("missing_id", "extra_id", "repeated_id", "null_id", *DATASET_NUMBERS, *DATASET_TEXTS)


@query("dataset_checks", f"""WITH {SQL_DATASET} SELECT c AS "check", count(*) FILTER (col = c) AS n FROM (SELECT unnest([{', '.join(f"'{c}'" for c in _CHECKS)}]) AS c) LEFT JOIN dv ON col = c GROUP BY c""")
def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = dataset_sources(spark, sf_dir)
    rows = verify_dataset(stored(damaged_dataset(expected_dataset(sources)), "dataset"), sources)
    return difference_counts(rows, [*DATASET_NUMBERS, *DATASET_TEXTS])
