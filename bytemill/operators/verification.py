"""Data-quality checks: constants, leaks, collisions, mismatches, cell quality and the combined report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.standins import SQL_SPLITS, splits
from ..plans.catalog import query, table
from .tables import SQL_QUALITY, quality_table


def constant_columns(rows: DataFrame) -> DataFrame:
    """column, constant: whether a column has one value at most, null counted as one. Minima and maxima only, in one pass."""
    tests = [((F.count(c) == 0) | ((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)))).alias(c) for c in rows.columns]
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit(True)).alias("constant")) for c in rows.columns))
    return rows.agg(*tests).select(F.explode(each).alias("x")).select("x.*")


@query("constant_columns", """WITH f AS (SELECT l_linenumber, l_returnflag, 1 AS one, NULL::INT AS nothing, CASE WHEN l_linenumber = 1 THEN NULL ELSE 5 END AS five FROM lineitem)
SELECT 'l_linenumber' AS "column", count(DISTINCT l_linenumber) + max((l_linenumber IS NULL)::INT) <= 1 AS constant FROM f UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) <= 1 FROM f
UNION ALL SELECT 'one', true UNION ALL SELECT 'nothing', true UNION ALL SELECT 'five', count(DISTINCT five) + max((five IS NULL)::INT) <= 1 FROM f""")
def constant_columns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", F.lit(1).alias("one"), F.lit(None).cast("int").alias("nothing"), F.expr("if(l_linenumber = 1, null, 5)").alias("five"))
    return constant_columns(rows)


def constant_report(rows: DataFrame, before: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(feature, value) of all constant columns but ``keys``, in place of what an earlier report said of the table's columns;
    what it said of others stays. One pass over the table; values are text."""
    columns = [c for c in rows.columns if c not in keys]
    found = constant_columns(rows.select(*columns)).filter("constant").select(F.col("column").alias("feature"))
    firsts = rows.agg(*(F.first(F.col(f"`{c}`").cast("string"), ignorenulls=True).alias(c) for c in columns))
    values = firsts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("value")) for c in columns))).alias("x")).select("x.*")
    now = found.join(values, "feature")
    if before is None:
        return now
    kept = before.select("feature", "value").filter(~F.col("feature").isin(*rows.columns))
    return kept.groupBy("feature").agg(F.max("value").alias("value")).unionByName(now)


@query("constant_report", """SELECT 'one' AS feature, '1' AS value UNION ALL SELECT 'nothing', NULL UNION ALL SELECT 'gone', 'old'
UNION ALL SELECT 'l_linenumber', any_value(l_linenumber)::VARCHAR FROM lineitem HAVING count(DISTINCT l_linenumber) = 1""")
def constant_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier report that knows a column which is gone, and one that is constant no more."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1).alias("one"), F.lit(None).cast("int").alias("nothing"))
    before = spark.createDataFrame([("gone", "old"), ("l_linenumber", "7"), ("one", "2")], "feature string, value string")
    return constant_report(rows, before, ("l_orderkey",))


def fill_hashes(rows: DataFrame, files: DataFrame, path: str, hash_: str, content: str = "content") -> DataFrame:
    """``rows`` with the SHA-256 of the file at ``path`` where ``hash_`` is null or empty; a row whose file is missing then raises
    when it is read. Contents are hashed only of files that rows without a hash name."""
    if hash_ not in rows.columns:
        rows = rows.withColumn(hash_, F.lit(None).cast("string"))
    lacking = F.coalesce(F.col(hash_), F.lit("")) == ""
    wanted = rows.filter(lacking).select(F.col(path).alias("path_")).distinct()
    hashed = files.join(wanted, F.col("path") == F.col("path_"), "left_semi").select(F.col("path").alias("path_"), F.sha2(content, 256).alias("sha_"))
    out = rows.join(hashed, F.col(path) == F.col("path_"), "left")
    missing = F.raise_error(F.concat(F.lit("no file at "), F.coalesce(F.col(path), F.lit("null")))).cast("string")
    return out.select(*(F.when(~lacking, F.col(c)).when(F.col("sha_").isNotNull(), F.col("sha_")).otherwise(missing).alias(c) if c == hash_ else F.col(c) for c in rows.columns))


@query("fill_hashes", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'known' ELSE sha256(coalesce(text, '')) END AS sha256 FROM documents")
def fill_hashes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents lack their hash."""
    d = table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    rows = d.select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("at"), F.when(F.col("doc_id") % 3 == 0, "known").when(F.col("doc_id") % 3 == 1, "").alias("sha256"))
    return fill_hashes(rows, files, "at", "sha256").select("doc_id", "sha256")


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys found in more than one split; nulls are no key. One row a key; minima and maxima combine map-side."""
    g = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(split).alias("lo"), F.max(split).alias("hi"), F.count("*").alias("n"))
    return g.filter("lo <> hi").select(key, "n")


SQL_HASHED = f"{SQL_SPLITS}, h AS (SELECT s.doc_id, s.class, s.split, sha256(d.text) AS hash FROM s JOIN documents d USING (doc_id))"


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return splits(spark, sf_dir).join(d, "doc_id")


@query("cross_split_leak", f"WITH {SQL_HASHED} SELECT hash, count(*) AS n FROM h WHERE hash IS NOT NULL GROUP BY hash HAVING count(DISTINCT split) > 1")
def cross_split_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(hashed(spark, sf_dir), "hash")


def collisions(rows: DataFrame, key: str) -> DataFrame:
    """One row: groups of equal key, those with more than one sample, their samples and extras, the largest, and groups across classes and splits."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), (F.min("class") != F.max("class")).alias("x_class"), (F.min("split") != F.max("split")).alias("x_split"))
    many = F.col("n") > 1
    add = lambda x: F.coalesce(F.sum(F.when(many, x)), F.lit(0)).cast("long")
    return g.agg(
        F.count("*").alias("n_hashes"), F.count_if(many).alias("n_groups"), add(F.col("n")).alias("n_samples"), add(F.col("n") - 1).alias("n_extra"),
        F.coalesce(F.max(F.when(many, F.col("n"))), F.lit(1)).cast("long").alias("largest"), F.count_if(many & F.col("x_class")).alias("n_cross_class"), F.count_if(many & F.col("x_split")).alias("n_cross_split"),
    )


@query("collision_stats", f"""WITH {SQL_HASHED}, g AS (SELECT hash, count(*) AS n, count(DISTINCT class) > 1 AS xc, count(DISTINCT split) > 1 AS xs FROM h GROUP BY hash)
SELECT count(*) AS n_hashes, count(*) FILTER (n > 1) AS n_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_samples, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS n_extra,
coalesce(max(n) FILTER (n > 1), 1)::BIGINT AS largest, count(*) FILTER (n > 1 AND xc) AS n_cross_class, count(*) FILTER (n > 1 AND xs) AS n_cross_split FROM g""")
def collision_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions(hashed(spark, sf_dir), "hash")


def mismatches(left: DataFrame, right: DataFrame, key: str, numeric: Mapping[str, float], text: tuple[str, ...] = ()) -> DataFrame:
    """column, n_mismatched over the keys of both: numbers within a tolerance (null never equal), texts with null as empty."""
    a, b = (x.select(key, *(F.col(c).alias(f"{side}_{c}") for c in (*numeric, *text))) for x, side in ((left, "a"), (right, "b")))

    def off(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return ~F.coalesce(F.abs(x - y) <= numeric[c], F.lit(False)) if c in numeric else F.coalesce(x, F.lit("")) != F.coalesce(y, F.lit(""))

    counts = a.join(b, key).agg(*(F.count_if(off(c)).alias(c) for c in (*numeric, *text)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_mismatched")) for c in (*numeric, *text)))).alias("x")).select("x.*")


@query("manifest_mismatch", f"""WITH {SQL_QUALITY}, o AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN unknown_ratio + 0.001 ELSE unknown_ratio END AS unknown_ratio,
CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE reason END AS reason FROM q)
SELECT 'unknown_ratio' AS "column", count(*) FILTER (NOT coalesce(abs(q.unknown_ratio - o.unknown_ratio) <= 1e-12, false)) AS n_mismatched FROM q JOIN o USING (doc_id)
UNION ALL SELECT 'reason', count(*) FILTER (coalesce(q.reason, '') <> coalesce(o.reason, '')) FROM q JOIN o USING (doc_id)""")
def manifest_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality table against a copy in which some rows were changed."""
    q = quality_table(spark, sf_dir)
    ratio = F.expr("CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN unknown_ratio + 0.001 ELSE unknown_ratio END")
    other = q.withColumns({"unknown_ratio": ratio, "reason": F.expr("if(doc_id % 11 = 0, 'other', reason)")})
    return mismatches(q, other, "doc_id", {"unknown_ratio": 1e-12}, ("reason",))


SQL_CELLS = """t AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN 'Infinity' ELSE value::VARCHAR END AS x FROM events)"""


def text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.expr("CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN 'Infinity' ELSE CAST(value AS STRING) END")
    return table(spark, sf_dir, "events").select("event_id", x.alias("x"))


def cell_quality(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Missing, non-numeric and infinite cells of text columns, in one pass."""
    number = {c: F.col(c).try_cast("double") for c in columns}
    total = lambda f: sum((F.count_if(f(c)) for c in columns[1:]), F.count_if(f(columns[0])))
    return rows.agg(
        total(lambda c: F.col(c).isNull()).alias("n_missing"), total(lambda c: F.col(c).isNotNull() & number[c].isNull()).alias("n_non_numeric"),
        total(lambda c: F.coalesce(F.abs(number[c]) == float("inf"), F.lit(False))).alias("n_infinite"),
    )


@query("cell_quality", f"""WITH {SQL_CELLS} SELECT count(*) FILTER (x IS NULL) AS n_missing, count(*) FILTER (x IS NOT NULL AND try_cast(x AS DOUBLE) IS NULL) AS n_non_numeric,
count(*) FILTER (isinf(try_cast(x AS DOUBLE))) AS n_infinite FROM t""")
def cell_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_quality(text_cells(spark, sf_dir), ("x",))


@query("numeric_parse", f"""WITH {SQL_CELLS} SELECT event_id, CASE WHEN isinf(try_cast(x AS DOUBLE)) THEN NULL ELSE try_cast(x AS DOUBLE) END AS number,
coalesce(try_cast(x AS DOUBLE) = floor(try_cast(x AS DOUBLE)) AND NOT isinf(try_cast(x AS DOUBLE)), false) AS is_integer FROM t""")
def numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("x").try_cast("double")
    finite = F.when(F.abs(n) != float("inf"), n)
    return text_cells(spark, sf_dir).select("event_id", finite.alias("number"), F.coalesce(finite == F.floor(finite), F.lit(False)).alias("is_integer"))


def normalize_bool(value: Column) -> Column:
    """true, false, 1 and 0 as booleans, whatever the case and blanks; else null."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


@query("bool_normalize", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag FROM events""")
def bool_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("TRUE", " false ", "1", "0", "yes", ""))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", normalize_bool(raw).alias("flag"))


@query("weighted_ratio", """SELECT (doc_id % 9 + 1)::INT AS class, round(sum(length(regexp_replace(text, '[A-Za-z ]', '', 'g'))) / sum(length(text)), 9) AS ratio FROM documents GROUP BY 1""")
def weighted_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.char_length(F.regexp_replace("text", "[A-Za-z ]", ""))
    g = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 9 + 1).cast("int").alias("class"))
    return g.agg(F.round(F.sum(odd) / F.sum(F.char_length("text")), 9).alias("ratio"))


@query("id_pattern", "SELECT url, regexp_full_match(page_id::VARCHAR, '[A-Za-z0-9]+') AS good_id, lower(regexp_extract(url, '\\.[A-Za-z0-9]+$')) AS suffix FROM pages")
def id_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-string id pattern and the lower-cased suffix of a name."""
    p = table(spark, sf_dir, "pages")
    return p.select("url", F.col("page_id").cast("string").rlike("^[A-Za-z0-9]+$").alias("good_id"), F.lower(F.regexp_extract("url", r"\.[A-Za-z0-9]+$", 0)).alias("suffix"))


@query("class_set_check", f"""WITH {SQL_SPLITS} SELECT split, list_sort(list(DISTINCT class)) = range(1, 10) AS every_class FROM s GROUP BY split""")
def class_set_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = splits(spark, sf_dir).groupBy("split").agg(F.array_sort(F.collect_set("class")).alias("found"))
    return g.select("split", (F.col("found") == F.array(*(F.lit(i) for i in range(1, 10)))).alias("every_class"))
