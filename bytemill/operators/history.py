"""The classification history: pages, point lookups, tolerant detail decoding and retention plans.

Retention as a query gives the rows that stay; ``retention`` deletes from a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from ..plans.catalog import query, table

DEFAULT_PAGE = 20


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in: events as records."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("family"), F.col("value").alias("confidence"), F.col("props").alias("details"))


def page(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest rows; a missing limit or one below 1 is the default page."""
    return rows.orderBy(F.desc("id")).limit(limit if limit and limit >= 1 else DEFAULT_PAGE)


def keep_newest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest rows (0: none; n over the total: all), by a top-n and a filter on its least id, not a global window."""
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return rows.limit(0)
    least = rows.select("id").orderBy(F.desc("id")).limit(n).agg(F.min("id")).first()[0]
    return rows if least is None else rows.filter(F.col("id") >= least)


def keep_since(rows: DataFrame, cutoff: str) -> DataFrame:
    """Rows from a day's beginning on; rows strictly before it go."""
    return rows.filter(F.col("ts") >= F.to_timestamp_ntz(F.lit(f"{cutoff} 00:00:00")))


def cutoff_day(days: int, today: Column | None = None) -> Column:
    """The UTC day so many days ago, at its beginning."""
    if days < 0:
        raise ValueError("days must not be negative")
    now = today if today is not None else F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))
    return F.date_sub(now, days).cast("timestamp_ntz")


def keep_days(rows: DataFrame, days: int, today: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` days and of today."""
    return rows.filter(F.col("ts") >= cutoff_day(days, today))


def plan(rows: DataFrame, goes: Column) -> DataFrame:
    """A dry run: how many rows go and how many stay."""
    return rows.agg(F.count_if(goes).alias("to_delete"), F.count_if(~goes).alias("remaining"))


@query("history_page", "SELECT event_id AS id, event_type AS family, round(value, 4) AS confidence FROM events ORDER BY event_id DESC LIMIT 20")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(history(spark, sf_dir)).select("id", "family", F.round("confidence", 4).alias("confidence"))


@query("history_detail", "SELECT event_id AS id, event_type AS family, value AS confidence, props AS details FROM events WHERE event_id = 77")
def history_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).filter("id = 77").drop("ts")


@query("history_json", "SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE (props::JSON ->> 'k')::INT END AS k FROM events")
def history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored details decoded; broken ones (every tenth is broken here) give null."""
    text = F.when(F.col("id") % 10 == 0, F.concat(F.lit("{"), "details")).otherwise(F.col("details"))
    return history(spark, sf_dir).select("id", F.from_json(text, "k int")["k"].alias("k"))


@query("history_keep_n", "SELECT event_id AS id FROM events ORDER BY event_id DESC LIMIT 500")
def history_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_newest(history(spark, sf_dir), 500).select("id")


@query("history_before", "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00'")
def history_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_since(history(spark, sf_dir), "2024-01-05").select("id")


@query("history_plan", "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-05') AS to_delete, count(*) FILTER (ts >= TIMESTAMP '2024-01-05') AS remaining FROM events")
def history_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(history(spark, sf_dir), F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00")))


@query("history_days", "SELECT event_id AS id FROM events WHERE ts >= (SELECT max(ts)::DATE FROM events) - INTERVAL 7 DAY")
def history_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week of retention, counted from the newest record's day."""
    rows = history(spark, sf_dir)
    last = rows.agg(F.max("ts").cast("date").alias("d")).first().d
    return keep_days(rows, 7, F.lit(last)).select("id")


def with_next_ids(batch: DataFrame, order: str, last: int) -> DataFrame:
    """``batch`` with ids after ``last``, in the order of a column, whatever its values are."""
    return numbered(batch, [order]).withColumn("id", F.col("rank") + last).drop("rank")


@query("history_next_ids", "SELECT item_id, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY item_id) AS id FROM benchmark")
def history_next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for a batch to append: after the largest so far, in the batch's order."""
    last = history(spark, sf_dir).agg(F.max("id")).first()[0] or 0
    return with_next_ids(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", last)


@query("history_by_family", "SELECT event_type AS family, count(*) AS n, round(avg(value), 6) AS mean_confidence, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def history_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def create_table(spark: SparkSession, name: str) -> None:
    """The history as a catalog table, made if it is missing; columns that an older one lacks are added."""
    columns = {"id": "BIGINT", "filename": "STRING", "predicted_family": "STRING", "confidence": "DOUBLE", "file_size": "BIGINT", "ts": "TIMESTAMP_NTZ", "top5_json": "STRING", "attention_json": "STRING"}
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'{c} {t}' for c, t in columns.items())}) USING parquet")
    have = {c.name for c in spark.catalog.listColumns(name)}
    new = [f"{c} {t}" for c, t in columns.items() if c not in have]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(new)})")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def record_row(rows: DataFrame, top5: str = "top5", attention: str = "attention") -> DataFrame:
    """Details as JSON text; an empty or missing one is stored as null."""
    text = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    return rows.withColumns({"top5_json": text(top5), "attention_json": text(attention)}).drop(top5, attention)


@query("history_record_json", """SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE '[' || array_to_string(list_transform(range(1, 4), lambda i: '{"family":"f' || i || '","rank":' || i || '}'), ',') || ']' END AS top5_json, NULL::VARCHAR AS attention_json FROM embeddings""")
def history_record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda i: F.struct(F.concat(F.lit("f"), i).alias("family"), i.alias("rank"))
    top5 = F.when(F.col("vec_id") % 4 != 0, F.transform(F.sequence(F.lit(1), F.lit(3)), item))
    return record_row(table(spark, sf_dir, "embeddings").select("vec_id", top5.alias("top5"), F.array().cast("array<array<double>>").alias("attention")))
