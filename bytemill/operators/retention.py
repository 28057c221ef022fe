"""The history as a table that rows are really deleted from.

Rows lie in folders by day. A small report names the folders that count, with the rows and the least and largest id of
each, the last id given and the last batch of each stream. Every change writes new folders first and then replaces the
report at once; folders that no longer count are deleted after that. A run that fails in between leaves the old state.
Deleting whole days only changes the report: their files are not read, and those of days that stay are not touched; only
the day or the id range that a border cuts is written anew. One writer at a time; readers see the state before or after.

Ids go up by the order of time and are never given twice, also not after rows are deleted. A batch of a stream is known
by the stream's id and its number, so one that is replayed is not appended again, and one that failed before its report
gets the same ids when it is.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.ranking import kth_largest, numbered
from ..plans.catalog import query
from ..sources.files import _path, read_report, write_report
from ..sources.workspace import shared_path
from .history import history

NO_DAY = "__HIVE_DEFAULT_PARTITION__"
Place = tuple[str, str]


class HistoryTable:
    """Rows with ``ts`` and other columns, and the ids that the table gives them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def state(self) -> dict:
        """places ("folder/day" to rows, least id, largest id), last_id, batches (stream to number), schema."""
        return {"places": {}, "last_id": 0, "batches": {}, "schema": None} | read_report(self.spark, f"{self.path}/current.json")

    def _at(self, place: str) -> str:
        folder, day = place.split("/")
        return f"{self.path}/data/{folder}/day={day}"

    def _rows(self, places: list[str], state: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*map(self._at, places)) if places else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        state = self.state()
        return self._rows(sorted(state["places"]), state)

    def _write(self, rows: DataFrame) -> dict[str, list[int]]:
        """A new folder of rows by day, and what it holds: one row for each day comes to the driver."""
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        rows.withColumn("day", F.col("ts").cast("date")).hint("rebalance", "day").write.partitionBy("day").parquet(at)
        written = self.spark.read.schema(rows.schema).parquet(at)
        day = F.regexp_extract("_metadata.file_path", "/day=([^/]+)/", 1).alias("day")
        found = written.groupBy(day).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
        return {f"{folder}/{r.day}": [r.n, r.lo, r.hi] for r in found}

    def _commit(self, state: dict, gone: list[str]) -> None:
        write_report(self.spark, state, f"{self.path}/current.json")
        for place in gone:
            at, files = _path(self.spark, self._at(place))
            files.delete(at, True)

    def append(self, rows: DataFrame, stream: str = "", batch: int | None = None) -> int:
        """Append a batch, ids after the last one in the order of ``ts``, and return its rows; 0 for one that is there already."""
        state = self.state()
        if batch is not None and batch <= state["batches"].get(stream, -1):
            return 0
        new = numbered(rows, ["ts"]).withColumn("id", F.col("rank") + state["last_id"]).select("id", *(c for c in rows.columns if c != "id"))
        schema = new.schema.json()
        if state["schema"] not in (None, schema):
            raise ValueError("the table has other columns")
        made = self._write(new)
        n = sum(p[0] for p in made.values())
        state |= {"schema": schema, "last_id": state["last_id"] + n, "places": state["places"] | made}
        if batch is not None:
            state["batches"][stream] = batch
        self._commit(state, [])
        return n

    def _delete(self, choose: Callable[[str, list[int]], bool | None], keep: F.Column) -> int:
        """Drop the places that ``choose`` says True of, rewrite those that it says None of, and return how many rows went."""
        state = self.state()
        says = {place: choose(place.split("/")[1], held) for place, held in state["places"].items()}
        cut = sorted(p for p, s in says.items() if s is None)
        made = self._write(self._rows(cut, state).filter(keep)) if cut else {}
        gone = [p for p, s in says.items() if s is not False]
        before = sum(p[0] for p in state["places"].values())
        state["places"] = {p: held for p, held in state["places"].items() if says[p] is False} | made
        if gone:
            self._commit(state, gone)
        return before - sum(p[0] for p in state["places"].values())

    def delete_before(self, cutoff: datetime.datetime) -> int:
        """Rows strictly before a moment go; those without a time stay."""
        day = cutoff.date().isoformat()
        midnight = cutoff.time() == datetime.time()

        def choose(own: str, _: list[int]) -> bool | None:
            return False if own == NO_DAY or own > day or (own == day and midnight) else True if own < day else None

        return self._delete(choose, F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz"))

    def keep_newest(self, n: int) -> int:
        """All but the ``n`` rows with the largest ids go (0: all rows, n over the total: none)."""
        if n < 0:
            raise ValueError("n must not be negative")
        places = self.state()["places"]
        if n == 0:
            return self.clear()
        if n >= sum(p[0] for p in places.values()):
            return 0
        least = kth_largest(self.read().select("id"), "id", n)
        return self._delete(lambda _, held: False if held[1] >= least else True if held[2] < least else None, F.col("id") >= least)

    def clear(self) -> int:
        """All rows go; the next id stays what it was."""
        return self._delete(lambda *_: True, F.lit(False))

    def plan_before(self, cutoff: datetime.datetime) -> tuple[int, int]:
        """A dry run of ``delete_before``: how many rows go and stay. Only the border's day is read."""
        state = self.state()
        day = cutoff.date().isoformat()
        total = sum(p[0] for p in state["places"].values())
        whole = sum(p[0] for place, p in state["places"].items() if (own := place.split("/")[1]) != NO_DAY and own < day)
        border = [place for place in state["places"] if place.split("/")[1] == day]
        goes = whole + (self._rows(border, state).filter(F.col("ts") < F.lit(cutoff).cast("timestamp_ntz")).count() if border else 0)
        return goes, total - goes

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Append a stream's batches exactly once, with ids without gaps, however often it is restarted from its checkpoint."""

        def take(batch: DataFrame, number: int) -> None:
            self.append(batch, read_report(self.spark, f"{checkpoint}/metadata")["id"], number)

        writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def events_table(spark: SparkSession, sf_dir: str) -> HistoryTable:
    """The stand-in history as a table of its own, in two batches."""
    made = HistoryTable(spark, shared_path(spark, "history"))
    rows = history(spark, sf_dir).withColumnRenamed("id", "event")
    for part in (0, 1):
        made.append(rows.filter(F.col("event") % 2 == part), "events", part)
    return made


_TWO = "SELECT event_id AS event, ts, row_number() OVER (ORDER BY event_id % 2, ts) AS id FROM events"


@query("history_delete_before", f"SELECT event FROM ({_TWO}) WHERE ts >= TIMESTAMP '2024-01-05 13:30:00'")
def history_delete_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a delete that cuts a day in two."""
    rows = events_table(spark, sf_dir)
    rows.delete_before(datetime.datetime(2024, 1, 5, 13, 30))
    return rows.read().select("event")


@query("history_delete_oldest", f"SELECT id, ts FROM ({_TWO}) ORDER BY id DESC LIMIT 700")
def history_delete_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of two batches: the largest 700 ids, and when they happened."""
    rows = events_table(spark, sf_dir)
    rows.keep_newest(700)
    return rows.read().select("id", "ts")


@query("history_id_ranges", "SELECT event_id % 2 AS batch, count(*) AS n, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 1 + any_value(e) END AS first_id, CASE WHEN event_id % 2 = 0 THEN count(*) ELSE any_value(e) + count(*) END AS last_id FROM events, (SELECT count(*) AS e FROM events WHERE event_id % 2 = 0) GROUP BY event_id % 2")
def history_id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of both batches: one follows the other without a gap; replaying the second changes nothing."""
    made = events_table(spark, sf_dir)
    made.append(history(spark, sf_dir).withColumnRenamed("id", "event").filter("event % 2 = 1"), "events", 1)
    return made.read().groupBy((F.col("event") % 2).alias("batch")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
