"""An extension: dump files dropped into a folder become history rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hexdump import with_parsed


def uploads(spark: SparkSession, folder: str, dialect: str = "serve", files_per_batch: int = 1000) -> DataFrame:
    """A stream of sample_id, ts, file_size and the parsed dump of each new file."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select(name.alias("sample_id"), F.col("modificationTime").alias("ts"), F.col("length").alias("file_size"), "content")
    return with_parsed(rows, "content", {"parsed": dialect}).drop("content")


def append_history(stream: DataFrame, table_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append accepted uploads to the history; rejected ones are left out. Exactly once by file, through the checkpoint."""
    rows = stream.filter(~F.col("parsed.rejected")).select("sample_id", "ts", "file_size", "parsed.n_total", "parsed.n_known")
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(table_path)
