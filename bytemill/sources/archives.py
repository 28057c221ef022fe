"""ZIP archives of dumps, read and written in parts by many tasks.

An archive is read as text whose lines end with the signature of a local header. Spark splits such a file like any other
text, so the parts of one archive go to different tasks, through any file system that Spark reads. The pieces between
signatures are written to the shared folder once; all that follows works on their places: sums of their lengths give
each piece's offset, the last pieces hold the central directory, and what the directory lists is joined with the pieces
by offset. Only pieces of wanted entries are inflated. A signature that stands inside an entry by chance, or because
the entry is an archive itself, makes more pieces of it, which are put together again.

One entry and the directory of one archive must be below 2 GB each. Encrypted entries, methods other than stored and
deflated, archives without an end record, and contents that don't match their length and CRC-32 raise when the rows are
read. Files without any byte are left out.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import shared_path

SUFFIXES = (".bytes", ".asm")
# Signatures of the format.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
#: Bytes at an archive's end that hold the end record with the longest comment, and the records before it.
TAIL = 66_000
#: Rows (about 200 bytes each) that are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 100_000
#: Pieces are packed already, so row groups are as large as they say: neither writing nor reading holds more.
_GROUPS = {"compression": "none", "parquet.block.size": "16777216", "parquet.page.size.row.check.min": "1"}
_KEYS = ["archive", "block", "seq"]


def _kept(rows: DataFrame, at: str) -> DataFrame:
    rows.write.options(**_GROUPS).parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(MOST_SENT + 1).count() <= MOST_SENT else rows


def _pieces(spark: SparkSession, path: str, at: str) -> tuple[DataFrame, DataFrame]:
    """What stands between signatures (archive, block, seq, data), and where: ``start`` is the offset of the signature before a piece."""
    lines = spark.read.option("lineSep", LOCAL.decode()).option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).text(path)
    places = [F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")]
    data = _kept(lines.select(*places, F.col("value").cast("binary").alias("data")).withColumn("n", F.octet_length("data").cast("long")), f"{at}/pieces")
    light = data.select(*_KEYS, "n")
    blocks = light.groupBy("archive", "block").agg(F.sum(F.col("n") + len(LOCAL)).alias("total"))
    before = Window.partitionBy("archive").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("archive", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("archive", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = light.withColumn("within", F.coalesce(F.sum(F.col("n") + len(LOCAL)).over(inside), F.lit(0)))
    start = F.col("before") + F.col("within") - len(LOCAL)
    return data, _kept(within.join(blocks, ["archive", "block"]).select(*_KEYS, "n", start.alias("start")), f"{at}/places")


def _put_together(data: DataFrame, places: DataFrame) -> DataFrame:
    """archive, from (offset of the first) and the bytes of the pieces at these places, one row for each archive."""
    rows = data.drop("n").join(_few(places), _KEYS)
    each = rows.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("start", "data"))).alias("p"))
    parts = F.transform("p", lambda p: F.hex(p["data"]))
    return each.select("archive", F.col("p")[0]["start"].alias("from"), F.unhex(F.array_join(parts, LOCAL.hex().upper())).alias("bytes"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each archive's directory begins and ends, and how far its offsets are off (bytes before the archive)."""
    for batch in batches:
        for row in batch.to_pylist():
            raw, base = row["bytes"], row["from"] + len(LOCAL)
            at = raw.rfind(END)
            if at < 0:
                raise ValueError(f"{row['archive']} has no end record")
            size, offset = struct.unpack_from("<II", raw, at + 12)
            last = at
            if at >= 20 and raw[at - 20 : at - 16] == LOCATOR and 0xFFFFFFFF in (size, offset) or struct.unpack_from("<H", raw, at + 10)[0] == 0xFFFF and raw[at - 20 : at - 16] == LOCATOR:
                last = raw.rfind(END64, 0, at)
                size, offset = struct.unpack_from("<QQ", raw, last + 40)
            begin = base + last - size
            yield pa.RecordBatch.from_pydict({"archive": [row["archive"]], "begin": [begin], "end": [begin + size], "shift": [begin - offset]})


_ENTRY = "archive string, place long, entry string, flags int, method int, crc long, compress_size long, file_size long, start long"


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _ENTRY.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
    for batch in batches:
        for row in batch.to_pylist():
            raw, at, made = row["bytes"], row["begin"] - row["from"] - len(LOCAL), []
            end = at + row["end"] - row["begin"]
            while at + 46 <= end and raw[at : at + 4] == CENTRAL:
                flags, method, _, _, crc, packed, size, n, extra, comment, _, _, _, offset = struct.unpack_from("<HHHHIIIHHHHHII", raw, at + 8)
                name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
                wide = [size, packed, offset]
                x, stop = at + 46 + n, at + 46 + n + extra
                while x + 4 <= stop:
                    kind, length = struct.unpack_from("<HH", raw, x)
                    if kind == 1:
                        values = iter(struct.unpack_from(f"<{length // 8}Q", raw, x + 4))
                        wide = [next(values, v) if v == 0xFFFFFFFF else v for v in wide]
                    x += 4 + length
                made.append((row["archive"], len(made), name, flags, method, crc, wide[1], wide[0], wide[2] + row["shift"]))
                at = stop + comment
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names)


def safe_name(entry: Column) -> Column:
    """Whether a name stays below the folder it is extracted to: not absolute, no drive, no ``..`` between any kind of slash."""
    slashed = F.replace(entry, F.lit("\\"), F.lit("/"))
    return ~slashed.startswith("/") & ~slashed.rlike("^[A-Za-z]:") & ~F.array_contains(F.split(slashed, "/"), "..")


def _named(entries: DataFrame) -> DataFrame:
    """Dumps and listings with safe names, with sample_id, kind, and ``duplicate`` for all but the first of a name and kind."""
    low = F.lower("entry")
    wanted = entries.filter(safe_name(F.col("entry")) & low.rlike(f"({'|'.join(map(re.escape, SUFFIXES))})$"))
    base = F.element_at(F.split(F.replace("entry", F.lit("\\"), F.lit("/")), "/"), -1)
    wanted = wanted.withColumns({"sample_id": F.regexp_replace(base, r"\.[^.]*$", ""), "kind": F.regexp_extract(low, r"([^.]+)$", 1)})
    firsts = wanted.groupBy("sample_id", "kind").agg(F.min(F.struct("archive", "place")).alias("first"))
    return wanted.join(firsts, ["sample_id", "kind"]).withColumn("duplicate", F.struct("archive", "place") != F.col("first")).drop("first")


def _listed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pieces, the places of all of them, and the entries of all directories."""
    at = shared_path(spark, "archives")
    data, places = _pieces(spark, path, at)
    length = places.groupBy("archive").agg(F.max(F.col("start") + len(LOCAL) + F.col("n")).alias("length"))
    tails = places.join(length, "archive").filter(F.col("start") + len(LOCAL) + F.col("n") > F.col("length") - TAIL)
    ends = _kept(_put_together(data, tails.select(*_KEYS, "start")).mapInArrow(_ends, "archive string, begin long, end long, shift long"), f"{at}/ends")
    listed = places.join(ends, "archive").filter((F.col("start") + len(LOCAL) + F.col("n") > F.col("begin")) & (F.col("start") < F.col("end")))
    entries = _put_together(data, listed.select(*_KEYS, "start")).join(ends, "archive").mapInArrow(_directory, _ENTRY)
    return data, places, _kept(entries, f"{at}/entries")


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, place, entry, method, crc, compress_size, file_size of everything that the archives under a path list; nothing is inflated."""
    return _listed(spark, path)[2].drop("flags", "start")


_CONTENT = ["archive", "place", "entry", "sample_id", "kind", "file_size", "compress_size", "duplicate"]


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.select(_CONTENT)
        for i in range(batch.num_rows):
            flags, method, crc, packed, size, entry = (batch.column(c)[i].as_py() for c in ("flags", "method", "crc", "compress_size", "file_size", "entry"))
            parts = batch.column("parts")[i].as_py()
            raw = LOCAL.join(p["data"] for p in parts)
            if flags & 1 or method not in (0, 8):
                raise ValueError(f"{entry} is encrypted or packed by method {method}")
            n, extra = struct.unpack_from("<HH", raw, 22)
            payload = raw[26 + n + extra : 26 + n + extra + packed]
            content = payload if method == 0 else zlib.decompressobj(-15).decompress(payload)
            if len(content) != size or zlib.crc32(content) != crc:
                raise ValueError(f"{entry} is damaged")
            yield pa.RecordBatch.from_arrays([*own.slice(i, 1).columns, pa.array([content], pa.binary())], [*_CONTENT, "content"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each dump or listing in the ZIP archives under a path: archive, place (in its directory), entry,
    sample_id, kind, file_size, compress_size, duplicate (all but the first of a name and kind), content.

    Folders, other suffixes and unsafe names are left out.
    """
    data, places, entries = _listed(spark, path)
    # The entry that a piece belongs to begins at the last listed offset up to its own: in its block, or in one before.
    marked = places.join(entries.select("archive", "start", F.col("start").alias("own")), ["archive", "start"], "left")
    so_far = Window.partitionBy("archive", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    blocks = marked.groupBy("archive", "block").agg(F.max("own").alias("last"))
    before = Window.partitionBy("archive").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("archive", "block", F.max("last").over(before).alias("earlier"))
    owned = marked.withColumn("near", F.max("own").over(so_far)).join(blocks, ["archive", "block"])
    owned = owned.select(*_KEYS, "start", F.coalesce("near", "earlier").alias("owner"))
    wanted = _named(entries).withColumnRenamed("start", "owner")
    # Pieces past an entry's payload (of entries that no directory lists) aren't its own.
    most = F.col("owner") + 30 + 2 * 65536 + F.col("compress_size")
    pieces = owned.join(wanted, ["archive", "owner"]).filter(F.col("start") < most)
    several = pieces.filter("start <> owner").select("archive", "owner").distinct().withColumn("several", F.lit(True))
    pieces = _kept(pieces.join(several, ["archive", "owner"], "left"), f"{shared_path(spark, 'wanted')}")
    rows = data.drop("n").join(_few(pieces), _KEYS)
    facts = [*_CONTENT, "flags", "method", "crc"]
    part = F.struct("start", "data")
    single = rows.filter("several IS NULL").select(*facts, F.array(part).alias("parts"))
    joined = rows.filter("several").groupBy(*facts).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    schema = "archive string, place long, entry string, sample_id string, kind string, file_size long, compress_size long, duplicate boolean, content binary"
    return single.unionByName(joined).mapInArrow(_inflated, schema)


def strict_archives(spark: SparkSession, path: str) -> DataFrame:
    """``read_archives`` of dumps only; a name that comes twice raises when the rows are read."""
    rows = read_archives(spark, path).filter("kind = 'bytes'")
    once = F.when(F.col("duplicate"), F.raise_error(F.concat(F.lit("repeated entry "), "entry"))).otherwise(F.col("entry"))
    return rows.withColumn("entry", once).drop("duplicate")


def select_entries(rows: DataFrame, prefix: str = "", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Entries below a folder with one of the suffixes."""
    low = F.lower("entry")
    wanted = [low.endswith(x) for x in suffixes]
    any_of = wanted[0]
    for w in wanted[1:]:
        any_of = any_of | w
    return rows.filter(F.col("entry").startswith(prefix) & any_of)


def extract(rows: DataFrame, path: str) -> int:
    """Write the entries that a table of extracted ones lacks, and return how many; one that is there with other content raises, and so does an unsafe name."""
    spark = rows.sparkSession
    if bad := rows.filter(~safe_name(F.col("entry"))).select("entry").limit(1).collect():
        raise ValueError(f"{bad[0].entry} leads out of the folder")
    wanted = rows.select("entry", "content", F.sha2("content", 256).alias("sha256"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        have = spark.read.parquet(path).select("entry", F.col("sha256").alias("have"))
        both = wanted.join(have, "entry", "left")
        if both.filter("have <> sha256").limit(1).count():
            raise ValueError(f"{path} holds entries with other content")
        wanted = both.filter("have IS NULL").drop("have")
    n = wanted.count()
    wanted.write.mode("append").parquet(path)
    return n


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that, each followed by a signature, are one archive. The last signature is its comment."""
    row = lambda raw: pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["line"])
    offset, directory, held = 0, [], None
    for batch in batches:
        for entry, content in zip(batch.column("entry").to_pylist(), batch.column("content").to_pylist(), strict=True):
            name, content = entry.encode(), content or b""
            pack = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = pack.compress(content) + pack.flush()
            facts = struct.pack("<HHHHIII", 0x800, 8, 0, 33, zlib.crc32(content), len(packed), len(content))
            if held is None:
                yield row(b"")
            else:
                yield row(held)
            held = struct.pack("<H", 20) + facts + struct.pack("<HH", len(name), 0) + name + packed
            wide = struct.pack("<HHQ", 1, 8, offset) if offset >= 0xFFFFFFFF else b""
            directory.append(CENTRAL + struct.pack("<HH", 45, 45 if wide else 20) + facts + struct.pack("<HHHHHII", len(name), len(wide), 0, 0, 0, 0, min(offset, 0xFFFFFFFF)) + name + wide)
            offset += len(LOCAL) + len(held)
    if held is None:
        return
    listed = b"".join(directory)
    n, tail = len(directory), b""
    if n >= 0xFFFF or offset >= 0xFFFFFFFF:
        tail = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(listed), offset) + LOCATOR + struct.pack("<IQI", 0, offset + len(listed), 1)
    yield row(held + listed + tail + END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(len(listed), 0xFFFFFFFF), min(offset, 0xFFFFFFFF), len(LOCAL)))


def write_archives(rows: DataFrame, path: str) -> None:
    """Rows (entry, content) as ZIP archives, one for each partition that has any; an existing path raises.

    Spark's text writer puts a separator after each line, here the signature of local headers.
    """
    lines = rows.select("entry", F.col("content").cast("binary").alias("content")).mapInArrow(_zipped, "line binary")
    lines.select(F.col("line").cast("string").alias("value")).write.mode("errorifexists").option("lineSep", LOCAL.decode()).text(path)
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.globStatus(hadoop.Path(f"{path}/part-*.txt")):
        if not status.getLen():
            files.delete(status.getPath(), False)
            continue
        files.rename(status.getPath(), hadoop.Path(status.getPath().toString().removesuffix(".txt") + ".zip"))
