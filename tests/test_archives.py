"""Archives of every layout against Python's own reader, in parts of a few kilobytes."""

import io
import os
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from bytemill.sources import archives


class Unseekable(io.RawIOBase):
    """A stream that can't be rewound: lengths follow the entries."""

    def __init__(self, at):
        self.out = open(at, "wb")

    def writable(self):
        return True

    def write(self, b):
        return self.out.write(b)

    def close(self):
        self.out.close()
        super().close()


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def inner(n):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(n):
            z.writestr(f"in/{i}.bytes", f"inner {i} " * 40)
    return out.getvalue()


def plain(folder):
    """What Python's reader finds: name -> content, by archive."""
    found = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".zip"):
            with zipfile.ZipFile(folder / name) as z:
                found += [(name, i, x.filename, z.read(x)) for i, x in enumerate(z.infolist()) if x.filename.lower().endswith(archives.SUFFIXES) and not x.is_dir()]
    return found


def test_layouts(spark, small_parts, tmp_path):
    draw = random.Random(2)
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(1000):
            z.writestr(f"a/{i}.{draw.choice(['bytes', 'ASM', 'txt'])}", draw.randbytes(draw.randint(0, 300)))
        z.comment = b"a comment with PK\x03\x04 in it"
    with zipfile.ZipFile(tmp_path / "nested.zip", "w") as z:
        z.writestr("first.bytes", b"PK\x03\x04" * 5000)
        z.writestr("archive.bytes", inner(60))
        z.writestr("skipped.zip", inner(60))
        z.writestr("ünï/last.asm", inner(3) + b"PK\x03\x04")
    with zipfile.ZipFile(Unseekable(tmp_path / "stream.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(30):
            z.writestr(f"s/{i}.bytes", draw.randbytes(2000) + b"PK\x03\x04")
    (tmp_path / "prefixed.zip").write_bytes(b"#!/bin/sh PK\x03\x04 PK\n" * 900 + (tmp_path / "nested.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    rows = archives.read_archives(spark, str(tmp_path))
    got = sorted((r.archive.rsplit("/", 1)[1], r.place, r.entry, bytes(r.content)) for r in rows.collect())
    assert got == sorted(plain(tmp_path)) and len(got) > 600
    assert archives.list_archives(spark, str(tmp_path)).count() == 1000 + 30 + 4 + 4
    read = archives._pieces(spark, str(tmp_path / "many.zip"), archives.shared_path(spark, "test"))[0]
    assert read.select("block").distinct().count() > 10, "one archive goes to many tasks"


def test_names_and_repeats(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("x/one.bytes", "y/one.bytes", "y/one.asm", "../two.bytes", "..\\three.bytes", "/four.bytes", "c:\\five.bytes", "x/..\\six.bytes", "a..b/seven.bytes", "w\\eight.bytes", "dir.bytes/"):
            z.writestr(name, "content")
    rows = archives.read_archives(spark, str(tmp_path))
    assert sorted((r.entry, r.sample_id, r.kind, r.duplicate) for r in rows.collect()) == [
        ("a..b/seven.bytes", "seven", "bytes", False), ("w\\eight.bytes", "eight", "bytes", False), ("x/one.bytes", "one", "bytes", False), ("y/one.asm", "one", "asm", False), ("y/one.bytes", "one", "bytes", True),
    ]
    with pytest.raises(ValueError, match="leads out"):
        archives.extract(rows.withColumn("entry", F.lit("a\\..\\..\\b.bytes")), str(tmp_path / "out"))


@pytest.mark.parametrize("damage", ["content", "encrypted", "method", "cut"])
def test_damaged_archives_raise(spark, tmp_path, damage):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.bytes", "some content that will be changed")
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    central = raw.index(b"PK\x01\x02")
    if damage == "content":
        raw[raw.index(b"some")] ^= 1
    elif damage == "encrypted":
        raw[central + 8] |= 1
    elif damage == "method":
        raw[central + 10] = 12
    else:
        raw = raw[: raw.rindex(b"PK\x05\x06")]
    (tmp_path / "a.zip").write_bytes(raw)
    with pytest.raises(Exception, match="damaged|encrypted|no end record"):
        archives.read_archives(spark, str(tmp_path)).collect()


def test_more_than_two_gigabytes(spark, tmp_path):
    """A sparse archive of 2.2 GB: blocks are read by many tasks, and an entry behind them by its offset."""
    size, n = 8 << 20, 280
    crc = zlib.crc32(bytes(size))
    with open(tmp_path / "large.zip", "wb") as out:
        listed = b""
        for i in range(n):
            name, facts = f"{i}.bin".encode(), struct.pack("<HHHHIII", 0, 0, 0, 33, crc, size, size)
            listed += archives.CENTRAL + struct.pack("<HH", 20, 20) + facts + struct.pack("<HHHHHII", len(name), 0, 0, 0, 0, 0, out.tell()) + name
            out.write(archives.LOCAL + struct.pack("<H", 20) + facts + struct.pack("<HH", len(name), 0) + name)
            out.seek(size, 1)
        text = b"found it"
        facts, at = struct.pack("<HHHHIII", 0, 0, 0, 33, zlib.crc32(text), len(text), len(text)), out.tell()
        listed += archives.CENTRAL + struct.pack("<HH", 20, 20) + facts + struct.pack("<HHHHHII", 7, 0, 0, 0, 0, 0, at) + b"z.bytes"
        out.write(archives.LOCAL + struct.pack("<H", 20) + facts + struct.pack("<HH", 7, 0) + b"z.bytes" + text)
        out.write(listed + archives.END + struct.pack("<HHHHIIH", 0, 0, n + 1, n + 1, len(listed), at + 30 + 7 + len(text), 0))
    assert os.path.getsize(tmp_path / "large.zip") > 2 << 30
    row = archives.read_archives(spark, str(tmp_path)).collect()
    assert [(r.entry, r.place, bytes(r.content)) for r in row] == [("z.bytes", n, text)]


def test_written_archives(spark, tmp_path):
    """What is written is a ZIP archive to Python's reader, and comes back whole; empty partitions give no archive."""
    rows = spark.range(300).select(F.concat(F.lit("d/"), "id", F.lit(".bytes")).alias("entry"), F.repeat(F.concat(F.lit("é PK\x03\x04 "), "id"), (F.col("id") % 50).cast("int")).alias("content"))
    archives.write_archives(rows.repartition(3, "entry"), str(tmp_path / "out"))
    want = {r.entry: r.content.encode() for r in rows.collect()}
    assert {e: c for _, _, e, c in plain(tmp_path / "out")} == want
    assert {r.entry: bytes(r.content) for r in archives.read_archives(spark, str(tmp_path / "out")).collect()} == want
    archives.write_archives(rows.limit(0), str(tmp_path / "none"))
    assert plain(tmp_path / "none") == []
