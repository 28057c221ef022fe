"""Token ids packed into fixed rows by best-fit decreasing.

Texts become byte-level BPE ids with an end mark. A document longer than a row is cut into whole rows and a rest, each
with its place in the document, so nothing is lost. Within a window of a partition (WINDOW ids) the pieces are placed
longest first, each into the row whose free space fits best; a segment tree over free spaces finds it. A row holds the
ids and the position of each id in its piece (both packed little-endian, 2 bytes where the vocabulary allows, else 4),
the cumulative lengths of its pieces, and the pieces' documents and places. No shuffle: any partitioning packs all ids,
but which pieces share a row, and how many rows there are, depends on it: small partitions fill their last rows less.
A very long text is held by one task with its ids.

Null and empty texts are one end mark. Rows that repeat a document are packed again. Special tokens' strings are plain
text. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Ids of a row; ids that are packed together; remembered text chunks; rows of an Arrow batch.
ROW, WINDOW, REMEMBERED, BATCH = 2048, 4 << 20, 400_000, 256
# Fixed value: the vocabulary's pre-tokenising pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# No token runs from other characters into white space, so texts may be cut before single spaces and newlines.
_CHUNKS = re.compile(r"[ \n]?[^ \n]+")
_UNSAFE = re.compile(r"\s[ \n]|[ \n]\Z")


class _Memory(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[chunk] = self.encode(chunk)
        return ids


class Tokenizer:
    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._memory = _Memory(self._encode)

    def _encode(self, text: str) -> bytes:
        return array(self._code, self.encoding.encode_ordinary(text)).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, without the end mark; the same as the tokenizer's own, chunk by chunk."""
        raw = self._encode(text) if _UNSAFE.search(text) else b"".join(map(self._memory.__getitem__, _CHUNKS.findall(text)))
        return np.frombuffer(raw, self.dtype)

    def text(self, ids: np.ndarray) -> str:
        return self.encoding.decode([int(i) for i in ids if i != self.end])


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class FreeSpace:
    """Rows by free space: a segment tree of counts over 0 .. most, to find the least space of at least so much."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most.bit_length())
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        at = space + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(space, row) of the tightest row, which leaves the tree."""
        at = least + self.size
        count = self.count
        if not count[at]:
            # Up until a right neighbour holds a row, then down to its left end.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        space = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return space, self.rows[space].pop()


def best_fit_decreasing(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Rows of piece numbers; no piece is longer than ``most``."""
    free, rows = FreeSpace(most), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = free.take(n)
        if found is None:
            rows.append([i])
            left = most - n
        else:
            space, row = found
            rows[row].append(i)
            left = space - n
        if left:
            free.put(left, len(rows) - 1 if found is None else row)
    return rows


def _pack(pieces: list[tuple[int, int, np.ndarray]], most: int, end: int, dtype: np.dtype) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(p[2]) for p in pieces], np.int64)
    rows = best_fit_decreasing(lengths, most)
    for at in range(0, len(rows), BATCH):
        part = rows[at : at + BATCH]
        ids = np.full((len(part), most), end, dtype)
        positions = np.zeros((len(part), most), dtype)
        ends = []
        for r, row in enumerate(part):
            place = 0
            ends.append([0])
            for i in row:
                n = int(lengths[i])
                ids[r, place : place + n] = pieces[i][2]
                positions[r, place : place + n] = np.arange(n)
                place += n
                ends[-1].append(place)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([[pieces[i][0] for i in row] for row in part], pa.list_(pa.int64())),
                pa.array([[pieces[i][1] for i in row] for row in part], pa.list_(pa.int64())),
                pa.array(ends, pa.list_(pa.int32())),
                pa.array([x.tobytes() for x in ids], pa.binary()),
                pa.array([x.tobytes() for x in positions], pa.binary()),
            ],
            ["doc_ids", "places", "cu_seqlens", "ids", "positions"],
        )


def _packing(path: str, most: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(path)
        pieces, total = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(tokens.ids(text.as_py() or ""), tokens.dtype.type(tokens.end))
                for at in range(0, len(ids), most):
                    pieces.append((doc, at, ids[at : at + most]))
                total += len(ids)
                if total >= window:
                    yield from _pack(pieces, most, tokens.end, tokens.dtype)
                    pieces, total = [], 0
        if pieces:
            yield from _pack(pieces, most, tokens.end, tokens.dtype)

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = ROW, window: int = WINDOW) -> DataFrame:
    """Packed rows: doc_ids and places (of each piece: its document, and where in the document's ids it begins),
    cu_seqlens (0 and each piece's end), ids and positions (binary, ``most`` entries each; past the last piece the end
    mark and 0)."""
    schema = "doc_ids array<long>, places array<long>, cu_seqlens array<int>, ids binary, positions binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_packing(vocabulary, most, window), schema)


def write_rows(packed: DataFrame, path: str) -> None:
    """The id matrix and its companions as Parquet, one row for each packed row."""
    packed.write.parquet(path)
