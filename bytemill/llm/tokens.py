"""Token counts by a two-tier lookup on the map side.

A text's token count is the sum of the counts of its pre-tokens, so a pre-token has to be encoded once only. A first
pass over all documents keeps, in each task, a mergeable summary of the pre-tokens seen most often (every one with more
than 1 / KEPT of a task's pre-tokens is in it); the summaries, of fixed size, merge in two levels, and the FREQUENT
heaviest entries become a hash table of (hash, token count) that is broadcast. The second pass cuts the texts into
pre-tokens again, looks all of a slice up in this table at once, then in the worker's own table, and has the library
encode the distinct rest, which the worker's table then holds. No pre-token is ever shuffled; the tables only save time,
so no count depends on them.

Pre-tokens are cut in numpy for byte-level vocabularies; which characters are letters, digits or white space is asked
of the library itself, once for each character that occurs. They are told apart by 64-bit hashes. Special strings inside
texts are single tokens, as is the library's default. Other .json vocabularies and .model files have no such cut: their
texts are encoded whole.

Null texts count as empty: no bytes, no tokens. Rows that repeat a doc_id, or have none, are counted row by row. An
empty table gives an empty result. Bytes that aren't UTF-8 are read as replacement characters.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import block_hashes, folded, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LIMIT = 512
#: Entries of a task's summary and of the broadcast table (16 bytes each); slots of a worker's own table (emptied when half full).
KEPT, FREQUENT, WORKER_SLOTS = 8192, 1 << 16, 1 << 21
LETTER, DIGIT, OTHER, WHITE, SPACE, SPECIAL = range(1, 7)
# The endings that an apostrophe at the beginning of a pre-token takes with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class LengthTable:
    """64-bit hashes and small numbers in open slots; whole arrays are put and found at once."""

    def __init__(self, slots: int):
        self.keys, self.values, self.used = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), 0

    @classmethod
    def of(cls, hashes: np.ndarray, lengths: np.ndarray) -> LengthTable:
        table = cls(1 << max(4, (4 * len(hashes)).bit_length()))
        table.put(hashes, lengths)
        return table

    def put(self, hashes: np.ndarray, lengths: np.ndarray) -> None:
        """Distinct hashes that the table lacks; a table that would be more than half full is emptied first."""
        if 2 * (self.used + len(hashes)) > len(self.keys):
            self.keys[:], self.used = 0, 0
            hashes, lengths = hashes[: len(self.keys) // 2], lengths[: len(self.keys) // 2]
        self.used += len(hashes)
        mask = np.uint64(len(self.keys) - 1)
        slots = hashes & mask
        while len(hashes):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = hashes[free]
            placed = self.keys[slots] == hashes
            self.values[slots[placed]] = lengths[placed]
            hashes, lengths, slots = hashes[~placed], lengths[~placed], (slots[~placed] + np.uint64(1)) & mask

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers, -1 where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        slots = hashes & mask
        keys = self.keys[slots]
        out = np.where(keys == hashes, self.values[slots].astype(np.int64), -1)
        left = np.flatnonzero((keys != hashes) & (keys != 0))
        slots = slots[left]
        while len(left):
            slots = (slots + np.uint64(1)) & mask
            keys = self.keys[slots]
            hit = keys == hashes[left]
            out[left[hit]] = self.values[slots[hit]]
            on = ~hit & (keys != 0)
            left, slots = left[on], slots[on]
        return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes begins, and its code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.full(3, 0x80, np.uint8)]).astype(np.int32) & 0x3F
        p, first = at[wide], lead[wide]
        two, three = ((first & 0x1F) << 6) | padded[p + 1], ((first & 0x0F) << 12) | (padded[p + 1] << 6) | padded[p + 2]
        four = ((first & 0x07) << 18) | (padded[p + 1] << 12) | (padded[p + 2] << 6) | padded[p + 3]
        lead[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, np.minimum(four, 0x10FFFF)))
    return at, lead


class ByteLevel:
    """Pre-tokens of a byte-level vocabulary, and how many tokens each has."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.kinds = np.zeros(0x110000, np.uint8)
        self.kinds[0x20] = SPACE
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        self.seen = LengthTable(WORKER_SLOTS)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if not kinds.all():
            together = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text)) == 1
            for p in np.unique(points[kinds == 0]).tolist():
                c = chr(p) if not 0xD800 <= p < 0xE000 else "�"
                self.kinds[p] = next((k for k, x in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")) if together(x + c)), WHITE)
            kinds = self.kinds[points]
        return kinds

    def starts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokens of the texts begin, in order, and which of them are special strings. They leave no byte out."""
        at, points = code_points(data)
        n = len(at)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        kinds = self._kinds(points)
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(at, offs)] = True
        inside = np.zeros(n, bool)
        if self.special is not None and self.special.search(raw := data.tobytes()):
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                for m in self.special.finditer(raw, a, b):
                    x, y = np.searchsorted(at, m.span())
                    kinds[x:y], edge[x], edge[y], inside[x + 1 : y] = SPECIAL, True, True, True
        edge[0] = True
        first, last = edge[:-1], edge[1:]
        before = np.concatenate([[0], kinds[:-1]])
        white = (kinds == WHITE) | (kinds == SPACE)
        white_before = (before == WHITE) | (before == SPACE)
        # Words begin where the kind changes, unless a space before them is theirs; of white space before a word, the last character stands apart.
        ends_run = white & ~last & ~np.concatenate([white[1:], [True]])
        opens = first | np.where(white, ~white_before | ends_run, (kinds != before) & (before != SPACE))
        apostrophe = np.flatnonzero(opens & (points == 39) & ~last)
        for ending in ENDINGS:
            there = apostrophe[apostrophe + len(ending) < n]
            for k, c in enumerate(ending, 1):
                there = there[(points[there + k] == ord(c)) & ~edge[there + k]]
            opens[there + 1] = False
            after = there + len(ending) + 1
            opens[after[after < n]] = True
        opens &= ~inside
        found = np.flatnonzero(opens)
        return at[found], kinds[found] == SPECIAL

    def encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The library's token counts of the byte spans."""
        words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return np.array([len(x) for x in self.library.encode_batch(words, add_special_tokens=False)], np.uint32)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, frequent: LengthTable) -> np.ndarray:
        found = frequent.get(hashes)
        for table in (self.seen, None):
            missing = np.flatnonzero(found < 0)
            if not len(missing):
                break
            if table is not None:
                found[missing] = table.get(hashes[missing])
                continue
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            one = missing[first]
            counts = self.encoded(data, starts[one], ends[one])
            found[missing] = counts[back]
            self.seen.put(new, counts)
        return found


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


@lru_cache(4)
def _byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(4)
def _whole(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    library = _library(path)
    return lambda texts: [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]


def has_pre_tokens(path: str) -> bool:
    """Whether the vocabulary is a plain byte-level one, whose pre-tokens can be counted one by one."""
    if not path.endswith(".json"):
        return False
    made = json.loads(Path(path).read_text())
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in made["added_tokens"])
    cut = made["pre_tokenizer"] or {}
    return plain and made["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True)


def _hashed(cutter: ByteLevel, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, special = cutter.starts(data, offs)
    ends = np.append(starts[1:], len(data))
    hashes = block_hashes(data, starts, ends)
    hashes[hashes == 0] = 1
    return starts, ends, hashes, special


def heaviest(hashes: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mergeable summary of so many entries: hashes, lowered counts and the places of their first rows among the given.

    Counts of equal hashes add up; where there are too many, the largest count that finds no place is taken off all, so
    an entry's count is too low by the total over ``most`` at most.
    """
    hashes, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.bincount(back, counts, len(hashes)).astype(np.int64) if len(hashes) else counts
    if len(hashes) > most:
        counts = counts - np.partition(counts, -most - 1)[-most - 1]
        kept = counts > 0
        hashes, counts, first = hashes[kept], counts[kept], first[kept]
    return hashes, counts, first


_SUMMARY = "hashes binary, counts binary, lengths binary"


def _summary(hashes: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    blobs = (hashes.astype("<u8"), counts.astype("<i8"), lengths.astype("<u4"))
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], ["hashes", "counts", "lengths"])


def _summed(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _byte_level(path)
        have, counts, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        for _, data, offs in pieces(batches):
            starts, ends, hashes, special = _hashed(cutter, data, offs)
            starts, ends, hashes = starts[~special], ends[~special], hashes[~special]
            if not len(hashes):
                continue
            new, first, n = np.unique(hashes, return_index=True, return_counts=True)
            old = len(have)
            have, counts, place = heaviest(np.concatenate([have, new]), np.concatenate([counts, n]), most)
            kept = np.empty(len(place), object)
            was = place < old
            kept[was] = words[place[was]]
            at = first[place[~was] - old]
            kept[~was] = [data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            words = kept
        if len(have):
            ends = np.cumsum([len(w) for w in words])
            data = np.frombuffer(b"".join(words), np.uint8)
            yield _summary(have, counts, cutter.encoded(data, np.append(0, ends[:-1]), ends))

    return run


def _merged(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [np.zeros(0, t) for t in ("<u8", "<i8", "<u4")]
        for batch in batches:
            for i in range(batch.num_rows):
                more = [np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in enumerate(("<u8", "<i8", "<u4"))]
                both = [np.concatenate(x) for x in zip(have, more, strict=True)]
                hashes, counts, first = heaviest(both[0], both[1], most)
                have = [hashes, counts, both[2][first]]
        if len(have[0]):
            yield _summary(*have)

    return run


def frequent_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = FREQUENT, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and token counts of pre-tokens that stand often in all texts; 12 bytes each, ``most`` at most."""
    made = docs.select("text").mapInArrow(_summed(vocabulary, kept), _SUMMARY)
    row = folded(made, _merged(most)).first()
    return (np.frombuffer(row.hashes, "<u8"), np.frombuffer(row.lengths, "<u4")) if row else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))


def _counting(path: str, frequent):
    names = ["row", "n_bytes", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = LengthTable.of(*frequent.value) if frequent is not None else None
        for part, data, offs in pieces(batches):
            if table is None:
                n = np.array(_whole(path)([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]), np.int64)
            else:
                cutter = _byte_level(path)
                starts, ends, hashes, special = _hashed(cutter, data, offs)
                each = np.ones(len(starts), np.int64)
                plain = ~special
                each[plain] = cutter.lengths(data, starts[plain], ends[plain], hashes[plain], table)
                upto = np.append(0, np.cumsum(each))[np.searchsorted(starts, offs)]
                n = np.diff(upto)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.diff(offs)), pa.array(n)], names)

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``docs`` without the text, with n_bytes, n_tokens (in place of such columns) and over_limit (more than ``limit``)."""
    spark: SparkSession = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, vocabulary)) if has_pre_tokens(vocabulary) else None
    own = [c for c in docs.columns if c not in ("text", "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own) if own else [F.lit(0).alias("_")]).alias("row"), "text")
    schema = StructType([rows.schema["row"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    out = rows.mapInArrow(_counting(vocabulary, frequent), schema)
    columns: list[Column] = [F.col(f"row.`{c}`").alias(c) for c in own]
    return out.select(*columns, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
