"""The five dialects of hexadecimal dump text, as column expressions.

A line may begin with an 8-digit address; ``??`` is an unknown byte. They differ in what an invalid token does:

======== ============================================================== =======================
dialect  invalid tokens                                                 rejected
======== ============================================================== =======================
profile  dropped and counted; ``4D5A`` is two bytes if all text is hex  never
extract  stay in place as unknown and counted                           never
train    reject                                                         also without known byte
serve    reject                                                         also without any token
image    reject (white space is dropped first, pairs must be even)      also without any token
======== ============================================================== =======================

Tokens are two characters of 0-9, A-F, a-f; looser spellings that a general integer parser takes are invalid here.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let
from .bytestats import binary_column, slices

DIALECTS = ("profile", "extract", "train", "serve", "image")
_BY_LINE = ("extract", "train", "serve")
_COUNTS = ("n_total", "n_known", "n_unknown", "n_invalid")
COUNTED = f"struct<{','.join(f'{c}:int' for c in _COUNTS)},rejected:boolean>"
PARSED = COUNTED.replace("<", "<values:array<int>,", 1)
# White space between tokens; hexadecimal digits; what stands for an unknown byte.
_IS_WHITE, _IS_HEX = np.zeros(256, bool), np.zeros(256, bool)
_IS_WHITE[list(b" \t\n\r\x0b\x0c")] = True
_IS_HEX[list(b"0123456789abcdefABCDEF")] = True
_UNKNOWN_PAIR, _ADDRESS = b"??", 8
UNKNOWN, INVALID = -1, -2
_PAIRS = np.full(1 << 16, INVALID, np.int16)
for _a in b"0123456789abcdefABCDEF":
    for _b in b"0123456789abcdefABCDEF":
        _PAIRS[_a << 8 | _b] = int(bytes((_a, _b)), 16)
_PAIRS[_UNKNOWN_PAIR[0] << 8 | _UNKNOWN_PAIR[1]] = UNKNOWN


def _line_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the lines of all texts begin, in order; the place behind the last text may be one of them."""
    return np.unique(np.concatenate([offs[:-1], np.flatnonzero(data == 10) + 1]))


def _all_hex(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the 8 characters from each place on are hexadecimal digits."""
    return _IS_HEX[data[at[:, None] + np.arange(_ADDRESS)]].all(axis=1)


def _words(data: np.ndarray, offs: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts begin and end."""
    inside = ~white
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= white[:-1]
    closes[:-1] &= white[1:]
    # A text's edges are edges of words.
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    opens[first], closes[last] = inside[first], inside[last]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _codes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return _PAIRS[high.astype(np.uint16) << 8 | low]


def _word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    codes = _codes(data[starts], data[np.minimum(starts + 1, len(data) - 1)])
    codes[ends - starts != 2] = INVALID
    return codes


class _Tokens:
    """The tokens of a slice of dumps ``data[offs[i]:offs[i + 1]]``, as codes and the bounds of each dump's codes. Dialects
    that find the same tokens share them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs

    @cached_property
    def _white(self) -> np.ndarray:
        return _IS_WHITE[self.data]

    @cached_property
    def _lines(self) -> np.ndarray:
        return _line_starts(self.data, self.offs)

    @cached_property
    def by_line(self) -> tuple[np.ndarray, np.ndarray]:
        """Words without the addresses that begin lines."""
        starts, ends = _words(self.data, self.offs, self._white)
        long = np.flatnonzero(ends - starts == _ADDRESS)
        line = self._lines[np.searchsorted(self._lines, starts[long], side="right") - 1]
        first = (long == 0) | (starts[long - 1] < line)
        address = long[first]
        kept = np.ones(len(starts), bool)
        kept[address[_all_hex(self.data, starts[address])]] = False
        starts, ends = starts[kept], ends[kept]
        return _word_codes(self.data, starts, ends), np.searchsorted(starts, self.offs)

    @cached_property
    def _unaddressed(self) -> np.ndarray:
        """White space, and addresses at a line's beginning with a blank behind them."""
        at = self._lines[self._lines < len(self.data)]
        stop = self.offs[np.searchsorted(self.offs, at, side="right")]
        at = at[at + _ADDRESS < stop]
        at = at[np.isin(self.data[at + _ADDRESS], (32, 9))]
        at = at[_all_hex(self.data, at)]
        white = self._white.copy()
        white[(at[:, None] + np.arange(_ADDRESS)).ravel()] = True
        return white

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All characters but white space, two by two; a last one without another is no token."""
        solid = np.flatnonzero(~self._unaddressed)
        begin = np.searchsorted(solid, self.offs)
        odd = np.diff(begin) % 2
        filled = np.insert(self.data[solid], begin[1:][odd == 1], 0)
        return _codes(filled[::2], filled[1::2]), (begin + np.append(0, np.cumsum(odd))) // 2

    @cached_property
    def by_pair_or_word(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of dumps whose pairs are all tokens, the words of the others."""
        pairs, bounds = self.pairs
        spoilt = _count(pairs == INVALID, bounds) > 0
        if not spoilt.any():
            return pairs, bounds
        starts, ends = _words(self.data, self.offs, self._unaddressed)
        words, at = _word_codes(self.data, starts, ends), np.searchsorted(starts, self.offs)
        if spoilt.all():
            return words, at
        sizes = np.where(spoilt, np.diff(at), np.diff(bounds))
        parts = [words[at[i] : at[i + 1]] if bad else pairs[bounds[i] : bounds[i + 1]] for i, bad in enumerate(spoilt)]
        return np.concatenate(parts), np.append(0, np.cumsum(sizes))

    def of(self, dialect: str) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.data):
            return np.zeros(0, np.int16), np.zeros(len(self.offs), np.int64)
        return self.by_line if dialect in _BY_LINE else self.pairs if dialect == "image" else self.by_pair_or_word


def _count(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many marks stand between each two bounds."""
    return np.diff(np.searchsorted(np.flatnonzero(marks), bounds))


def token_codes(data: np.ndarray, offs: np.ndarray, dialect: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the dumps ``data[offs[i]:offs[i + 1]]`` as byte values, UNKNOWN or INVALID, and whose they are, in order."""
    codes, bounds = _Tokens(data, offs).of(dialect)
    return codes, np.repeat(np.arange(len(offs) - 1), np.diff(bounds))


def _parsed(tokens: _Tokens, dialect: str, values: bool) -> pa.StructArray:
    codes, bounds = tokens.of(dialect)
    unknown, invalid = (_count(codes == x, bounds) for x in (UNKNOWN, INVALID))
    total = np.diff(bounds)
    known = total - unknown - invalid
    rejected = {"train": (invalid > 0) | (known == 0), "serve": (invalid > 0) | (total == 0), "image": (invalid > 0) | (total == 0)}.get(dialect, np.zeros(len(total), bool))
    if dialect == "profile":
        total = total - invalid
    fields = {name: pa.array(x.astype(np.int32)) for name, x in zip(_COUNTS, (total, known, unknown, invalid), strict=True)} | {"rejected": pa.array(rejected)}
    if values:
        kept = codes[codes != INVALID] if dialect == "profile" else codes
        fields = {"values": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(total)), pa.int32()), pa.array(kept.astype(np.int32), mask=kept < 0))} | fields
    return pa.StructArray.from_arrays([*fields.values()], [*fields])


def with_parsed(rows: DataFrame, text: str, dialects: Mapping[str, str], values: bool = True, keep: bool = True) -> DataFrame:
    """``rows`` with a struct for each of ``dialects`` (name of the column: dialect), from a text or binary column.

    A struct holds ``values`` (array of int, null where unknown), n_total (its length; dropped tokens are not in it),
    n_known, n_unknown, n_invalid and rejected. A null text is an empty one. Without ``values`` the structs have no array,
    and without ``keep`` the text is dropped, so neither leaves the Python worker.
    """
    for d in dialects.values():
        if d not in DIALECTS:
            raise ValueError(f"unknown dialect {d!r}: choose from {DIALECTS}")
    kept = [f for f in rows.schema if keep or f.name != text]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, lambda part: binary_column(part.column(text)), text):
            tokens = _Tokens(data, offs)
            new = {name: _parsed(tokens, d, values) for name, d in dialects.items()}
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], [*names, *new])

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return rows.mapInArrow(run, ", ".join([*own, *(f"`{name}` {PARSED if values else COUNTED}" for name in dialects)]))


def fixed_length(values: Column, length: int, pad: int = 0, keep: str = "head") -> Column:
    """Truncate or pad to ``length``: a struct of values, mask (known or padded: 1 or 0), n_truncated, n_padded.

    ``keep="head"`` keeps the first values and pads on the right, ``"tail"`` keeps the last and pads on the left.
    """
    if length < 1:
        raise ValueError("length must be positive")
    if keep not in ("head", "tail"):
        raise ValueError("keep must be 'head' or 'tail'")

    def cut(v: Column) -> Column:
        n = F.size(v)
        missing = F.greatest(F.lit(0), F.lit(length) - n)
        own = F.slice(v, F.lit(1), F.lit(length)) if keep == "head" else F.slice(v, F.greatest(F.lit(1), n - length + 1), F.lit(length))
        fill, zeros = F.array_repeat(F.lit(pad), missing), F.array_repeat(F.lit(0), missing)
        bits = F.transform(own, lambda x: F.when(x.isNotNull(), 1).otherwise(0))
        filled = F.transform(own, lambda x: F.coalesce(x, F.lit(pad)))
        both = ((filled, fill), (bits, zeros)) if keep == "head" else ((fill, filled), (zeros, bits))
        return F.struct(F.concat(*both[0]).alias("values"), F.concat(*both[1]).alias("mask"), F.greatest(F.lit(0), n - length).alias("n_truncated"), missing.alias("n_padded"))

    return let(values, cut)
