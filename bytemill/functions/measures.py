"""Measures over all samples that callers plug in: any number of them, in one pass over the bytes.

A measure makes a small state of each slice of samples and says how two states merge and what comes out at the end.
Each task merges its slices, tasks' states merge in two levels, and the last state comes to the driver: a row of a few
numbers for each measure, whatever the input. States hold whole numbers of any size, so that sums are exact.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .bytestats import Samples, slices

State = list[int]


@dataclass(frozen=True)
class Measure:
    """``update(data, known, offs)``: the state of some samples, one at least; ``merge``: of both; ``finish``: names and values, of None where there were no samples."""

    update: Callable[[np.ndarray, np.ndarray, np.ndarray], State]
    merge: Callable[[State, State], State]
    finish: Callable[[State | None], dict[str, float | int | None]]


def added(a: State, b: State) -> State:
    return [x + y for x, y in zip(a, b, strict=True)]


def _moments(s: State | None) -> dict[str, float | int | None]:
    n, total, squares, zeros = s or (0, 0, 0, 0)
    if not n:
        return {"pixel_mean": None, "pixel_std": None, "zero_pixel_ratio": None}
    return {"pixel_mean": total / n, "pixel_std": max(0, n * squares - total * total) ** 0.5 / n, "zero_pixel_ratio": zeros / n}


def _range_state(data: np.ndarray, known: np.ndarray, offs: np.ndarray) -> State:
    return [int(data.min(initial=255)), int(data.max(initial=0))]


def _image_state(data: np.ndarray, known: np.ndarray, offs: np.ndarray) -> State:
    full = offs[:-1] < offs[1:]
    low, high = (f.reduceat(data, offs[:-1][full]) if full.any() else np.zeros(0, np.uint8) for f in (np.minimum, np.maximum))
    return [len(offs) - 1, int((low == high).sum()), int((high == 0).sum())]


#: Mean, population deviation and share of zeros of all bytes.
MOMENTS = Measure(lambda d, _, o: [len(d), int(d.sum(dtype=np.int64)), int(np.square(d, dtype=np.int64).sum()), int((d == 0).sum())], added, _moments)
#: The least and the largest byte.
RANGE = Measure(_range_state, lambda a, b: [min(a[0], b[0]), max(a[1], b[1])], lambda s: {"pixel_min": s[0] if s and s[0] <= s[1] else None, "pixel_max": s[1] if s and s[0] <= s[1] else None})
#: How many samples there are, how many have one value only, and how many only zeros; empty ones are neither.
IMAGES = Measure(_image_state, added, lambda s: dict(zip(("images", "constant_images", "all_black_images"), s or (0, 0, 0), strict=True)))


def _partial(read, column: str, measures: Mapping[str, Measure]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, State] = {}
        for _, *arrays in slices(batches, read, column):
            for name, m in measures.items():
                new = m.update(*arrays)
                states[name] = m.merge(states[name], new) if name in states else new
        if states:
            yield pa.RecordBatch.from_pydict({"states": [json.dumps(states)]})

    return run


def _merged(measures: Mapping[str, Measure]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, State] | None = None
        for batch in batches:
            for text in batch.column("states").to_pylist():
                new = json.loads(text)
                states = new if states is None else {name: m.merge(states[name], new[name]) for name, m in measures.items()}
        if states is not None:
            yield pa.RecordBatch.from_pydict({"states": [json.dumps(states)]})

    return run


def measure(samples: Samples, measures: Mapping[str, Measure], parts: int = 16) -> dict[str, float | int | None]:
    """All values of all measures."""
    rows = samples.rows.select(samples.column, *(k for k in samples.keys if k != samples.column))
    tasks = rows.mapInArrow(_partial(samples.read, samples.column, measures), "states string")
    row = tasks.repartition(parts).mapInArrow(_merged(measures), "states string").repartition(1).mapInArrow(_merged(measures), "states string").first()
    states = json.loads(row.states) if row else {}
    return {k: v for name, m in measures.items() for k, v in m.finish(states.get(name)).items()}
