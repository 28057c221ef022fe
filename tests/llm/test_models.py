"""Packing against plain best fit, and sampled paths against the exact probabilities of a lattice."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from bytemill.llm import packing, sampling


def naive_best_fit(lengths, most):
    """Free space and pieces of each row; every row is looked at for every piece."""
    rows = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fitting = [r for r in rows if r[0] >= lengths[i]]
        if fitting:
            best = min(fitting, key=lambda r: r[0])
            best[0] -= lengths[i]
            best[1].append(i)
        else:
            rows.append([most - lengths[i], [i]])
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    most = int(rng.choice([1, 7, 64, 100]))
    lengths = rng.integers(1, most + 1, 400)
    got = packing.best_fit_decreasing(lengths, most)
    want = naive_best_fit(lengths.tolist(), most)
    free = lambda rows: sorted(most - sum(lengths[i] for i in r) for r in rows)
    assert sorted(i for r in got for i in r) == list(range(400)) and free(got) == sorted(r[0] for r in want)


def test_packed_rows_of_documents(spark):
    """Ids, ends and positions of every row against the tokenizer's own ids, and as many rows as plain best fit opens."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").coalesce(1)
    tokens = packing.tokenizer(packing.VOCABULARY)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack(docs, most=512).collect()
    ids = {i: [*tokens.encoding.encode_ordinary(t), tokens.end] for i, t in texts.items()}
    lengths = [len(x[a : a + 512]) for x in ids.values() for a in range(0, len(x), 512)]
    assert len(rows) == len(naive_best_fit(lengths, 512))
    seen = Counter()
    for r in rows:
        got = np.frombuffer(r.ids, tokens.dtype)
        for doc, at, a, b in zip(r.doc_ids, r.places, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert got[a:b].tolist() == ids[doc][at : at + b - a]
            seen[doc] += b - a
        assert (got[r.cu_seqlens[-1] :] == tokens.end).all()
    assert seen == {i: len(x) for i, x in ids.items()}


@pytest.mark.parametrize("word", ["there", " des", "né"])
def test_paths_come_in_proportion_to_their_weights(word):
    table = sampling.piece_table(sampling.MODEL, sampling.ALPHA)
    raw = word.encode()
    weights = {table.raw[i]: w for i, w in zip(table.ids, table.weights, strict=True)}
    # All ways to cut the word, characters without a piece spelt in bytes.
    marks = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80]
    exact = {}
    for k in range(len(marks) + 1):
        for cut in itertools.combinations(marks, k):
            parts = [raw[a:b] for a, b in zip((0, *cut), (*cut, len(raw)), strict=True)]
            if all(p in weights for p in parts):
                exact[tuple(parts)] = math.exp(sum(weights[p] for p in parts))
    total = sum(exact.values())
    n = 4000
    data, offs = np.frombuffer(raw * n, np.uint8), np.arange(n + 1) * len(raw)
    ids, bounds = sampling.encode(table, data, offs, np.random.default_rng(1).integers(-(2**63), 2**63 - 1, n), 5)
    drawn = Counter(tuple(table.raw[i] for i in ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    assert set(drawn) <= set(exact)
    for path, w in exact.items():
        p = w / total
        assert abs(drawn[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
