"""Near vectors against brute force over extreme magnitudes, mixed lengths and several tiles."""

from fractions import Fraction

import numpy as np

from bytemill.llm import embeddings


def brute(rows, threshold=Fraction(98, 100)):
    """Links by exact arithmetic: 98 % squared against the squared cosine."""
    valid = {}
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            valid[i] = (label, [Fraction(x) for x in v])
    links = {i: set() for i, _, _ in rows}
    for i, (a, x) in valid.items():
        for j, (b, y) in valid.items():
            if i < j and a == b and len(x) == len(y):
                dot = sum(p * q for p, q in zip(x, y, strict=True))
                if dot > 0 and dot * dot >= threshold**2 * sum(p * p for p in x) * sum(q * q for q in y):
                    links[i].add(j)
                    links[j].add(i)
    out = {}
    for i in sorted(links):
        seen, front = {i}, [i]
        while front:
            front = [n for m in front for n in links[m] if n not in seen and not seen.add(n)]
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def corpus(n=240, seed=3):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(n // 4):
        base = rng.normal(size=int(rng.choice([1, 2, 8, 12])))
        label = int(rng.integers(0, 3))
        for scale in (1.0, 1e-200, 1e200, 3.0):
            v = base * scale * (1 + rng.normal(size=len(base)) * rng.choice([0, 0.02, 0.2]))
            rows.append((i, [float(x) for x in v], label))
            i += 1
    tiny = [(i, [1e-200] * 8, 1), (i + 1, [1e-200] * 8, 1), (i + 2, [1.0] * 8, 1), (i + 3, [1e200] * 8, 1), (i + 4, [5e-324, 0.0], 1), (i + 5, [1.0, 0.0], 1)]
    odd = [(i + 6, None, 1), (i + 7, [], 1), (i + 8, [0.0, 0.0], 1), (i + 9, [float("inf"), 1.0], 1), (i + 10, [None, 1.0], 1), (i + 11, [1.0, 2.0], None)]
    return rows + tiny + odd


def test_against_exact_arithmetic(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    want = brute(rows)
    for tile in (1024, 7):
        monkeypatch.setattr(embeddings, "TILE", tile)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(docs).collect()}
        assert got == want
