"""Odd inputs: nulls, empty and long texts, repeated rows, empty tables, extra columns; and what must hold for any input."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytemill.llm import embeddings, lines, mixing, neardup, packing, pii, quality, sampling, substrings, toxicity

LONG = "x" * 39 + " " + "y " * 30_000
ODD = [(1, None, "a"), (2, "", None), (3, " \n\t\n", "b"), (4, "é漢字 😀 ñ", "b"), (5, LONG, "a"), (5, LONG, "a"), (None, "no id at all", "c"), (7, "  one", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumn("n_lines", F.lit(9)).withColumn("fail_bits", F.lit(8)).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_pieces_decode_to_the_text(spark, odd, empty):
    key = lambda rows: sorted(((r[0] is None, r[0] or 0, r[1]) for r in rows))
    first = sampling.sample_pieces(odd)
    assert key(sampling.join_pieces(first).collect()) == key([(i, t or "") for i, t, _ in ODD])
    again = sampling.sample_pieces(odd.repartition(1))
    assert key((r[0], tuple(r[1])) for r in first.collect()) == key((r[0], tuple(r[1])) for r in again.collect())
    assert sampling.sample_pieces(empty).count() == 0


def test_packing_loses_nothing(spark, odd, empty):
    rows = packing.pack(odd, most=256).collect()
    tokens = packing.tokenizer(packing.VOCABULARY)
    parts = {}
    for r in rows:
        ids, at = np.frombuffer(r.ids, tokens.dtype), np.frombuffer(r.positions, tokens.dtype)
        assert len(ids) == 256 and r.cu_seqlens[0] == 0
        for doc, place, a, b in zip(r.doc_ids, r.places, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert list(at[a:b]) == list(range(b - a))
            parts.setdefault(doc, []).append((place, ids[a:b]))
    for doc, text in {i: t for i, t, _ in ODD}.items():
        copies = sum(i == doc for i, _, _ in ODD)
        found = sorted(parts[doc], key=lambda x: x[0])[::copies]
        assert tokens.text(np.concatenate([x[1] for x in found])) == (text or "")
    assert packing.pack(empty).count() == 0


def test_best_fit_decreasing_fills_rows():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 500)
    rows = packing.best_fit_decreasing(lengths, 100)
    assert sorted(i for r in rows for i in r) == list(range(500))
    assert all(lengths[r].sum() <= 100 for r in rows) and len(rows) <= 11 / 9 * -(-lengths.sum() // 100) + 1


def test_lines(spark, odd, empty):
    shared = "This line is certainly long enough to be a key. "
    rows = [(i, f"  {shared.upper() if i % 2 else shared}\nown {i}\n{shared}") for i in range(6)] + [(9, None)]
    out = {r.doc_id: r for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].n_dropped for i in range(6)] == [2, 2, 2, 2, 2, 0] and out[0].text == "own 0" and out[9].n_lines == 1
    assert lines.without_lines(odd).count() == len(ODD) and lines.without_lines(odd).columns == odd.columns
    assert lines.without_lines(empty).count() == 0


def test_line_runs_grow_by_levels(spark):
    runs = lines.LineRuns(spark)
    made = lambda ids: spark.createDataFrame([(i, 1, 2) for i in ids] + [(i, i, i) for i in ids], "doc_id long, h1 long, h2 long")
    for k in range(3):
        runs.add(made(range(10 * k, 10 * k + 2)))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert [(r.n_docs, r.max_doc) for r in runs.frequent(5).collect()] == [(6, 21)]
    assert runs.unseen(spark.createDataFrame([(1, 2), (5, 5)], "h1 long, h2 long")).collect()[0].h1 == 5


def test_line_runs_hold_a_key_once(spark):
    runs = lines.LineRuns(spark)
    for k in range(5):
        runs.add(spark.createDataFrame([(10 * k + i, h, h) for i in range(2) for h in (0, k, i)] + [(10 * k, 99, -k)], "doc_id long, h1 long, h2 long").distinct())
    held = spark.read.parquet(*(r for level in runs.levels for r in level)).collect()
    assert len(held) == len({(r.h1, r.h2) for r in held}) == 10
    assert {(r.h1, r.n_docs, r.max_doc) for r in runs.frequent(3).collect()} == {(0, 10, 41), (1, 6, 41)}


@pytest.mark.parametrize("n_words", [3, 40])
def test_pieces_cross_every_place_of_long_words(n_words):
    """Sums over the whole lattice against a plain recursion, and draws that are cut nowhere."""
    table = sampling.piece_table(sampling.MODEL, sampling.ALPHA)
    word = ("information" * 70).encode()
    texts = [word + b"s" * i for i in range(n_words)]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    start, end, _, weight = sampling.lattice(table, data, offs)
    alpha, _ = sampling.forward(start, end, weight, offs)
    want = np.full(len(alpha), -np.inf)
    want[offs[:-1] + np.arange(n_words)] = 0.0
    for a, b, w in zip(start, end, weight, strict=True):
        want[b] = np.logaddexp(want[b], want[a] + w)
    assert np.allclose(alpha, want)
    cut = np.zeros(len(word), int)
    for seed in range(60 // n_words):
        ids, bounds = sampling.encode(table, data, offs, np.arange(n_words), seed)
        assert table.bytes_of(ids).tobytes() == data.tobytes()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            edges = np.cumsum(table.lengths[ids[a:b]])
            cut[edges[edges < len(word)]] += 1
    assert (cut[[256, 512]] < 60 // n_words * n_words).all()


def test_sampled_pieces_are_decoded(odd):
    rows = sampling.sample_pieces(odd, digest=True).collect()
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in ODD)


def test_quality(spark, odd, empty):
    assert quality.ledger(odd).filter("NOT (fail_bits & 1 = 1 OR n_words >= 50)").count() == 0
    kept = quality.keep_clean(odd)
    assert kept.columns == odd.columns and quality.keep_clean(empty).count() == 0
    rows = quality.ledger(spark.createDataFrame([("a b c a b c d",), ("a b a b a",), ("x",)], "text string"))
    assert [r.n_repeat_words for r in rows.collect()] == [6, 5, 0]
    found = {r.rule: r for r in quality.ablation(rows, "v1").collect()}
    assert found["too_short"].n_failed == 3 and set(found) == set(quality.RULES)


def test_mixing_meets_targets(spark, odd, empty):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["a", "b", None][i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs).toPandas()
    assert (out.taken <= 2 * out["size"]).all()
    per = out.groupby(out.source.fillna("")).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.most).all() and abs(per.target.sum() - 1.5 * out["size"].sum()) < 1
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    assert (out.set_index("doc_id").taken.sort_index() == again.set_index("doc_id").taken.sort_index()).all()
    assert mixing.mix_sources(odd).count() == len(ODD) and mixing.mix_sources(empty).count() == 0
    assert mixing.repeat_to_mix(odd).columns == odd.columns


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets shared and shared again by weight, source by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    stopped, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in stopped]
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] >= most * sizes[s]]
        if not over:
            return {s: stopped.get(s, level * w[s]) for s in order}
        for s in over:
            stopped[s] = most * sizes[s]
            left -= stopped[s]


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(2)
    names = [f"{chr(97 + k % 26)}{k}" for k in range(57)] + ["Z", "é", "", "😀", None]
    rows = [(n, int(x)) for n in names for x in (rng.pareto(0.7, 3) * 20).clip(0, 10**6)] + [("empty", 0)]
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(5)).collect()}
    sizes = {}
    for n, x in rows:
        sizes[n] = sizes.get(n, 0) + x
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(got[n].target == pytest.approx(want[n]) and got[n].source_size == sizes[n] for n in want)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_ablation_against_single_rows(spark):
    rows = quality.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text"))
    bits = [r.fail_bits for r in rows.collect()]
    for policy, rules in quality.POLICIES.items():
        mask = quality.mask(rules)
        for r in quality.ablation(rows, policy).collect():
            bit = 1 << quality.BITS[r.rule]
            own = [b & mask for b in bits]
            assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(b & bit > 0 for b in own), own.count(bit), sum(b & ~bit == 0 for b in own))


def brute_removed(docs):
    seen = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for k, (_, b) in enumerate(raw):
        for p in range(len(b) - 199):
            seen.setdefault(b[p : p + 200], []).append((k, p))
    gone = [np.zeros(len(b) + 200, bool) for _, b in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + 200] = True
    out = {}
    for (i, b), g in zip(raw, gone, strict=True):
        g = g[: len(b)]
        out[i] = (len(b), int(g.sum()), len(re.findall(rb"\x01+", g.astype(np.uint8).tobytes())), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest())
    return out


def test_substrings_against_brute_force(spark, empty):
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    a, b = text(260), text(199)
    docs = [(1, a + text(50)), (2, text(30) + a), (3, b + text(40)), (4, text(9) + b), (5, "z" * 900), (6, None), (7, ""), (8, text(300) + a[20:240]), (9, a[:200]), (10, text(500))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in substrings.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_removed(docs)
    assert substrings.drop_repeats(empty).count() == 0


def passages(seed=4, n=300):
    """Documents of their own words, with passages of 60 to 600 bytes from a small pool, copies and periodic stretches."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}é"[: 2 + k % 5] for k in range(400)]
    text = lambda k: " ".join(rng.choice(words, k))
    pool = [text(int(k)) for k in rng.integers(15, 140, 8)]
    out = []
    for i in range(n):
        parts = [text(int(rng.integers(0, 60))) for _ in range(3)]
        for _ in range(int(rng.integers(0, 3))):
            p = pool[int(rng.integers(0, len(pool)))]
            cut = int(rng.integers(0, len(p) // 3))
            parts.insert(int(rng.integers(0, 4)), p[cut : len(p) - int(rng.integers(0, cut + 1))])
        if i % 25 == 0:
            parts.append("ab " * int(rng.integers(0, 200)))
        out.append((i, " ".join(parts) if i % 11 else out[i - 3][1] if i > 3 else None))
    return out


@pytest.mark.parametrize(("segment", "most_windows", "hot"), [(700, 2 << 20, 1), (8 << 20, 1, 3)])
def test_repeated_passages_against_brute_force(spark, monkeypatch, segment, most_windows, hot):
    """Long texts in segments, too common suffixes window by window, and hot keys in parts."""
    monkeypatch.setattr(substrings, "LEAST_HOT", hot)
    docs = passages()
    got = substrings.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), most_windows=most_windows, segment=segment).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == brute_removed(docs)


def test_vectors(spark):
    v = np.random.default_rng(1).normal(size=(6, 8))
    near = (v[0] + 0.001).tolist()
    rows = [(1, v[0].tolist(), 1), (2, near, 1), (3, (3 * v[0]).tolist(), 1), (4, v[0].tolist(), 2), (5, v[0].tolist(), None), (6, [0.0] * 8, 1), (7, None, 1), (8, [float("nan")] * 8, 1), (9, [1.0, None], 1), (10, v[1].tolist(), 1), (1, v[0].tolist(), 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embeddings.near_vectors(docs).collect())
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)]
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), *alone]
    assert embeddings.near_vectors(docs.limit(0)).count() == 0


def test_personal_data(spark, odd, empty):
    text = "mail é a.b@c.de, 10.0.0.1 or 999.1.1.1, card 4111 1111 1111 1111, +49 (30) 1234567."
    row = pii.find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.kind, text[s.start : s.end]) for s in row.base] == [("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234567")]
    assert pii.find_personal(odd).count() == len(ODD) and pii.find_personal(empty).count() == 0


@pytest.mark.parametrize("span", ["bob [at] example [dot] com", "(415) 555-2671", "4111 1111 1111 1112"])
def test_personal_data_on_long_lines(span):
    """A span is found whole wherever it stands in a line: before, across and after words 128 and 256."""
    texts = [" ".join([*["lorem"] * n, "contact", span, *["ipsum"] * 150]) for n in (3, *range(121, 130), *range(250, 257), 3000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    got = [(r, texts[r][a:b]) for r, _, a, b in pii.Decoder(pii.trained()).spans(data, offs)]
    assert got == [(r, span) for r in range(len(texts))]


def test_toxicity_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_stages_keep_columns_of_any_name_and_repeated_rows(spark):
    shared = "This line is certainly long enough to be a key. "
    rows = [(i % 40, f"{shared}\n" + "w " * (i % 7), f"s{i % 2}") for i in range(80)] + [(None, "w " * 9, "s0")] * 30
    names = ("_id", "_lost", "_source", "_size", "_copies", "_gone", "_row", "id", "row", "rows", "least", "more", "words", "copies", "lost", "kept", "n_lines", "n_dropped", "rank", "node", "part", "s1", "key")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in names}).repartition(4)
    for stage in (quality.keep_clean, lines.without_lines, neardup.keep_one, mixing.repeat_to_mix):
        out = stage(docs)
        assert out.columns == docs.columns and all(r[c] == c for r in out.collect() for c in names)
    size = F.regexp_count("text", F.lit(r"\S+"))
    taken = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    got = {r.source: r.t for r in mixing.repeat_to_mix(docs).groupBy("source").agg(F.sum(size).alias("t")).collect()}
    assert got == {r.source: r.t for r in taken}


@pytest.mark.parametrize("most_sent", [0, 500_000])
def test_lines_against_brute_force(spark, monkeypatch, most_sent):
    monkeypatch.setattr(lines, "MOST_SENT", most_sent)
    rng = np.random.default_rng(6)
    pool = [f"{'  ' * (k % 2)}{'Line' if k % 3 else 'LINE'} number {k // 2} " + "é" * 30 for k in range(14)] + ["short", "", "\t"]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(0, 9))) if i % 9 else None) for i in range(90)]
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(i)
    want = {}
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(holders.get(key(x), ())) < 5 or i == max(holders[key(x)])]
        want[i] = (len(own), len(own) - len(kept), "\n".join(kept))
    got = lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == want


def test_pivotal_steps_keep_sums_and_expectations():
    rng = np.random.default_rng(9)
    size, part = [float(x) for x in rng.integers(1, 60, 7)], [float(x) for x in rng.random(7)]
    draws = np.array([mixing.pivot(size, part, list(rng.random(7))) for _ in range(20_000)])
    assert ((draws > 0) & (draws < 1)).sum(axis=1).max() <= 1
    assert np.allclose(draws @ size, np.dot(size, part))
    assert np.abs(draws.mean(axis=0) - part).max() < 0.015


def test_many_lost_lines(spark):
    """100,000 frequent lines in each of five documents: time in proportion to the lines."""
    import time

    text = "\n".join(f"This is line number {i} of a text that comes five times" for i in range(100_000))
    docs = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string").repartition(5)
    began = time.time()
    out = {r.doc_id: (r.n_dropped, r.n) for r in lines.drop_lines(docs).select("doc_id", "n_dropped", F.char_length("text").alias("n")).collect()}
    assert out == {i: (100_000, 0) for i in range(4)} | {4: (0, len(text))}
    assert time.time() - began < 60


def test_one_very_long_word():
    """A word of 1 MB beside an insult costs what its letters cost."""
    import time

    from bytemill.llm import toxicity

    model = toxicity.Model(starts={"wret": 5.0, "despica": 4.0})
    reader = toxicity.Reader(model)
    began = time.time()
    assert reader.evidence("you idiot " + "x" * 1_000_000)[0] > 0 and time.time() - began < 2
    assert model.symbol("despicable")[1] == 4.0 and model.symbol("wret")[1] == 0.0
