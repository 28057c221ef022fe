"""The n-gram join against brute force, on planted edits, ties and odd rows."""

import re

import numpy as np

from bytemill.llm import neardup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for i, text in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORDS.findall(text or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.integers(0, len(out))] = f"z{rng.integers(0, 10**6)}"
    return out


def corpus(seed=5):
    rng = np.random.default_rng(seed)
    rows, i = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "a b c"), (6, "a b c d"), (7, "é ü 漢字 ö x y")], 8
    for size in (5, 6, 8, 12, 20, 37, 60, 90, 150, 400, 1500):
        for _ in range(6):
            base = [f"w{rng.integers(0, 10**7)}" for _ in range(size)]
            for copies in range(rng.integers(1, 7)):
                rows.append((i, " ".join(edited(rng, base, int(rng.integers(0, max(1, size // 28 + 2))) if copies else 0))))
                i += 1
    return rows


def check(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, corpus())


def test_large_block_is_settled_in_tiles(spark):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(edited(rng, base, int(rng.integers(0, 6))))) for k in range(640)]
    check(spark, rows)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).collect() == []
    rows = spark.createDataFrame([(1, "a b c d e f", "x", 3), (2, "a b c d e f", "y", 4), (3, None, "z", 5)], "doc_id long, text string, block string, n long")
    assert sorted(tuple(r) for r in neardup.keep_one(rows).collect()) == [(1, "a b c d e f", "x", 3), (3, None, "z", 5)]


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_structured_words_do_not_collide(spark):
    rows = [(3 * n + i, w) for n in (1024, 2048, 4096) for i, w in enumerate(thue_morse(n))]
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {i: i for i, _ in rows}


def test_parts_of_a_large_block_may_hold_one_row(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 3)
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(60)]
    check(spark, [(k, " ".join(edited(rng, base, int(rng.integers(0, 4))))) for k in range(40)])


def test_rows_that_repeat_an_id_tie_their_texts(spark):
    words = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(9, words[0]), (5, words[0]), (5, words[1]), (2, words[1] + " end"), (7, words[2]), (None, words[2])]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 7), (2, 2), (5, 2), (5, 2), (7, 7), (9, 2)]


def test_common_tokens_are_counted_to_a_bound_only(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_COUNTED", 3)
    check(spark, corpus(seed=11))


def test_second_round_reads_whole_sets_whatever_the_filter(spark, monkeypatch):
    monkeypatch.setattr(neardup, "id_filter", lambda ids, bits=26: np.full(1 << 20, -1, np.int64))
    check(spark, corpus(seed=12)[:120])


def test_shingles_that_most_sets_hold_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_COUNTED", 100)
    rng = np.random.default_rng(13)
    common = " ".join(f"c{k}" for k in range(12))
    rows = []
    for k in range(5000):
        own = [f"w{rng.integers(0, 10**7)}" for _ in range(30)] if k % 2 == 0 else edited(rng, own, int(k % 4 == 1))
        rows.append((k, " ".join(own) + (f" {common}" if k % 10 else "")))
    sets = {i: set(zip(*(t.split()[j : len(t.split()) - 4 + j] for j in range(5)), strict=True)) for i, t in rows}
    want = {i: (len(s), i) for i, s in sets.items()}
    for i in range(0, 5000, 2):  # only neighbours share more than the common passage
        a, b = sets[i], sets[i + 1]
        if 100 * len(a & b) >= 80 * len(a | b):
            want[i + 1] = (len(b), i)
    assert 1000 < sum(i != c for i, (_, c) in want.items()) < 2500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()} == want

    chunks = docs.mapInArrow(neardup._signatures, "doc_id long, n_shingles long, s1 long, s2 long, chunk int, counts binary").filter("chunk IS NOT NULL").select("chunk", "counts")
    crowded = neardup.crowded_counters(neardup.count_classes(chunks), 100)
    assert 8 <= np.unpackbits(crowded).sum() <= 40
    everything = np.full(1 << 20, -1, np.int64)
    tokens = docs.selectExpr("text", "xxhash64(doc_id) AS h").mapInArrow(neardup._second_tokens(everything, crowded), "token long, salt int, key long")
    assert tokens.groupBy("token").count().agg({"count": "max"}).first()[0] > 4000
    assert tokens.groupBy("token", "salt").count().agg({"count": "max"}).first()[0] < 100
