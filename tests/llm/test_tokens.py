"""Token counts against the libraries themselves, text by text."""

import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bytemill.llm import tokens
from bytemill.llm.queries import op11_token_counts

PARTS = [*"aabst'  \n\t1revlmd!.?é漢ñ😀²Ⅷ٣", "　", "́", "\u0085", "﻿", " ", "\x00", "'s", "'re", "'ll", " '", "<|endoftext|>", "<|endof", "'S"]


def brute(texts):
    library = Tokenizer.from_file(tokens.VOCABULARY)
    return [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_random_texts():
    """Every rule of the cut: contractions, white space before words and at ends, special strings across and inside texts."""
    draw = random.Random(3)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 25))) for _ in range(5000)]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    cutter = tokens.ByteLevel(tokens.VOCABULARY)
    starts, ends, hashes, special = tokens._hashed(cutter, data, offs)
    each = np.ones(len(starts), np.int64)
    each[~special] = cutter.lengths(data, starts[~special], ends[~special], hashes[~special], tokens.LengthTable(16))
    assert np.diff(np.append(0, np.cumsum(each))[np.searchsorted(starts, offs)]).tolist() == brute(texts)


def test_query_against_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op11_token_counts(spark, "/root/testdata/sf0.01").collect()
    want = dict(zip(docs, brute([t or "" for t in docs.values()]), strict=True))
    assert len(rows) == len(docs) and {r.doc_id: r.n_tokens for r in rows} == want
    assert all(r.n_bytes == len((docs[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 512) for r in rows)


def test_odd_rows(spark):
    long = "antidisestablishmentarianism" * 4000
    made = [(1, None, 5), (2, "", 5), (3, " \n\t\n", 5), (4, "é漢字 😀", 5), (5, long, 5), (5, long, 5), (None, "it's<|endoftext|> x", 5)]
    rows = spark.createDataFrame(made, "doc_id long, text string, n_tokens long").withColumn("a.b", F.lit("kept")).repartition(3)
    out = tokens.count_tokens(rows)
    assert out.columns == ["doc_id", "a.b", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((i or 0, n) for (i, *_), n in zip(made, brute([t or "" for _, t, _ in made]), strict=True))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out.collect()) == want
    assert tokens.count_tokens(rows.limit(0)).count() == 0
    assert tokens.count_tokens(rows.select("text")).count() == len(made)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_vocabularies_without_a_cut(spark, name):
    path = f"/opt/tokenizers/{name}"
    texts = ["Two words, it's <|endoftext|>", "", "Ünïcode 漢字 " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if name.endswith(".model"):
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        want = [len(x) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [r.n_tokens for r in tokens.count_tokens(rows, path).orderBy("doc_id").collect()] == want


def test_tables_only_save_time():
    """A table that is emptied again and again, and summaries of few entries, lose nothing that they promise."""
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(1, 2**63, 500).astype(np.uint64))
    table = tokens.LengthTable(64)
    for at in range(0, len(hashes), 20):
        part = hashes[at : at + 20]
        table.put(part, np.arange(len(part)))
        assert table.get(part).tolist() == list(range(len(part))) and table.used <= 32
    assert set(table.get(hashes).tolist()) <= {-1, *range(20)}
    stream = rng.zipf(1.5, 50_000).astype(np.uint64)
    have = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in np.array_split(stream, 40):
        new, n = np.unique(part, return_counts=True)
        have = tokens.heaviest(np.concatenate([have[0], new]), np.concatenate([have[1], n]), 50)[:2]
    real = dict(zip(*np.unique(stream, return_counts=True), strict=True))
    assert {h for h, n in real.items() if n > len(stream) / 50} <= set(have[0].tolist())
    assert all(real[h] - len(stream) / 50 <= n <= real[h] for h, n in zip(*have, strict=True))
