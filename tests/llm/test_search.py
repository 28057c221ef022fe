"""Ranked search against SQL on odd rows, and what the order of the index must do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytemill.llm import search
from bytemill.llm.oracles import ORACLE_SQL

NAME = "op13_lexical_search"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null, empty and very long texts, ties of all sizes, repeated rows and ids, items without terms or with repeated ones."""
    at = str(tmp_path_factory.mktemp("odd"))
    docs = [(i, f"common word{i % 7} " * (1 + i % 3) + f"own{i}") for i in range(600)] + [(i, "Exactly the same TEXT, common.") for i in range(600, 900)]
    docs += [(None, "common word3"), (1, None), (2, ""), (3, " .,;\n"), (5, "x" * 50_000 + " common"), (6, "é漢字 😀 common É"), (6, "é漢字 😀 common É"), (7, "word1 " * 30_000)]
    items = [(0, "common WORD3 word3"), (1, "the same text"), (2, None), (3, "?!"), (4, "nowhere"), (5, "é 漢字 É"), (5, "own17-own18_own19"), (None, "x" * 50_000), (8, "word1 " * 500)]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("other")).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1)).write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("item_terms", [search.ITEM_TERMS, 3])
def test_odd_rows(odd, same_as_sql, item_terms):
    """Also with items in many blocks."""

    def query(spark, sf_dir):
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        index = search.build_index(read("documents"), f"{search.scratch(spark, 'index')}")
        return search.search(index, read("benchmark"), item_terms=item_terms)

    assert len(same_as_sql(query, ORACLE_SQL[NAME], odd)) == 66


def test_empty_tables(spark, odd):
    docs, items = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark"))
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text IS NULL"), items)):
        out = search.rank_documents(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_bisection_brings_like_documents_together():
    rng = np.random.default_rng(0)
    topic = rng.permutation(np.repeat(np.arange(8), 64))
    docs = np.repeat(np.arange(512), 30)
    terms = topic[docs] * 200 + rng.integers(0, 200, len(docs))
    place = search.bisected(docs, terms, 512)
    assert sorted(place) == list(range(512))
    mixed = sum(len(set(topic[np.argsort(place)][at : at + 64])) for at in range(0, 512, 64))
    assert mixed <= 16, "of 8 topics, about one in a cluster"
    assert search.bisected(np.zeros(0, int), np.zeros(0, int), 0).tolist() == []
    assert sorted(search.bisected(np.arange(3), np.zeros(3, int), 3, leaf=1)) == [0, 1, 2]


def test_few_clusters_are_visited(spark):
    """Blocks of documents on eight topics: an item on one of them needs few clusters, and finds what a full scan finds."""
    rng = np.random.default_rng(1)
    topic = rng.integers(0, 8, 2048)
    texts = [" ".join(f"t{t}w{x}" for x in rng.integers(0, 50, 40)) for t in topic]
    index = search.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), search.scratch(spark, "index"))
    block = next(search._blocks(index.toArrow().to_batches()))
    items = search.Items([type("Row", (), {"key": 0, "hashes": search.block_hashes(d, np.array([0, 5]), np.array([4, 9])).tobytes(), "counts": np.array([1, 1]).tobytes()}) for d in [np.frombuffer(b"t3w7 t3w9", np.uint8)]])
    stats = next(search._statistics(items.terms)(iter(index.toArrow().to_batches()))).to_pylist()[0]
    items.weigh(stats["n_docs"], stats["n_terms"], np.frombuffer(stats["df"], np.int64))
    assert stats["n_docs"] == 2048 and stats["n_terms"] == 2048 * 40
    best = search.Best(1, 20)
    seen = []
    impact = items.impact
    items.impact = lambda tf, sizes: (seen.append(len(tf)), impact(tf, sizes))[1]
    search._visit(block, items, best, None)
    assert best.rows[0].shape[1] == 20 and seen[0] <= 32, "runs of two terms in a few of 32 clusters"
