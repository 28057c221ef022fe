"""The pipeline's stages, each against brute force on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bytemill.llm import mixing, sampling

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, sf_dir = str(tmp_path_factory.mktemp("stages")), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("copies", F.lit("clashes"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(f"{at}/{name}")
        out.append(spark.read.parquet(f"{at}/{name}"))
    return out


def test_columns_stay_and_rows_come_from_the_input(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "mix", "sentencepiece"]
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert sorted(after.columns) == sorted(before.columns)
        assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0


def test_clean_documents_stay(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    for r in stages[0].collect():
        if len(WORDS.findall(r.text or "")) < 50:
            assert r.doc_id not in kept
    assert len(kept) > 0.4 * stages[0].count()


def test_near_duplicates_go_and_others_stay(stages):
    def sets(rows):
        out = {}
        for r in rows:
            w = [x.lower() if x.isascii() else x.translate({c: c + 32 for c in range(65, 91)}) for x in WORDS.findall(r.text or "")]
            out[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        return out

    before, after = sets(stages[2].collect()), {r.doc_id for r in stages[3].collect()}
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    assert not any(near(before[a], before[b]) for a in after for b in after if a < b)
    for gone in set(before) - after:
        assert any(near(before[gone], before[x]) for x in before if x != gone)


def test_shared_lines_go(stages):
    """Every text of the line stage against the lines of all its documents."""
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate({c: c + 32 for c in range(65, 91)})
    before = {r.doc_id: r.text or "" for r in stages[1].collect()}
    holders = {}
    for i, t in before.items():
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    stays = lambda i, k: len(k) < 40 or len(holders[k]) < 5 or i == max(holders[k])
    for r in stages[2].collect():
        assert r.text == "\n".join(x for x in before[r.doc_id].split("\n") if stays(r.doc_id, key(x)))


def test_mix_repeats_rows_to_the_targets(stages):
    """Within half a document of each source's target, and as many copies as the operator says."""
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    got = {r.source: r.t for r in stages[4].groupBy("source").agg(F.sum(size).alias("t")).collect()}
    for r in mixing.mix_sources(stages[3]).groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(got.get(r.source, 0) - r.target) <= r.most / 2 + 1
    assert stages[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_pieces_give_the_text_back(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = sampling.join_pieces(stages[5]).collect()
    assert len(rows) == stages[4].count() and all(r.text == (texts[r.doc_id] or "") for r in rows)
